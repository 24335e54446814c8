"""The training-data operators: truth tables, brute force, hard inputs."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import compare
from gleaner.llm import chat, decontam, exact_dedup, graph, langid, line_dedup, minhash, mixing, pii, quality, queries, url_templates

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def hard(spark):
    """Nulls, empties, a long text, repeated rows, and columns whose names
    operators might use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(None, "null id", None, None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \n", "de", None), (4, long, "en", "b"), (5, "same text here", "en", "a"), (5, "same text here", "en", "a"), (6, "same  text\nhere", "fr", "b"), (7, "!!!", "en", "b")]
    d = docs(spark, rows, "doc_id long, text string, lang string, source string")
    for c in ("id", "n", "keep", "digest", "h", "cls", "comp", "size", "score", "_score", "kept", "norm", "bh", "a", "b", "title"):
        d = d.withColumn(c, F.lit("x"))
    return d.withColumn("n_chars", F.length("text").cast("long"))


def empty(spark):
    return hard(spark).where("false")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = compare.duck(SF).execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.canon(got) == compare.canon(want)


# 1: surrogates


def test_surrogates_keep_type_and_layout():
    text = "Mr. John SMITH <john.smith@mail.example.com> +1 (523) 555-1055, 10.0.0.7, 4111 1111 1111 1111, Госпожа Иванова, DE89 3704 0044 0532 0130 00"
    for kind, s, e in pii.detect(text):
        value = text[s:e]
        canon = pii.canonical(kind, value)
        new = pii.laid_out(kind, value, canon, pii.surrogate(b"k", kind, canon))
        assert new != value
        if not kind.startswith(("given", "surname", "email", "ip")):
            assert re.sub(r"\d", "0", re.sub("[A-Za-z]", "a", new)) == re.sub(r"\d", "0", re.sub("[A-Za-z]", "a", value))
        if kind == "card":
            assert pii.luhn(re.sub(r"\D", "", new))
        if kind == "ip":
            assert new.startswith("10.")
        if kind == "iban":
            n = re.sub(r"\s", "", new)
            assert int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1
        if kind.startswith(("given", "surname")):
            assert pii.script_of(new) == pii.script_of(value) and new.isupper() == value.isupper()
    assert {k.split("_")[0] for k, _, _ in pii.detect(text)} == {"given", "surname", "email", "phone", "ip", "card", "iban"}
    assert pii.surrogate(b"k", "given_f_latin", "anna") in pii.GIVEN["latin", "f"]
    assert pii.surrogate(b"k", "given_m_cyrillic", "иван") in pii.GIVEN["cyrillic", "m"]


def test_surrogates_leave_other_text():
    for text in ("On 2024-01-31 we sold 1234567 units at 3.14.", "Version 1.2.3 of the May report", "", None, "key = value"):
        assert pii.detect(text) == []


def test_surrogates_are_one_to_one_and_coreferent(spark):
    mails = [f"u{i}@m.example.com" for i in range(120)]  # few possible forms: collisions are certain
    rows = [(i, f"from {m} and again {m.upper()}") for i, m in enumerate(mails)] + [(900, "clean text"), (901, None), (902, "")]
    rows += [(903, "call +1 (523) 555-1055"), (904, "call 523-555-1055")]
    got = {r.doc_id: r for r in pii.replace_entities(docs(spark, rows), b"key").collect()}
    new = [re.findall(r"\S+@\S+", got[i].text) for i in range(120)]
    assert all(a == b for a, b in new)
    assert len({a for a, _ in new}) == 120 and not {a for a, _ in new} & set(mails)
    assert got[900].text == "clean text" and got[901].text is None and got[902].text == "" and got[900].n_entities == 0
    assert re.sub(r"\D", "", got[903].text)[1:] == re.sub(r"\D", "", got[904].text)


def test_surrogate_of_a_name_elsewhere_in_the_text(spark):
    got = pii.replace_entities(docs(spark, [(1, "Mrs Anna Smith came. Later Smith left; the smith stayed.")]), b"k").first().text
    name = re.match(r"Mrs (\w+) (\w+) came. Later (\w+) left; the smith stayed.", got)
    assert name and name[2] == name[3] != "Smith" and name[1].lower() in pii.GIVEN["latin", "f"]


def test_surrogates_of_whole_names(spark):
    kept = {
        "Dr María Guadalupe Hernández Ramírez": "Dr",
        "Dr Ludwig van Beethoven": "Dr van",
        "Señora Ana María de la Cruz Gómez y Ortega": "Señora de la y",
        "Mr van der Berg": "Mr van der",
        "Prof Jean d'Alembert": "Prof d",
        "Dr John F. Kennedy": "Dr",
        "Anna von Stein Adler Weiss": "von",
    }
    rows = [(i, f"Then {x} came; later {x.split()[-1]} left the hall.") for i, x in enumerate(kept)]
    got = {r.doc_id: r.text for r in pii.replace_entities(docs(spark, rows), b"k").collect()}
    for i, name in enumerate(kept):
        assert set(re.findall(r"\w+", got[i])) & set(re.findall(r"\w+", name)) == set(kept[name].split())
        kinds = [k.split("_")[0] for k, _, _ in pii.detect(name)]
        assert kinds == sorted(kinds) and kinds[-1] == "surname"


def test_no_name_keeps_itself(spark):
    """With any key, every listed given name and some surnames change."""
    names = sorted({n for (script, _), listed in pii.GIVEN.items() if script == "latin" for n in listed})
    rows = [(i, f"Dr {n.capitalize()} Meyer{chr(97 + i % 26)} signed.") for i, n in enumerate(names)]
    for key in (b"k1", b"k2", b"the test tables"):
        for r in pii.replace_entities(docs(spark, rows), key).collect():
            old = rows[r.doc_id][1].split()
            new = r.text.split()
            assert len(new) == len(old) and new[1] != old[1] and new[2] != old[2]


def test_spans_do_not_depend_on_shards(spark):
    rng = random.Random(8)
    words = [rng.choice("abcdefgh") for _ in range(400)]
    bench = [(i, " ".join(words[i * 9 : i * 9 + 16])) for i in range(40)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 120] + ["zz"] * (i % 3) + words[5:30])) for i in range(30)] + [(99, None), (98, "")]
    got = [
        sorted((r.doc_id, tuple(r.spans), tuple(r["items"]), r.n_hit) for r in decontam.contamination(docs(spark, rows), docs(spark, bench, "item_id long, text string"), shard_bytes=size).collect())
        for size in (64 << 20, 500)
    ]
    assert got[0] == got[1] and any(len(x[1]) > 2 for x in got[0])


def _replaced(spark, *texts):
    rows = pii.replace_entities(docs(spark, list(enumerate(texts))), b"k").collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_surrogates_one_word_one_surrogate(spark):
    a, b, c = _replaced(spark, "Mr. James met Mr. Henry James.", "Dr. James Stone", "Dr. Robin Meyer")
    x = re.match(r"Mr. (\w+) met Mr. (\w+) (\w+).", a)
    assert x[1] == x[3] != x[2] and b.split()[1] == x[1]
    assert c.split()[1].lower() in pii.GIVEN["latin", "n"]


def test_surrogates_of_other_scripts(spark):
    texts = ["昨天王小明先生来了", "السيد محمد حسن،", "श्री राम शर्मा।", "Պարոն Արամ Պետրոսյան", "카드 김철수 씨", "رقم ٤١١١١١١١١١١١١١١١"]
    kept = ["昨天 先生来了", "السيد ،", "श्री ।", "Պարոն", "카드 씨", "رقم"]
    for text, new, stays in zip(texts, _replaced(spark, *texts), kept, strict=True):
        assert new != text and len(new) >= len(text) - 1
        for part in stays.split():
            assert part in new
        assert {pii._script(c) for c in new if c.isalpha()} == {pii._script(c) for c in text if c.isalpha()}
    assert re.search(r"[\u0660-\u0669]{16}$", _replaced(spark, texts[-1])[0])


def test_surrogates_keep_issuer_and_country():
    for n in ("4111111111111111", "5500005555555559", "340000000000009"):
        new = pii.surrogate(b"k", "card", n)
        assert new[:2] == n[:2] and len(new) == len(n) and pii.luhn(new)
    for n, code in (("4915123456789", "49"), ("3725551234567", "372"), ("79261234567", "7")):
        assert pii.surrogate(b"k", "phone", n).startswith(code)
    assert [k for k, _, _ in pii.detect("from 2001:db8::8a2e:370:7334 at 12:30:45")] == ["ip6"]


def test_surrogates_of_a_full_class(spark):
    """Nearly every number of a class is real: these are permuted."""
    real = [f"127.0.{i}.{j}" for i in (1, 2) for j in range(1, 255)]
    rows = [("ip", f"127.{a}.{b}.{c}", "ip") for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)]
    rows += [("ip", x, "ip") for x in real]
    got = pii.assign(spark.createDataFrame(rows, "kind string, canon string, part string"), b"k", rounds=1).collect()
    assert len(got) == len(rows) == len({r.new for r in got}) and all(r.new != r.canon and r.new.startswith("127.") for r in got)
    few = spark.createDataFrame([("ip", f"10.0.0.{i}", "ip") for i in range(1, 30)], "kind string, canon string, part string")
    given = few.where("canon <= '10.0.0.15'").withColumn("new", F.concat(F.lit("10.9.9."), F.substring("canon", 8, 3)))
    full = pii._permuted(few.where("canon > '10.0.0.15'"), given.select("kind", "canon", "new"), b"k").collect()
    assert len(full) == 29 == len({r.new for r in full}) and all(r.new != r.canon for r in full)


def test_surrogates_brute_force(spark):
    """The whole table against a plain loop: what is replaced, and one value
    for one value."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.replace_entities(docs(spark, [tuple(r) for r in table]), b"k").collect()}
    map_, back = {}, {}
    for r in table:
        at, parts = 0, []
        spans = pii.detect(r.text)
        for _, s, e in spans:
            parts.append(re.escape(r.text[at:s]))
            at = e
        m = re.fullmatch("(.+)".join([*parts, re.escape((r.text or "")[at:])]), got[r.doc_id].text or "", re.DOTALL)
        assert m and got[r.doc_id].n_entities == len(spans)
        for (k, s, e), new in zip(spans, m.groups(), strict=True):
            own = (pii.entity_kind(k), pii.canonical(k, r.text[s:e]))
            new = pii.canonical(k, new)
            assert map_.setdefault(own, new) == new != own[1] and back.setdefault((own[0], new), own) == own
    assert len(map_) == len(back) > 10


def test_surrogates_hard(spark):
    d = hard(spark).unionByName(docs(spark, [(8, "Mr. John Smith " * 20_000, None, None, 1), (9, "a@b.example.org", None, None, 1), (9, "a@b.example.org", None, None, 1)], DOCS), allowMissingColumns=True)
    got = pii.replace_entities(d, b"k").collect()
    assert len(got) == 12 and pii.replace_entities(empty(spark), b"k").count() == 0
    assert [r.n_entities for r in got if r.doc_id == 8] == [40_000] and len({r.text for r in got if r.doc_id == 9}) == 1


# 2: url templates


def _rules(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c in string.ascii_uppercase else c for c in host)
    best = max(((h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


def test_url_rules(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "http://com", "http://com/", "http://acom/x", "http://a.net/es/", "x://net#f", "http://ÄB.net/fr/ä"]
    pages = docs(spark, list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("n", F.lit(1))
    for r in url_templates.judge_urls(pages, queries.URL_RULES).collect():
        host, path, rule, verdict = _rules(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))
    assert url_templates.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_url_templates_learn_bad_branches(spark):
    rows = [(i, f"http://h.org/spam/{i}", 1) for i in range(40)] + [(100 + i, f"http://h.org/news/{i}", 0) for i in range(40)]
    rows += [(200 + i, f"http://h.org/spam/{900 + i}", None) for i in range(3)] + [(300 + i, f"http://h.org/news/{900 + i}", None) for i in range(3)]
    pages = docs(spark, rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, [], bad_col="bad").collect()}
    assert {got[i].template for i in (200, 300)} == {"/spam/*", "/news/*"}
    assert all(got[200 + i].verdict == "block" and got[300 + i].verdict == "allow" for i in range(3))


def test_url_templates_merge_like_branches(spark):
    rows = [(i, f"http://h.org/{s}/{i}", None) for i in range(90) for s in ("a", "b", "c")]
    got = url_templates.judge_urls(docs(spark, rows, "page_id long, url string, bad int"), [], bad_col="bad")
    assert {r.template for r in got.select("template").distinct().collect()} == {"/*/*"}


def test_url_templates_merge_two_of_three_branches(spark):
    """Each of the like ones alone, and both together, beside an unlike one."""
    rows = [(1000 * k + i, f"http://h.org/{s}/{i}", 1) for k, s in enumerate("pq") for i in range(30)]
    rows += [(9000 + i, f"http://h.org/r/{'abcd'[i % 4] * 3}/{'wxyz'[i // 4 % 4] * 4}", 0) for i in range(300)]
    pages = docs(spark, rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, [], bad_col="bad").collect()}
    assert {r.template for i, r in got.items() if i < 9000} == {"/{p+1}/*"}
    assert all(r.template.startswith("/r/") for i, r in got.items() if i >= 9000)
    assert all(r.verdict == ("block" if i < 9000 else "allow") for i, r in got.items())


def _plain_templates(rows, least=3, normal=1.645):
    """The tree in plain Python: rows (host, segs, bad) -> template of each."""
    import math

    def shape(x):
        if x is None:
            return "end"
        if re.fullmatch(r"[0-9]+", x):
            return "number"
        if re.fullmatch(r"(?i)(?=.*[0-9])[0-9a-f-]{8,}", x):
            return "hex"
        if re.search(r"\.[A-Za-z0-9]{1,5}$", x):
            return "file"
        return "word" if re.fullmatch(r"[^\W\d]+|[\w-]*", x) and not re.search(r"\d", x) else "other"

    names = [*url_templates.SHAPES, 1, 0, None]

    def table(group, d):
        t = dict.fromkeys(names, 0)
        for _, segs, bad in group:
            t[shape(segs[d + 1] if len(segs) > d + 1 else None)] += 1
            t[bad] += 1
        return t

    def g(own, every, n, total):
        return sum(2 * own[k] * math.log(own[k] * total / (every[k] * n)) for k in names if own[k])

    def bar(t):
        free = max(1, sum(v > 0 for v in t.values()) - 2)
        return free * (1 - 2 / (9 * free) + normal * math.sqrt(2 / (9 * free))) ** 3

    out = {}

    def grow(group, d, name):
        ends = [r for r in group if len(r[1]) == d]
        out.update({id(r): name for r in ends})
        group = [r for r in group if len(r[1]) > d]
        if not group:
            return
        if len(group) < least:
            out.update({id(r): name + "/*" * (len(r[1]) - d) for r in group})
            return
        by, cells = {}, {}
        for r in group:
            by.setdefault(r[1][d], []).append(r)
        for seg, rs in by.items():
            t = table(rs, d)
            if shape(seg) in ("word", "file", "other") and len(rs) >= least:
                top = max(t[s] for s in url_templates.SHAPES)
                follow = next(i for i, s in enumerate(url_templates.SHAPES) if t[s] == top)
                seen = t[1] + t[0]
                rate = 1 + math.floor(math.asin(math.sqrt(t[1] / seen)) * 16 / math.pi + 1e-9) if seen else 0
                cells.setdefault(follow, {}).setdefault((rate, 4 * seen // len(rs)), []).append(seg)

        def apart(some, others):
            """The statistic, and whether it tells two lists of cells apart."""
            one, two = ([r for c in x for s in c for r in by[s]] for x in (some, others))
            t, u = table(one, d), table(two, d)
            both = {k: t[k] + u[k] for k in names}
            value = round(g(t, both, len(one), len(one) + len(two)) + g(u, both, len(two), len(one) + len(two)), 9)
            return value, value >= bar(both)

        def divide(cells):
            cuts = [apart(cells[:k], cells[k:]) for k in range(1, len(cells))]
            alone = [apart([c], cells[:i] + cells[i + 1 :]) for i, c in enumerate(cells) if len(cells) > 1]
            if not any(x[1] for x in cuts + alone):
                return [[s for c in cells for s in c]]
            k = 1 + max(range(len(cuts)), key=lambda i: (cuts[i][0], -i))
            return divide(cells[:k]) + divide(cells[k:])

        pools = [p for follow in sorted(cells) for p in divide([s for _, s in sorted(cells[follow].items())])]
        every, rest = table(group, d), set(by)
        for segs in pools:
            rs = [r for s in segs for r in by[s]]
            if len(by) == 1 or g(table(rs, d), every, len(rs), len(group)) >= bar(every):
                rest -= set(segs)
                first = min(segs, key=lambda s: s.encode())
                step = f"{name}/{first if len(segs) == 1 else '{%s+%d}' % (first, len(segs) - 1)}"
                go(rs, d, step)
        go([r for s in rest for r in by[s]], d, name + "/*")

    def go(rs, d, step):
        if sum(len(r[1]) > d + 1 for r in rs) >= least:
            grow(rs, d + 1, step)
        else:
            out.update({id(r): step + "/*" * (len(r[1]) - d - 1) for r in rs})

    hosts = {}
    for r in rows:
        hosts.setdefault(r[0], []).append(r)
    for rs in hosts.values():
        grow(rs, 0, "")
    return [out[id(r)] for r in rows]


def test_url_templates_brute_force(spark):
    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        host, path, _, verdict = _rules(r.url)
        bad = {"block": 1, "allow": 0}.get(verdict)
        rows.append((host, [x for x in path.split("/") if x], bad))
    rng = random.Random(4)
    for i in range(1500):
        segs = [rng.choice(["p", "q", "news", "spam", "x.html"]), str(rng.randrange(50)), rng.choice(["edit", "view"])][: rng.randrange(4)]
        rows.append(("h.org", segs, rng.choice([None, 0, 1]) if "spam" not in segs else 1))
    want = _plain_templates(rows)
    d = docs(spark, [(i, f"http://{h}/" + "/".join(s), b) for i, (h, s, b) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r.page_id: r.template for r in url_templates.judge_urls(d, [], bad_col="bad").collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_url_templates_repeated_and_long(spark):
    long = "http://h.org/" + "ab/cd/" + "c" * 100_000
    got = url_templates.judge_urls(docs(spark, [(1, long), (1, long), (2, long)], "page_id long, url string"), []).collect()
    assert len(got) == 3 and len({r[1:] for r in got}) == 1


def test_url_templates_keep_a_small_bad_branch(spark):
    rows = [(i, f"http://h.org/{'abcdefghij'[i % 10]}{'klmno'[i // 10 % 5]}/{i}", 0) for i in range(1960)]
    rows += [(5000 + i, f"http://h.org/spam/{i}", 1) for i in range(40)]
    pages = docs(spark, rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, [], bad_col="bad").collect()}
    assert {r.template for i, r in got.items() if i >= 5000} == {"/spam/*"}
    assert all(r.verdict == ("block" if i >= 5000 else "allow") for i, r in got.items())


@pytest.mark.parametrize("sections", [(2, 6, 12, 16), (2, 6, 16), (0, 2, 4, 7, 10, 13, 16, 18, 20)])
def test_url_templates_do_not_chain_like_neighbours(spark, sections):
    """Of 20 urls a section, the given numbers are bad: each section is like the
    next one, but the first isn't like the last."""
    rows = [
        (100 * k + i, f"http://h.org/{chr(97 + k)}/{'mnop'[i % 4]}/{i}", int(i < bad)) for k, bad in enumerate(sections) for i in range(20)
    ]
    pages = docs(spark, rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, [], bad_col="bad").collect()}
    first, last = [got[i] for i in range(20)], [got[100 * (len(sections) - 1) + i] for i in range(20)]
    assert {r.verdict for r in first} == {"allow"}
    assert not {r.template.split("/")[1] for r in first} & {r.template.split("/")[1] for r in last}


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40)).filter(any), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_url_pools_hold_no_unlike_cell(labels):
    counts = np.array([[0, 0, 0, sum(x), 0, 0, *x] for x in sorted(labels)], dtype=float)
    pools = np.array(url_templates._divided(counts, 1.645))
    assert pools[0] == 0 and set(np.diff(pools)) <= {0, 1}
    for p in set(pools):
        part = counts[pools == p]
        for i in range(len(part) if len(part) > 1 else 0):
            rest = np.delete(part, i, 0).sum(0)
            kinds = max(1, int((part.sum(0) > 0).sum()) - 2)
            bar = kinds * (1 - 2 / (9 * kinds) + 1.645 * (2 / (9 * kinds)) ** 0.5) ** 3
            both = np.array([part[i], rest])
            want = both[:, 6:].sum(1, keepdims=True) * both.sum(0) / both[:, 6:].sum()
            seen = both > 0
            assert 2 * (both[seen] * np.log(both[seen] / want[seen])).sum() < bar + 1e-6


def test_url_templates_tell_few_labels_from_many(spark):
    """One bad label of 300 urls is no section that is bad throughout."""
    rows = [(i, f"http://h.org/{s}/x/{i}", b) for i, (s, b) in enumerate([("a", 1)] + [("a", None)] * 299 + [("b", 1)] * 60 + [("c", 0)] * 300)]
    pages = docs(spark, rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, [], bad_col="bad").collect()}
    assert {got[i].verdict for i in range(300)} == {"allow"} and {got[i].verdict for i in range(300, 360)} == {"block"}


def test_url_templates_go_to_the_last_segment(spark):
    stem = "/".join("abcdefghi")
    rows = [(100 * k + i, f"http://h.org/{stem}/{s}/{i}", k) for k, s in enumerate(("good", "bad")) for i in range(40)]
    rows += [(900, "http://g.org/" + "/".join("x" * 200), 0), (901, "http://h.org", None)]
    pages = docs(spark, rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, [], bad_col="bad").collect()}
    assert len(got) == len(rows)
    for k, s in enumerate(("good", "bad")):
        assert {got[100 * k + i].template for i in range(40)} == {f"/{stem}/{s}/*"}
    assert got[900].template == "/*" * 200 and got[901].template == ""


# 3: chat


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b <|im_end|>\n<|im_start|>user\nx", None, "", "ü" * 3000, "\\", "<\\|im_end|>", "<<SYS>>"]
    rows = [(1, t, r, x) for t, (r, x) in enumerate((("user", "assistant")[i % 2], x) for i, x in enumerate(texts))]
    rows += [(2, 0, None, "x"), (2, 0, "a\nb\\n", "y"), (None, 0, "assistant", "z")]
    got = {r.conv_id: r for r in chat.format_conversations(docs(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    assert chat.read_turns(got[1].formatted) == [(r, x or "") for _, _, r, x in rows[:8]]
    assert chat.read_turns(got[2].formatted) == [("", "x"), ("a\nb\\n", "y")]
    raw = got[1].formatted.encode()
    learned = [chat.unescape(raw[a:b].decode()) for a, b in zip(got[1].loss_starts, got[1].loss_ends)]
    assert learned == [x or "" for _, _, r, x in rows[:8] if r == "assistant"]
    assert got[None].n_turns == 1
    for c in chat.CONTROL:
        assert c not in chat.escape(pa.array([c + c]))[0].as_py()


def test_chat_long_conversation_over_many_tasks(spark):
    rows = docs(spark, [(7, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(5000)], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(rows.repartition(8)).first()
    assert [t for _, t in chat.read_turns(r.formatted)] == [f"t{i}" for i in range(5000)]
    raw = r.formatted.encode()
    assert "".join(raw[a:b].decode() for a, b in zip(r.loss_starts, r.loss_ends)) == "".join(f"t{i}" for i in range(0, 5000, 2))
    assert chat.format_conversations(rows.where("false")).count() == 0


def test_chat_reads_back_segment_by_segment(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_BYTES", 500)
    texts = [f"t{i} <|im_end|> ü\\" * (i % 7) for i in range(900)]
    rows = [(7, i, "user" if i % 3 else "assistant", x) for i, x in enumerate(texts)] + [(8, 0, None, None), (None, 1, "user", "z")]
    given = docs(spark, rows, "conv_id long, turn long, role string, text string").repartition(5)
    segments = chat.format_segments(given)
    assert max(len(r.body) for r in segments.collect()) < 1000
    got = {r.conv_id: r for r in queries.read_back(segments).collect()}
    whole = chat.format_conversations(given).where("conv_id = 7").first()
    assert set(got) == {7, 8, None} and got[8].n_turns == got[None].n_turns == 1
    assert got[7].n_turns == 900 and got[7].formatted_chars == len(whole.formatted)
    learned = "".join(texts[::3])
    assert got[7].loss_chars == len(learned) and got[7].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    turns = "".join(f"{r}\n{x}\n" for _, _, r, x in rows[:900])
    assert got[7].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert queries.read_back(segments.where("false")).count() == 0


# 4: exact duplicates


def test_exact_hard(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_copies(hard(spark)).collect()}
    assert (5, 5, 3, True) in got and (6, 5, 3, False) in got and (1, 1, 2, True) in got and (2, 1, 2, False) in got
    assert exact_dedup.exact_copies(empty(spark)).count() == 0
    left = exact_dedup.drop_copies(hard(spark))
    assert left.columns == hard(spark).columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 3, 4, 5, 7]
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_exact_null_ids_and_shared_ids(spark):
    d = docs(spark, [(None, "a"), (2, "a"), (None, "b"), (None, "b"), (3, "c"), (3, "a")])
    left = sorted((r.doc_id or -1, r.text) for r in exact_dedup.drop_copies(d).collect())
    assert left == [(-1, "b"), (2, "a"), (3, "c")]


def test_exact_small_memtables_and_saturated_filter(spark):
    rng = random.Random(3)
    d = docs(spark, [(i, f"t{rng.randint(0, 400)}") for i in range(3000)])
    want = {}
    for r in d.collect():
        want.setdefault(r.text, []).append(r.doc_id)
    got = exact_dedup.exact_copies(d, memtable_rows=64, filter_bits=64).collect()
    assert len(got) == 3000
    for r in got:
        group = want[d_text(r, want)]
        assert (r.keep_id, r.group_size) == (min(group), len(group))


def d_text(row, groups):
    return next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == row.text_sha256)


# 5: near duplicates


def _shingles(text):
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_near_duplicates_brute_force(spark):
    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(60)]
    base = [f"b{i}" for i in range(150)]
    for i in range(260):  # one wide family, many just at the threshold
        rows.append((i, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05])))))
    for i in range(120):  # texts that share a passage
        rows.append((1000 + i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([5, 30, 90]))])))
    for i in range(60):  # short ones
        rows.append((2000 + i, " ".join(f"s{rng.randrange(4)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 7])))))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "A b C d E f"), (3004, "a B c D e F")]
    rng.shuffle(rows)
    want = brute(rows)
    for block in (2048, 16):
        got = minhash.near_duplicates(docs(spark, rows), block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_hard(spark):
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(hard(spark)).collect()}
    assert got[5] == got[6] == 5 and got[1] == 1 and got[2] == 2 and got[4] == 4 and got[None] is None
    assert minhash.near_duplicates(empty(spark)).count() == 0
    left = minhash.drop_near_duplicates(hard(spark))
    assert left.columns == hard(spark).columns and left.count() == 8
    assert minhash.drop_near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_filter_ids_once(spark, monkeypatch):
    """Texts that visit many components are keys of the filter once each."""
    keys = []

    class Counted(minhash.Bloom):
        def __init__(self, ids, column):
            keys.append((ids.count(), ids.distinct().count()))
            super().__init__(ids, column)

    monkeypatch.setattr(minhash, "Bloom", Counted)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in rng.choice(60, 2, replace=False):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    minhash.near_duplicates(docs(spark, rows), block=8).collect()
    assert len(keys) > 1 and all(n == d for n, d in keys)


def test_estimate_is_near(spark):
    a, b = " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(40, 440))
    s = minhash.signatures(docs(spark, [(1, a), (2, b)]))
    x, y = s.where("id = 1").select(F.col("sig").alias("x")), s.where("id = 2").select(F.col("sig").alias("y"))
    got = x.withColumn("k", F.lit(1)).join(y.withColumn("k", F.lit(1)), "k").select(minhash.estimate(F.col("x"), F.col("y"))).first()[0]
    assert abs(got - 356 / 436) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (5, 5)]
    got = {r.node: r.comp for r in graph.components(docs(spark, edges, "a long, b long")).collect()}
    assert got[200] == 0 and got[1002] == 1000 and len(got) == 204
    assert graph.components(docs(spark, [], "a long, b long")).count() == 0


# 6 and 7: models


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def test_language_id_hard(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(hard(spark), hard(spark)).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[4][0] in ("en", "fr")
    assert langid.predict_language(empty(spark), hard(spark)).count() == 0
    assert {r.lang_pred for r in langid.predict_language(hard(spark), empty(spark)).collect()} == {"und"}
    one = docs(spark, [(1, "nur eins", "de")], "doc_id long, text string, lang string")
    assert langid.predict_language(one, one).first().lang_pred == "de"


def test_language_sample_of_a_dirty_column(spark):
    rows = [(i, f"l{i}", f"text {i} words") for i in range(40)] + [(50 + i, "de", f"das ist ein Haus {i}") for i in range(3)]
    rare = docs(spark, rows, "doc_id long, lang string, text string")
    got = langid.predict_language(rare, rare, sample_langs=1).collect()
    assert len(got) == 43 and {r.lang_pred for r in got} == {"de"}


def test_language_families():
    assert langid.family("en") == langid.family("de-AT") == "germanic" and langid.family("xx") == "xx"


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_hard(spark):
    labels = docs(spark, [(4, 1), (5, 0), (None, 1), (6, None), (7, 3), (99, 1)], "doc_id long, quality int")
    score = quality.scorer(hard(spark), labels)
    got = hard(spark).select("doc_id", score(F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got) and len(got) == 9
    none = quality.scorer(hard(spark), labels.where("false"))
    assert {r.s for r in hard(spark).select(none(F.col("text")).alias("s")).collect()} == {0.5}
    assert quality.keep_good(hard(spark), score(F.col("text")), 0.0).columns == hard(spark).columns
    assert quality.keep_good(empty(spark), score(F.col("text"))).count() == 0


# 8: decontamination


def _words(text):
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("shard", [64 << 20, 20_000])
def test_decontamination_brute_force(spark, shard):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(6)] + ["Ünder", "straße", "Ab-c"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 13, 14, 20])))) for i in range(20)]
    bench += [(50, None), (51, " ... "), (52, bench[5][1]), (53, bench[5][1].upper())]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = (bench[rng.randrange(20)][1]).split()
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    rows += [(900, None), (901, "")]
    wins = {}
    for i, t in bench:
        w = _words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    got = {r.doc_id: r for r in decontam.contamination(docs(spark, rows), docs(spark, bench, "item_id long, text string"), shard_bytes=shard).collect()}
    for i, t in rows:
        w, hit, items = _words(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if (owners := wins.get(tuple(w[p : p + k]))) is not None:
                    hit.update(range(p, p + k))
                    items |= owners
        r = got[i]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (len(w), len(hit), sorted(items))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_hard(spark):
    bench = docs(spark, [(1, "same text here"), (None, "null id")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontam.contamination(hard(spark), bench).collect()}
    assert got[5] and got[6] and got[None] and not got[4] and not got[1]
    left = decontam.decontaminate(hard(spark), bench)
    assert left.columns == hard(spark).columns and left.count() == 5
    assert decontam.decontaminate(hard(spark), bench.where("false")).count() == 9
    assert decontam.decontaminate(empty(spark), bench).count() == 0


# 9: lines


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["a\nb\nc\nd", "x\na\nb\nc\ny"], ["a\nb\nc\nd", "x\ny"]),
        (["a\nb", "a\nb"], ["a\nb", "a\nb"]),
        (["a\nb\nc", "a\nb\nc"], ["a\nb\nc", ""]),
        (["r\n" * 9 + "r"], ["r\nr\nr"]),
        (["a\nb\nc\nd\ne", "a\nb\nc\nd\ne\nf"], ["a\nb\nc\nd\ne", "f"]),
        ([None, "", "a\nb\nc\nq\na\nb\nc"], [None, "", "a\nb\nc\nq"]),
    ],
)
def test_line_dedup(spark, texts, want):
    got = line_dedup.remove_repeats(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.text for r in got] == want


def test_line_dedup_hard(spark):
    got = line_dedup.remove_repeats(hard(spark)).collect()
    assert len(got) == 9 and line_dedup.remove_repeats(empty(spark)).count() == 0
    plan = line_dedup.remove_repeats(hard(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10: mixing


def test_mixing_targets_and_bounds(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 30), None, s, 0) for i, s in enumerate(["a"] * 400 + ["b"] * 30 + ["c"] * 200 + [None] * 100)]
    got = mixing.mix_sources(docs(spark, rows, DOCS)).collect()
    by = {}
    for r, row in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert r.size == len(row[1].split()) and r.taken <= 3 * r["size"] and r.taken % r["size"] == 0
        b = by.setdefault(row[3], [0, r.target, r.source_size])
        b[0] += r.taken
    for taken, target, size in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 30
    assert abs(sum(t for _, t, _ in by.values()) - sum(s for _, _, s in by.values())) < 1e-6
    assert sorted(map(tuple, mixing.mix_sources(docs(spark, rows[::-1], DOCS).repartition(7)).collect())) == sorted(map(tuple, got))


def test_mixing_hard(spark):
    got = {r.doc_id: r for r in mixing.mix_sources(hard(spark)).collect()}
    assert got[1]["size"] == got[2]["size"] == got[3]["size"] == 0 and got[1].taken == 0
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, None, "a", 0)], DOCS)).first().target == 0.0


def test_mix_is_what_the_ledger_says(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"s": F.lit(1), "bar": F.lit(2), "copies": F.lit("x")})
    ledger = {r.doc_id: r.taken // r["size"] for r in mixing.mix_sources(d).collect() if r["size"]}
    got = mixing.mix(d, broadcast_sources=0)
    assert got.columns == d.columns
    assert {r.doc_id: r.copies for r in got.where("text <> ''").collect()} == {k: n for k, n in ledger.items() if n}


# the pipeline


def test_pipeline_stages_on_hard_input(spark, tmp_path):
    import corpus_pipeline

    d = hard(spark)
    columns = d.columns
    hard(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs(spark, [(4, 1), (5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs(spark, [(1, "one two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == columns
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, d, str(tmp_path)).columns == [*columns, "copies"]
    assert last(spark, d.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_agrees_with_its_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").cache()
    good = {r.doc_id for r in corpus_pipeline.quality_stage(spark, d, sf).collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & good) <= 0.05 * len(bad)
    clean = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, d, sf).collect()}
    hit = {r.doc_id for r in queries.op8_decontamination(spark, sf).where("contaminated").collect()}
    assert clean == {r.doc_id for r in d.collect()} - hit
    near = {r.doc_id for r in corpus_pipeline.near_stage(spark, d, sf).collect()}
    assert near == {r.doc_id for r in queries.op5_minhash_near_dedup(spark, sf).where("kept").collect()}
    exact = {r.doc_id for r in corpus_pipeline.exact_stage(spark, d, sf).collect()}
    assert exact == {r.doc_id for r in queries.op4_exact_dedup(spark, sf).where("kept").collect()}
