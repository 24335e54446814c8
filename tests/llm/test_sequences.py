"""Exact top-k, periodic runs and token alignment beside brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import metric_topk, periodic, queries, token_align

SF = "/root/testdata/sf0.001"
BYTES, PIECES = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
CLASHES = ("id", "rid", "v", "norm", "dim", "query", "pivot", "tree", "block", "page", "runs", "pairs", "n", "x")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


# 11: exact top-k


def _brute_topk(rows, k, scale=64):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is None or i % 3:
            continue
        scores = [
            (-max(1 - (1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, w)))), j is None, j or 0)
            for b, (j, w) in enumerate(ok)
            if b != a and len(w) == len(v)
        ]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tree_rows", [40, 10_000])
def test_topk_is_exact(spark, tree_rows):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    same = [rng.gauss(0, 1) for _ in range(6)]
    rows += [(1000 + i, same) for i in range(120)]  # a third of all rows alike
    rows += [(5, [0.0] * 6), (5, [0.5] * 6), (6, [0.5] * 6), (None, same), (3, None), (6, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6)]
    rows += [(12, [float("inf")] * 6), (15, []), (18, []), (21, [1.0, 2.0]), (24, [3.0, -1.0]), (27, [1e30, 1.0]), (30, [-1e30, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = metric_topk.top_products(df, F.col("vec_id") % 3 == 0, 7, tree_rows=tree_rows, query_rows=30, pivots=4)
    assert sorted(map(tuple, got.collect()), key=str) == _brute_topk(rows, 7)
    none = metric_topk.top_products(df.where("false"), F.col("vec_id") % 3 == 0)
    assert none.count() == 0 and none.columns == got.columns


def test_tree_spares_computations():
    """Pages hold what is below them, and bounds spare most of the work where
    vectors form groups."""
    rng = np.random.default_rng(3)
    v = np.floor(64 * (rng.normal(size=(40, 1, 8)) + 0.02 * rng.normal(size=(1, 100, 8))).reshape(-1, 8))
    top = float((v * v).sum(axis=1).max())
    order = metric_topk._order(metric_topk._lifted(v, top))
    assert sorted(order) == list(range(len(v)))
    v = v[order]
    pages = metric_topk.build(v, np.arange(len(v)), top)
    assert all(len(p["objects"]) <= metric_topk.PAGE for p in pages) and pages[-1]["level"] >= 1
    points = metric_topk._lifted(v, top)
    for p in pages:
        span = metric_topk.PAGE ** p["level"]
        for k, o in enumerate(p["objects"]):
            at = (p["first"] + k) * span
            assert metric_topk._distances(points[at : at + span], points[o]).max() <= p["radii"][k] + 1e-9
            assert p["low"][k] == at
    import pandas as pd

    table = pd.DataFrame([
        {"level": p["level"], "page": p["first"] // metric_topk.PAGE, "routing": int(np.flatnonzero(p["objects"] == p["routing"])[0]),
         "vectors": [metric_topk.packed(x) for x in v[p["objects"]]], "bounds": np.stack([p["away"], p["radii"]]).tobytes(),
         "ids": np.stack([p["objects"] if p["level"] == 0 else p["first"] + np.arange(len(p["objects"])), p["low"]]).astype("<i8").tobytes()}
        for p in pages
    ])
    tree = metric_topk.Tree(table, 8, top)
    asked = range(0, len(v), 970)
    for q in asked:
        none = np.array([-(1 << 62)]), np.array([1 << 62])
        _, got, _, _ = tree.search(v[q : q + 1], 5, np.array([-1]), none)
        assert got.tolist() == sorted((v @ v[q]).astype(int).tolist(), reverse=True)[:5]
    assert tree.computed < 0.5 * len(v) * len(asked) and tree.spared > 0


# 12: periodic runs


def _brute_runs(w, least=24, powers=3):
    found = {}
    for p in range(1, len(w) // powers + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, powers * p):
                found.setdefault((s, i + p), p)
            i = i + 1 if i == s else i
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _made_of_repeats(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        base = [f"w{rng.randint(0, rng.choice([1, 2, 5, 50]))}" for _ in range(rng.randint(1, 14))]
        w += base * rng.randint(1, 9) + [f"é{rng.randint(0, 3)}" for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.2:
            w += w
    return w


def _collapsed(w, runs):
    lost = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in lost)


def test_runs_beside_brute_force(spark):
    rng = random.Random(11)
    texts = [_made_of_repeats(rng) for _ in range(400)]
    texts += [["a"] * 300, ["a", "b"] * 150, [], ["one"], [f"u{i}" for i in range(20_000)], ["x", "y", "z"] * 8_000]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in enumerate(texts)]
    rows += [(None, "a " * 30), (7, None), (7, ""), (8, " \n ")]
    got = periodic.periodic_runs(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, w in enumerate(texts):
        want = _brute_runs(w) if len(w) < 10_000 else [(0, 24_000, 3)] if w[0] == "x" else []
        found = [r for r in by_id[i] if r.n_words == len(w)]
        assert [tuple(x) for x in found[0].runs] == want
        assert found[0].collapsed == _collapsed(w, want)
        if want:
            best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert tuple(found[0].runs[found[0].strongest]) == best
        else:
            assert found[0].strongest is None
    assert [tuple(x) for x in by_id[None][0].runs] == [(0, 30, 1)] and by_id[None][0].collapsed == "a"
    assert sorted(r.collapsed for r in by_id[8]) [0] == ""
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_false_hashes_are_found_out(monkeypatch):
    """With a hash that says yes to all, the comparison of words must reject."""
    ids = np.arange(200, dtype=np.int32) % 50
    true = periodic.Sums.equal
    monkeypatch.setattr(periodic.Sums, "equal", lambda self, i, j, n: np.ones(len(i), bool) if self.seed_ == 0 else true(self, i, j, n))
    init = periodic.Sums.__init__

    def noted(self, ids, seed):
        self.seed_ = seed
        init(self, ids, seed)

    monkeypatch.setattr(periodic.Sums, "__init__", noted)
    ids[:30] = 7
    assert periodic.find_runs(ids, np.array([0, 200])).tolist() == [[0, 30, 1], [30, 200, 50]]


def test_op12_on_the_tables(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = queries._WORD.findall(d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = _brute_runs(w), got[d.doc_id]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(_collapsed(w, runs).encode()).hexdigest()


# 13: alignment of tokenizers


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    letters = token_align.byte_letters()
    assert len(letters) == 256 == len(set(letters.values()))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if text and b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    return tokens


def _brute_alignment(tokens, texts):
    rows, links = [], []
    for text in texts:
        x, y = tokens(text) if text else ([], [])
        own, groups, spans = [], [], []
        for side in (x, y):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        j = 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            own += [(i, b) for b, u, v in spans[1][j : j + 64] if u < e]
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        low = 0
        for e in both:
            groups.append("|".join(",".join(str(i) for i, u, v in side if low <= u and v <= e) for side in spans))
            low = e
        rows.append((len(x), len(y), len(groups), ";".join(groups)))
        links.append(own)
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*r[:3], len(own), r[3], sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own)) for r, own in zip(rows, links)]


@pytest.mark.parametrize("hot", [1 << 19, 30, 0])
def test_alignment_beside_brute_force(spark, sides, hot):
    rng = random.Random(5)
    letters = list("ab zq  \n\t\r.,'1 2<|>s/é ñ日本  　 ▁ﬁ​😀'sx0\x85")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["the cat sat on the mat. " * 20, None, "", " ", "<s> </s> <|endoftext|> <0x41>", "x" * 5000, "word " * 300, " \n ", "same text", "same text"]
    df = clashing(spark.createDataFrame(list(enumerate(texts[:-1])) + [(None, texts[-1])], "doc_id long, text string"))
    got = token_align.alignment(df, BYTES, PIECES, hot_pairs=hot).collect()
    cols = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    want = _brute_alignment(sides, texts)
    by_id = {r.doc_id: tuple(r[c] for c in cols) for r in got}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert by_id[i if i < len(texts) - 1 else None] == w
    assert token_align.alignment(df.where("false"), BYTES, PIECES).count() == 0


def test_op13_on_the_tables(spark, sides):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = _brute_alignment(sides, [d.text for d in docs])
    got = {r.doc_id: r for r in queries.op13_token_alignment(spark, SF).collect()}
    for d, (a, b, groups, links, text, best, total) in zip(docs, want, strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (a, b, groups, links, best, total)
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_stretches_are_what_both_sides_cut(sides):
    """Whole texts and their stretches have the same tokens."""
    aligner = token_align.Aligner(BYTES, PIECES)
    assert aligner.may_cut
    rng = random.Random(9)
    letters = list("ab  é1.'s\n日　 -")
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(30))
        whole = (" " + text).encode()
        data = np.frombuffer(whole, np.uint8)
        ends = token_align.stretch_ends(data, np.array([0, len(data)]), True)
        x, y = sides(text)
        a, b = set(np.cumsum([len(t) for _, t in x]).tolist()), set(np.cumsum([len(t) for _, t in y]).tolist())
        assert not x or set(ends.tolist()) <= a & b
