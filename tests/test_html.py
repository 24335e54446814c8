"""Pages by events beside a plain tree of the standard library's parser, and
crawls beside a queue."""

import re
from collections import deque
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions.web import in_scope, normal_url
from gleaner.plans import text as P
from gleaner.sources import crawl

VOID = "area base br col embed hr img input link meta param source track wbr".split()


class Tree(HTMLParser):
    """Nested lists: [tag, attributes, children]; unknown end tags are dropped."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.feed(re.sub(r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ", page or ""))
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in reversed(attrs)}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.open[1:]]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)

    def handle_comment(self, data):
        self.open[-1][2].append(["!", {}, None])

    def handle_decl(self, decl):
        self.open[-1][2].append(["!", {}, None])


def _clean(text):
    return " ".join(re.sub("[​‌‍﻿]", "", text).split())


def _render(node, base, heading=False, anchor=False):
    if isinstance(node, str):
        return node
    tag, attrs, children = node
    if children is None:
        return " "
    if tag in ("button", "svg", "script", "style", "noscript"):
        return " "
    is_head = re.fullmatch("h[1-6]", tag) is not None and not heading
    is_link = tag == "a" and not anchor
    inner = "".join(_render(c, base, heading or is_head, anchor or is_link) for c in children)
    if is_head:
        return f"\n{'#' * int(tag[1])} {_clean(inner)}\n" if _clean(inner) else "\n"
    if is_link:
        href = attrs.get("href", "").strip()
        to = "" if not href or href.lower().startswith(("javascript:", "mailto:", "tel:", "data:", "#")) else urljoin(base, href)
        return f"[{_clean(inner) or to}]({to})" if to and not heading else _clean(inner) or " "
    if tag == "br":
        return "\n"
    return inner if tag == "" else f" {inner}" + ("" if tag in VOID else "\n\n" if tag == "p" else " ")


def _plain(page, base):
    text = re.sub("[​‌‍﻿]", "", _render(Tree(page).root, base))
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", text)).strip()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_text_of_all_pages(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").collect()
    got = {r.page_id: r for r in P.page_text(spark, f"/root/testdata/{folder}").collect()}
    assert len(got) == len(pages)
    for p in pages:
        want = _plain(p.html, p.url)
        assert (got[p.page_id].text or "") == want
        assert got[p.page_id].error == (None if want else "no text")


def test_sections_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in P.page_sections(spark, "/root/testdata/sf0.01").collect()}

    def articles(node):
        for c in node[2] or []:
            if not isinstance(c, str):
                yield from [c] if c[0] == "article" else articles(c)

    def anchors(node):
        own = node[0] == "a" and "href" in node[1]
        return own + sum(anchors(c) for c in node[2] or [] if not isinstance(c, str))

    for p in pages:
        parts = list(articles(Tree(p.html).root))
        texts = [re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", _render(a, p.url))).strip() for a in parts]
        assert (got[p.page_id].text or "") == "\n".join(texts).strip()
        assert got[p.page_id].n_links == sum(map(anchors, parts))
        assert got[p.page_id].error == (None if parts and "".join(texts) else "the selector fits nothing" if not parts else "no text")


@pytest.mark.parametrize(
    "page,want",
    [
        ('<h2>A <a href="/x">link</a> &amp; more<button>copy</button></h2><p>t', "## A link & more\n t"),
        ('<a href="../b?q=1">go</a>', "[go](https://h/b?q=1)"),
        ("<a href='mailto:x@y'>mail</a> <a>none</a><a href=z></a>", "mail none[https://h/d/z](https://h/d/z)"),
        ("&euro; &#233; &notanentity; &lt;b&gt;", "€ é ¬anentity; <b>"),
        ("<script>if (a < b) '<p>'</script>x<style>p{}</style>y", "x y"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<p>one<p>two</p></div>three", "one two\n\nthree"),
        ('<a title="a > b" href="/q">x</a>', "[x](https://h/q)"),
        ("<!-- no <p>text --><svg><text>s</text></svg>", ""),
        ("<a href='/n'><h3>Head</h3></a>", "[### Head](https://h/n)"),
        (None, ""),
        ("1 < 2 <3", "1 < 2 <3"),
    ],
)
def test_page_text(page, want):
    assert H.text_of(H.events(page), "https://h/d/c") == want


def test_events_nest():
    found = [(e.kind, e.name, e.depth) for e in H.events("<div id=m><p>a<b>b</div>c</p>")]
    assert found == [("open", "div", 0), ("open", "p", 1), ("text", "", 2), ("open", "b", 2), ("text", "", 3), ("close", "b", 2), ("close", "p", 1), ("close", "div", 0), ("text", "", 0)]
    assert H.matches("div", {"class": "x y", "id": "m"}, "p, div.y#m") and not H.matches("div", {}, ".y")
    with pytest.raises(ValueError):
        H.matches("p", {}, "div > p")


def _queue_crawl(spark, rows, root, most, deepest, most_links):
    """The crawl as a queue does it, with addresses from the engine."""
    hrefs = {(u, h) for u, page in rows for h in re.findall(r'href="([^"]*)"', page)} | {(root, root)} | {(u, u) for u, _ in rows}
    df = spark.createDataFrame(sorted(hrefs), "base string, href string")
    norm = {(r.base, r.href): (r.n, r.ok) for r in df.select("base", "href", normal_url(F.col("href"), F.col("base")).alias("n")).withColumn("ok", in_scope(F.lit(root), F.col("n"))).collect()}
    pages = {norm[u, u][0]: (u, page) for u, page in sorted(rows, reverse=True)}
    queue, seen, out = deque([(norm[root, root][0], 0)]), set(), []
    while queue and len(out) < most:
        url, depth = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        if url not in pages:
            continue
        raw, page = pages[url]
        if _plain(page, url):
            out.append((len(out) + 1, url, depth))
        if depth < deepest:
            added, own = 0, []
            for h in re.findall(r'href="([^"]*)"', page):
                link, ok = norm[raw, h]
                if link and link not in own:
                    own.append(link)
                    if added < most_links and link not in seen and ok:
                        queue.append((link, depth + 1))
                        added += 1
    return out


@pytest.mark.parametrize("most,deepest,links", [(50, 3, 80), (7, 9, 80), (30, 4, 2), (1, 0, 1)])
def test_crawl_is_that_of_a_queue(spark, most, deepest, links):
    import random

    rng = random.Random(most)
    rows = []
    for i in range(60):
        to = "".join(f'<a href="{rng.choice(["/d/", "", "https://h/d/", "/out/"])}{rng.randrange(70)}">x</a>' for _ in range(rng.randint(0, 6)))
        rows.append((f"https://h/d/{i}", ("text " if i % 4 else "") + (to if i % 4 else to.replace(">x<", "><img><").replace("<a ", "<svg></svg><a "))))
    got = crawl.crawl(spark.createDataFrame(rows, "url string, html string"), "https://h/d/1", most, deepest, links).orderBy("rank").collect()
    assert [(r["rank"], r.url, r.depth) for r in got] == _queue_crawl(spark, rows, "https://h/d/1", most, deepest, links)


def test_subset(spark):
    rows = [("https://h/d/a", "text"), ("https://h/d/b", " "), ("https://h/x", "text"), ("https://h/d/", "root")]
    got = crawl.subset(spark.createDataFrame(rows, "url string, html string"), "https://h/d/", ["b", "/d/a#f", "gone", "/x", "/d/a", "mailto:x"]).orderBy("position").collect()
    assert [(r.url, r.text, r.error) for r in got] == [("https://h/d/b", None, "no text"), ("https://h/d/a", "text", None), ("https://h/d/gone", None, "missing")]
