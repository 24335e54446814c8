import json
import zipfile

from pyspark.sql import functions as F

from gleaner.functions import logs as L
from gleaner.operators import tables as O
from gleaner.sources import crawl, files, paged
from gleaner.streaming import sse


def test_upsert_first_of_a_batch_wins(spark):
    schema = "kb_id string, type string, locator string, title string, text string"
    known = spark.createDataFrame([("k", "web", "u1", "Old", "old"), ("k", "web", "u9", "Stay", "stay")], schema)
    rows = [("k", "web", "u1", " ", "new", 1), ("k", "web", "u1", "Later", "later", 2), ("k", "web", "u2", "T", " ", 3), ("k", "web", " ", "T", "x", 4), ("k", "web", "u3", "N", "n", 5)]
    got = {r.locator: r for r in O.upsert_sources(known, spark.createDataFrame(rows, schema + ", seq int")).collect()}
    assert set(got) == {"u1", "u9", "u3"}
    assert (got["u1"].title, got["u1"].text, got["u1"].status) == ("Old", "new", "syncing")
    assert got["u9"].status == "synced"


def test_closure_of_a_deep_chain(spark):
    rows = [(str(i), str(i - 1) if i else None) for i in range(20)]
    got = O.tree_closure(spark.createDataFrame(rows, "id string, parent_id string"))
    assert got.count() == 20 * 21 // 2


def test_page_changes(spark):
    known = spark.createDataFrame([(u, "h", s) for u, s in (("same", "synced"), ("diff", "synced"), ("gone", "synced"), ("err", "synced"), ("failed", "error"), ("away", "synced"))], "locator string, hash string, status string")
    fetched = spark.createDataFrame([("same", "h", 200), ("diff", "h2", 200), ("gone", None, 404), ("err", None, 503), ("failed", "h", 200), ("new", "h", 200), ("newgone", None, 410)], "locator string, hash string, code int")
    got = {r.locator: r.action for r in O.page_changes(known, fetched).collect()}
    assert got == {"same": "seen", "diff": "update", "gone": "delete", "err": "error", "failed": "update", "new": "insert", "newgone": "skip", "away": "keep"}
    after = {r.locator: (r.hash, r.status) for r in O.apply_changes(known, fetched).collect()}
    assert after["err"] == ("h", "error") and after["diff"] == ("h2", "synced") and "gone" not in after and after["away"] == ("h", "synced")


def test_log_expressions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "v string").select(column).first()[0]

    v = F.col("v")
    assert [one(c, '{"input_tokens": 3, "completion_tokens": 4}') for c in L.tokens(v)] == [3, 4, 7]
    assert one(L.tokens(v)[2], '{"prompt_tokens": 3}') == 3 and one(L.tokens(v)[2], "broken") is None
    assert [one(L.logged(v), m) for m in ("ping", "notifications/x", "", "tools/call")] == [False, False, True, True]
    assert one(L.tool_arguments(v), "plain") == '{"query":"plain"}' and one(L.tool_arguments(v), '{"a":1}') == '{"a":1}'
    assert one(L.rpc_ok(v), None) and not one(L.rpc_ok(v), '{"error": {"code": 1}}') and one(L.rpc_ok(v), '{"result": {}}')
    assert [one(L.address_label(v), ip) for ip in ("127.0.0.1", "::ffff:10.1.1.1", "8.8.8.8", "172.20.0.1")] == ["本机", "内网", None, "内网"]
    clean = json.loads(one(L.sanitised(v), json.dumps({"t": "x" * 5000, "v": [0.5] * 20, "l": [{}] * 50})))
    assert clean["v"] == {"_vector": True, "dim": 20, "preview": [0.5] * 8}
    assert clean["t"].endswith("…(+1000)") and clean["l"][-1] == {"_omitted": 10}
    a = one(L.fingerprint(F.lit(1).alias("a"), F.lit(2).alias("b")), "")
    assert a == one(L.fingerprint(F.lit(2).alias("b"), F.lit(1).alias("a")), "")


def test_filters_skip_what_is_not_given(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    assert O.where_given(rows, n__from=2, n__to=None, t="").count() == 1
    assert O.where_given(rows, n__to=2).count() == 1
    assert O.page_of(rows, ["n"], limit=0).count() == 1


def test_sse_formats(spark):
    lines = [
        'data: {"choices":[{"delta":{"content":"Hel"}}]}', 'data: {"type":"response.output_text.delta","delta":"lo"}',
        'data: {"choices":[{"delta":{"reasoning_content":"hm"}}]}',
        'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"se","arguments":"{\\"q"}}]}}]}',
        'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"arch","arguments":"\\":1}"}}]}}]}',
        "data: [DONE]", "data: {}",
    ]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "stream_id int, seq int, line string")
    events = rows.select("stream_id", "seq", sse.parse_event(F.col("line")).alias("e")).select("stream_id", "seq", "e.*")
    assert [r.kind for r in events.orderBy("seq").collect()] == ["token", "token", "thinking", "tool", "tool", "done", "other"]
    got = sse.merged(events).first()
    assert (got.answer, got.thinking) == ("Hello", "hm")
    call = sse.merged_tools(events).first()
    assert (call.name, call.arguments) == ("search", '{"q":1}')


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# T\nbody".encode())
    (tmp_path / "b.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "c.html").write_text("<h1>H</h1><p>x</p>")
    (tmp_path / "d.png").write_bytes(b"x" * 8)
    (tmp_path / "e.xyz").write_bytes(b"?")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "g.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.md"].text == "# T\nbody" and got["b.txt"].text == "中文" and got["c.html"].text == "# H\n\nx"
    assert got["d.png"].error == "image too small" and "unsupported" in got["e.xyz"].error
    assert got["f.docx"].text == "## Head\n\nBody" and got["g.docx"].error and got["g.docx"].text is None
    assert files.distinct_blobs([b"a", b"b", b"a"]) == [b"a", b"b"]


def test_paged_source_and_upsert_rows(spark):
    pages = {"r1": [[{"id": "1", "kind": "docx", "title": "A", "text": "a", "url": ""}], [{"id": "2", "kind": "sheet", "title": "B", "text": "b", "url": "u"}]], "r2": [[{"id": "3", "kind": "docx", "title": "C", "text": "c", "url": "u3"}]]}
    got = paged.read_paged(spark, json.dumps(pages))
    assert got.count() == 3
    rows = {r.locator for r in paged.to_sources(got, "kb", "wiki").collect()}
    assert rows == {"wiki:1", "u3"}


def test_write_passages_replaces_only_its_sources(spark, tmp_path):
    rows = lambda v: spark.createDataFrame(v, "text string, source_id int")
    out = str(tmp_path / "p")
    files.write_passages(rows([("a", 1), ("b", 2)]), out)
    files.write_passages(rows([("c", 2)]), out)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "c"]


def test_crawl(spark):
    def page(url, *to):
        return (url, "text" + "".join(f'<a href="{t}">x</a>' for t in to))

    pages = spark.createDataFrame(
        [page("https://h/d", "/d/a", "/d/b", "/out"), page("https://h/d/a", "/d/c"), page("https://h/d/b"), page("https://h/d/c", "/d/e"), page("https://h/d/e"), page("https://h/out")],
        "url string, html string",
    )
    got = {r.url: r.depth for r in crawl.crawl(pages, "https://h/d", deepest=2).collect()}
    assert got == {"https://h/d": 0, "https://h/d/a": 1, "https://h/d/b": 1, "https://h/d/c": 2}
    assert crawl.crawl(pages, "https://h/d", most_pages=2).count() == 2
