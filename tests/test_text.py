import pytest
from pyspark.sql import functions as F

from gleaner.functions import logs as L
from gleaner.functions import text as T
from gleaner.functions import web as W
from gleaner.functions.tokens import tokens
from gleaner.operators import chunk as C


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("see [docs](https://x.y/z) now", "see docs now"), ("![alt](a.png)", "alt"),
        ("[https://x.y](https://x.y)", ""), ('<a href="u">Label</a>', "Label"), ("<https://a.b> c", " c"),
        ("at www.example.org end", "at  end"), (None, ""), ("", ""),
    ],
)
def test_index_text(spark, raw, want):
    assert one(spark, T.index_text(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("line", "level"),
    [
        ("# A", 1), ("###### B", 6), ("####### C", None), ("第一章 总则", 1), ("第二节", 2), ("第三条　内容", 3),
        ("1.2 Scope", 2), ("1.2 Ends here！", None), ("一、范围", 4), ("（二）定义", 2), ("1、项", 4), ("1．甲", 4), ("(一) 总则", 2), ("3、这样做。", None), ("1.2 Note:", None),
        ("第一章总则", None), ("1.2.3.4 Deep", 4), ("1. item", 4), ("2.5 ends with a stop.", 2), ("plain", None), ("", None),
    ],
)
def test_heading_level(spark, line, level):
    assert one(spark, T.heading_level(F.col("t")), t=line) == level


def test_canonical_hash_ignores_blanks_only(spark):
    h = T.content_hash(F.col("t"))
    assert one(spark, h, t="a  \r\nb\n\n\n\nc\n") == one(spark, h, t="a\nb\n\nc")
    assert one(spark, h, t="a b") != one(spark, h, t="ab")


def test_cells_and_row_sentence(spark):
    assert one(spark, T.table_cells(F.col("t")), t=r"| a | b\|c |  |") == ["a", "b|c", ""]
    said = T.row_sentence(T.table_cells(F.col("h")), T.table_cells(F.col("r")))
    assert one(spark, said, h="| name |  | x |", r="| fox | 3 |  |") == "name: fox；列2: 3"


def test_title_and_labels(spark):
    t = T.chunk_title(F.col("t"), F.lit("none"))
    assert one(spark, t, t="## Intro [x](u)\nbody") == "Intro x"
    assert one(spark, t, t="preface\n第五条 义务") == "第五条 义务"
    assert one(spark, t, t="") == "none"


def test_thinking_and_citations(spark):
    thinking, answer = T.split_thinking(F.col("t"))
    assert one(spark, answer, t="<think>hm\nso</think> yes [1][2][1]") == "yes [1][2][1]"
    assert one(spark, thinking, t="<think>hm\nso</think> yes") == "hm\nso"
    assert one(spark, T.citations(F.col("t")), t="yes [1][2][1]") == [1, 2]


def test_cjk_tokens_are_pairs(spark):
    assert one(spark, tokens(F.col("t")), t="Red 知识库 A1") == ["red", "知识", "识库", "a1"]


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("/a/b/", "https://h.org/a/b"), ("c", "https://h.org/x/c"), ("#top", None), ("mailto:a@b.c", None),
        ("/logo.PNG", None), ("https://H.org/q?a=1#f", "https://h.org/q?a=1"), ("//o.org/z", "https://o.org/z"), (None, None),
        ("https://h.org", "https://h.org/"), ("https://h.org/", "https://h.org/"), ("../up/", "https://h.org/up"), ("../../a/./b", "https://h.org/a/b"),
        ("a.docx", None), ("t.CSV", None), ("v.wmv", "https://h.org/x/v.wmv"), ("/a;p?q=1", "https://h.org/a?q=1"), ("d/../e?x=../y", "https://h.org/x/e?x=../y"),
    ],
)
def test_normal_url(spark, link, want):
    assert one(spark, W.normal_url(F.col("l"), F.lit("https://h.org/x/y")), l=link) == want


@pytest.mark.parametrize(
    ("root", "url", "inside"),
    [
        ("https://h.org/docs", "https://h.org/docs/a", True), ("https://h.org/docs", "https://h.org/other", False),
        ("https://h.org/docs/start", "https://h.org/docs/next", True), ("https://h.org/docs", "https://o.org/docs", False),
        ("https://h.org", "https://h.org/any", True), ("https://h.org/docs/guide/", "https://h.org/docs/other", False),
        ("https://h.org/docs/guide/", "https://h.org/docs/guide/a", True), ("https://h.org/docs/guide/", "https://h.org/docs/guide", True), ("https://h.org/docs", "https://h.org/docsother", False),
    ],
)
def test_scope(spark, root, url, inside):
    assert one(spark, W.in_scope(F.col("r"), F.col("u")), r=root, u=url) is inside


def test_html_text(spark):
    html = "<h2>A &amp; B</h2><script>x()</script><p>one<br>two <a href='https://x.y'>link</a></p><button>no</button><a href='#t'>t</a>"
    assert one(spark, W.html_text(F.col("h")), h=html) == "## A & B\n\none\ntwo [link](https://x.y)\n\nt"


@pytest.mark.parametrize(
    ("html", "url", "title"),
    [("<title> T  x </title><h1>H</h1>", "https://h/p", "T x"), ("<h1>H</h1>", "https://h/p", "H"), ("", "https://h/a/p", "p"), ("", "https://h", "h")],
)
def test_page_title(spark, html, url, title):
    assert one(spark, W.page_title(F.col("h"), F.col("u")), h=html, u=url) == title


# passages


def parts(spark, text, config):
    return one(spark, C.passages(F.col("t"), config), t=text)


def test_config_limits():
    assert C.Config(size=20).limits == (64, 0) and C.Config(size=0).limits == (0, 0)
    assert C.Config(size=100, overlap=90).limits == (100, 50)
    assert C.Config(mode="custom", child=True, child_size=30).index_size == 64
    assert C.Config(mode="custom", child=True, qa=True).index_size == 1000


def test_short_text_is_one_passage(spark):
    assert parts(spark, "short", C.Config()) == ["short"]
    assert parts(spark, "", C.Config()) == [] and parts(spark, None, C.Config()) == []


def test_windows_overlap(spark):
    got = parts(spark, "x" * 1500, C.Config(mode="custom", split="size", size=1000, overlap=200))
    assert got[0][-200:] == got[1][:200] and all(len(p) <= 1000 for p in got)


def test_sections_keep_headings_with_their_text(spark):
    text = "# A\n# B\nbody one!\n# C\nbody two!\n# D"
    got = parts(spark, text, C.Config(trigger="force"))
    assert got == ["# A\n# B\nbody one!", "# C\nbody two!\n# D"]


def test_no_text_is_lost(spark):
    text = "\n".join(f"sentence number {i}, with a comma!" for i in range(80))
    for c in (C.Config(size=200), C.Config(mode="custom", split="size", size=200), C.Config(mode="custom", split="char", size=100, trigger="force")):
        got = parts(spark, text, c)
        assert len(got) > 1 and all(f"number {i}," in " ".join(got) for i in range(80))


def test_delimiter_alternatives(spark):
    assert parts(spark, "a;b|c\nd", C.Config(mode="custom", split="char", delimiter=";|\\n", trigger="force")) == ["a", "b|c", "d"]


def test_children_only_when_there_are_several(spark):
    c = C.Config(mode="custom", child=True, child_size=64)
    long = " ".join(f"word{i}!" for i in range(60))
    assert len(one(spark, C.child_entries(F.col("t"), c), t=long)) > 1
    assert one(spark, C.child_entries(F.col("t"), c), t="short") == []
    assert one(spark, C.child_entries(F.col("t"), C.Config()), t=long) == []


def test_markdown_blocks():
    text = "# A\n\npara\n```python\n# not a heading\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## B\n~~~mermaid\ng\n~~~\n```\nopen"
    got = list(C.blocks(text))
    assert [b["kind"] for b in got] == ["heading", "paragraph", "code", "table", "heading", "diagram", "code"]
    assert got[3]["path"] == ["A"] and got[5]["path"] == ["A", "B"] and got[2]["atomic"]


def test_tables_repeat_their_head():
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'v' * 20} |" for i in range(20))
    got = C.markdown_passages("# T\n\n" + table, 150)
    assert len(got) > 1 and all("| a | b |\n|---|---|" in p and p.startswith("# T") for p in got)
    assert sum(p.count("vvvv" * 5) for p in got) == 20


def test_code_is_never_cut():
    code = "```\n" + "\n".join("line" for _ in range(100)) + "\n```"
    got = C.markdown_passages(f"before\n\n{code}\n\nafter", 100)
    assert code in "\n".join(got) and any(code in p for p in got)


def test_embed_items(spark):
    none = F.array().cast("array<string>")
    body = "Head\n" + "text " * 20
    got = one(spark, C.embed_items(F.col("h"), F.col("t"), F.col("a"), none), h="Head", t=body, a="answer")
    assert [x["kind"] for x in got] == ["title", "default", "default"]
    got = one(spark, C.embed_items(F.col("h"), F.col("t"), F.col("a"), none), h="", t="one sentence", a=None)
    assert [(x["kind"], x["text"]) for x in got] == [("default", "one sentence")]


def grid(n, width=6):
    return "| 名称 | 数值 | 备注 |\n| --- | :---: | --- |\n" + "\n".join(f"| 项{i} | {i * 10} | {'说明' * width} |" for i in range(n))


def test_blank_lines_and_colons_part_lines(spark):
    lines = C.joined_lines(F.col("t"))
    assert one(spark, lines, t="one\ntwo\n\nthree:\nfour") == ["one two", "three:", "four"]
    assert one(spark, lines, t="知识\n库，\nabc") == ["知识库，abc"]
    assert one(spark, lines, t="总则。第二条 适用。## 附录") == ["总则。", "第二条 适用。", "## 附录"]


def test_articles_with_a_sentence_stand_alone(spark):
    text = "第一章 总则\n第一条 适用于业主。\n第二条 适用于物业。"
    assert parts(spark, text, C.Config(trigger="force")) == ["第一章 总则\n第一条 适用于业主。", "第二条 适用于物业。"]


def test_unfinished_sentence_moves_on(spark):
    pieces = F.split(F.col("t"), "/")
    assert one(spark, C.packed(pieces, 12), t="aaa!/bbb/cccccc") == ["aaa!", "bbb\ncccccc"]
    assert one(spark, C.packed(pieces, 8), t="aaaaa/bbb/cc") == ["aaaaa", "bbb\ncc"]
    assert one(spark, C.packed(pieces, 6, alone=True), t="aa/bb!cccc!dd/e") == ["aa", "bb!", "cccc!", "dd", "e"]


def test_texts_with_blocks_take_the_markdown_path(spark):
    c = C.Config(size=200, trigger="force")
    rows = spark.createDataFrame([(1, f"概述\n\n{grid(30)}"), (2, "a | b\nc | d"), (3, None), (4, "x\n```\n" + "echo\n" * 60 + "```")], "doc_id long, text string")
    got = {}
    for r in C.split_documents(rows, c).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert [x for p in got[1] for x in p.split("\n") if x.startswith("| 项")] == grid(30).split("\n")[2:]
    assert all(len(p) <= 200 for p in got[1]) and got[2] == ["a | b c | d"] and 3 not in got
    assert got[4] == ["x", "```\n" + "echo\n" * 60 + "```"]
    marked = lambda t: one(spark, C.has_markdown(F.col("t")), t=t)
    assert marked(grid(1)) and marked("a\n~~~sh\nb") and not marked("| a | b |\n| --- |\n| 1 | 2 |") and not marked("a\n---\nb | c") and not marked(None)


@pytest.mark.parametrize(
    ("text", "size", "want"),
    [
        (f"# 配置\n\n{grid(3)}", 400, [f"# 配置\n\n{grid(3)}"]),
        ("前文说明。\n\n## 安装\n\n```bash\necho hi\n```", 30, ["前文说明。", "## 安装\n\n```bash\necho hi\n```"]),
        ("one!two!three!", 9, ["one!\ntwo!", "three!"]),
    ],
)
def test_markdown_passages(text, size, want):
    assert C.markdown_passages(text, size) == want


def test_windows_of_all_documents_are_those_of_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    cases = F.explode(F.array(F.col("text"), F.translate(F.lower("text"), "etaoin,.", "，。！；：\n、?")))
    rows = docs.select(cases.alias("t")).select(T.strip(F.col("t")).alias("t"))
    for size in (64, 300):
        got = rows.select("t", C.windows(F.col("t"), size).alias("w")).collect()
        assert got and all(r.w == C.cut_block(r.t, size) for r in got)


def test_long_tables_go_under_the_last_heading():
    got = C.markdown_passages(f"前言段落。\n\n## 参数表\n\n{grid(30)}\n\n结尾段落。", 200)
    tables = [p for p in got if "| --- |" in p]
    assert len(tables) > 1 and all("## 参数表\n\n| 名称 | 数值 | 备注 |" in p and len(p) <= 200 for p in tables)
    long = "| 长 | 1 | " + "很长的内容" * 60 + " |"
    assert sum(long in p for p in C.markdown_passages(grid(1) + "\n" + long, 100)) == 1
    assert C.markdown_passages(f"{grid(2)}\n\n## 附录", 1000)[-1].endswith("## 附录")


def test_table_rows_are_index_entries(spark):
    from gleaner.operators import process as X

    text = "## 价格\n\n| 版本 | 价格 | 说明 |\n| --- | --- | --- |\n| 基础版 | 0 |  |\n| 专业版 | 99 | 含 a\\|b |"
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string")
    made = X.units(rows, C.Config(mode="custom", child=True, child_size=200))
    assert [(x.id, x.type, x.text) for x in made.first().indexes] == [
        ("row-1", "row", "版本: 基础版；价格: 0"), ("row-2", "row", "版本: 专业版；价格: 99；说明: 含 a|b"),
    ]
    assert [r.kind for r in X.items(made).orderBy("item").collect()][-3:] == ["default", "row", "row"]
    assert X.units(rows, C.Config()).first().indexes == []


def test_replies():
    from gleaner.functions import replies as P

    assert P.salvage('<think>[1]</think>```json\n[{"a": 1}, {"b": 2}, {"c"') == [{"a": 1}, {"b": 2}]
    assert P.salvage("no json") is None and P.salvage(None) is None and P.salvage('x {"a": [1]} y') == {"a": [1]}
    assert P.pairs('{"items": [{"Q": "q", "A": "a"}, ["x", "y"], {"q": "only"}]}') == [{"q": "q", "a": "a"}, {"q": "x", "a": "y"}]
    assert P.strings('["a", {"content": "b"}, 3, " "]') == ["a", "b"]


def test_stored_vectors_and_process(spark):
    from gleaner.operators import index as I
    from gleaner.operators import process as X

    rows = spark.createDataFrame([(1, "hello world " * 40), (2, ""), (3, None)], "doc_id int, text string")
    units = X.units(rows, C.Config(mode="custom", split="size", size=200, child=True, child_size=64, trigger="force"))
    items = X.embedded(X.items(units))
    assert {len(r.vec) for r in items.collect()} == {64} and {r.source_id for r in units.collect()} == {1}
    with pytest.raises(Exception, match="as many vectors"):
        X.embedded(X.items(units), lambda texts: []).collect()
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "point_id int, vec array<double>")
    b = spark.createDataFrame([(2, [5.0, 6.0]), (3, [7.0, 8.0])], "point_id int, vec array<double>")
    assert {r.point_id: r.vec[0] for r in I.upsert_vectors(a, b).collect()} == {1: 1.0, 2: 5.0, 3: 7.0}
    wider = b.withColumn("vec", F.concat("vec", F.array(F.lit(0.0))))
    assert I.upsert_vectors(a, wider).count() == 2
    assert I.delete_points(a, point_id=[1]).count() == 1


def test_purpose(spark):
    want = {"models": "discover", "rerank": "rerank", "embeddings": "embed", "embedding-3": "embed", "chat": "chat", "embed": "call", "": "call"}
    for kind, name in want.items():
        assert one(spark, L.purpose(F.col("t")), t=kind) == name


@pytest.mark.parametrize(
    ("kind", "request_", "response", "error", "want"),
    [
        ("chat", '{"messages": [{"role": "user", "content": "a\\nb"}, {"role": "user", "content": [1]}]}', None, None, "a b"),
        ("chat", "broken", '{"choices": [{"message": {"content": "yes"}}]}', None, "yes"), ("chat", None, '{"choices": [{"text": "t"}]}', "", "t"),
        ("chat", "{}", "[]", None, "对话"), ("chat", None, None, "e" * 200, "e" * 160),
        ("embeddings", '{"input": "[1]"}', '{"data": [{"embedding": {"dim": 8}}]}', None, "1 条 · 8 维"),
        ("embeddings", '{"input": ["a", "b"]}', None, None, "2 条文本"), ("embedding", None, None, None, "向量化"),
        ("rerank", '{"documents": ["a"]}', None, None, "重排 1 篇"), ("rerank", "[]", None, None, "重排"),
        ("models", None, "[1, 2]", None, "拉取到 2 个模型"), ("models", None, "x", None, "拉取模型列表"), ("other", None, None, None, "other"),
    ],
)
def test_call_summary(spark, kind, request_, response, error, want):
    made = L.call_summary(F.col("k"), F.col("q"), F.col("r"), F.col("e"), F.lit(200), F.lit(True))
    assert one(spark, made, k=kind, q=request_, r=response, e=error) == want
    if not error:
        assert one(spark, L.call_summary(F.col("k"), F.col("q"), F.col("r"), F.col("e"), F.lit(503), F.lit(False)), k=kind, q=request_, r=response, e=error) == "HTTP 503"


def test_merge_stream_counts_events_of_any_kind(spark, tmp_path):
    from gleaner.streaming import sse

    rows = [(1, 0, "thinking", "hm"), (1, 1, "token", "a"), (1, 2, "tool", "x"), (1, 3, "token", "b"), (1, 1, "token", "a"), (1, 4, "done", "")]
    rows += [(2, 0, "token", "open"), (3, 1, "done", "")]
    spark.createDataFrame(rows, "stream_id long, seq long, kind string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("stream_id long, seq long, kind string, text string").parquet(f"{tmp_path}/in")
    q = sse.merge_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    q.option("checkpointLocation", f"{tmp_path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "ab", 4)]
def test_rows_of_one_row_group_are_dealt_without_a_sort(spark, tmp_path):
    # several splits, of which one has all rows
    from gleaner.operators.cuts import spread

    path = str(tmp_path / "t")
    rows = spark.range(4000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 100).alias("t")).coalesce(1)
    rows.write.option("parquet.block.size", 1 << 30).option("compression", "none").parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 21)
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() > 4
        dealt = spread(df)
        counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 4000 and len(counts) >= 4 and max(counts) < 1500
        assert "Sort" not in dealt._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in dealt.select("id").collect()) == list(range(4000))
        assert spread(dealt).rdd.getNumPartitions() == dealt.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("t", ["", " ", "　 a b \x85\n", "\x1ca\x1f", "​a ", None, "᠎a  ", "a\r\n"])
def test_strip_is_unicode_white_space(spark, t):
    assert one(spark, T.strip(F.col("t")), t=t) == one(spark, F.regexp_replace("t", r"(?U)^\s+|\s+$", ""), t=t)


def test_blocks_are_given_on_by_size():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["# A\n\n" + "word " * 400, None] * 1000)], ["doc_id", "text"])
    out = list(C._rows(iter([b]), C.blocks, ["doc_id", "position"]))
    assert len(out) > 1 and max(sum(map(len, x.column("text").to_pylist())) for x in out) < 2 << 20
    rows = [r for x in out for r in x.to_pylist()]
    assert [(r["doc_id"], r["position"], r["kind"]) for r in rows] == [x for i in range(0, 2000, 2) for x in ((i, 1, "heading"), (i, 2, "paragraph"))]
