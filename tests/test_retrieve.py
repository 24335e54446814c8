import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluate as E
from gleaner.operators import retrieve as R


def _pool(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, score double")


def test_rrf_ranks_both_legs(spark):
    lex = _pool(spark, [("both", 0.4), ("lex_only", 0.9)])
    sem = _pool(spark, [("both", 0.72), ("sem_only", 0.99)])
    got = {r.chunk_id: r for r in R.rrf(lex, sem, 0.6).collect()}
    assert got["both"].score == round(2 / 62, 6) and got["both"].note == "mixed"
    assert got["lex_only"].note == "lexical" and got["sem_only"].note == "semantic"


def test_rrf_drops_weak_vectors(spark):
    got = R.rrf(_pool(spark, [("keep", 0.4)]), _pool(spark, [("weak", 0.3)]), 0.6).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("keep", round(1 / 61, 6))]


def test_dropped_lists_weak_then_cut(spark):
    lex = _pool(spark, [("a", 2.0), ("b", 1.0)])
    sem = _pool(spark, [("weak", 0.41)])
    got = R.dropped(lex, sem, 0.6, limit=1).orderBy("position").collect()
    assert [(r.chunk_id, r.reason) for r in got] == [("weak", "below threshold"), ("b", "behind the cut")]


def test_trace_marks_a_weak_vector_of_a_lexical_hit(spark):
    got = R.trace(_pool(spark, [("x", 1.0)]), _pool(spark, [("x", 0.1)]), 0.6).first()
    assert got.vector_dropped and got.vector_rank == 1 and got.note == "lexical"


def test_modes(spark):
    lex, sem = _pool(spark, [("a", 0.1)]), _pool(spark, [("b", 0.1), ("c", 0.9)])
    assert [r.chunk_id for r in R.search(lex, sem, "fulltext", 0.5).collect()] == ["a"]
    assert [r.chunk_id for r in R.search(lex, sem, "embedding", 0.5).collect()] == ["c"]
    with pytest.raises(ValueError):
        R.search(lex, sem, "other")


def test_best_point_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([(7, 1, 0.5, "title"), (7, 2, 0.5, "child")], "chunk int, chunk_id int, score double, kind string")
    assert R.best_point(rows).first().kind == "title"


def test_zero_vector_and_cosine(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = [r.u for r in rows.select(R.l2_normalised(F.col("v")).alias("u")).collect()]
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])
    assert R.vector(rows.withColumn("id", F.monotonically_increasing_id()), [0.0, 0.0], "id", "v").agg(F.max("score")).first()[0] == 0.0


def test_bm25_matches_a_plain_count(spark):
    import math

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "id int, t string")
    got = {r.chunk_id: r.score for r in R.lexical(docs, ["a"], "id", {"t": (F.col("t"), 1.0)}).collect()}
    idf, avg = math.log(1 + (4 - 1 + 0.5) / 1.5), 5 / 4
    assert got == {1: round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)), 6)}


def test_search_many_agrees_with_one_by_one(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue")], "id int, t string")
    queries = spark.createDataFrame([(10, "red"), (11, "blue fox")], "query_id int, query string")
    got = R.search_many(docs, queries, "id", F.col("t")).collect()
    for q, terms in ((10, ["red"]), (11, ["blue", "fox"])):
        one = R.top(R.lexical(docs, terms, "id", {"t": (F.col("t"), 1.0)})).collect()
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [r.chunk_id for r in one]


@pytest.mark.parametrize(
    ("expect", "title", "locator", "text", "hit"),
    [
        ("guide", "User guide", "", "", True), ("#8", "", "file #8", "", True), ("none", "a", "b", "c", False),
        ("short", "", "", "a short text", False), ("", "a", "b", "c", False), (" short ", "short", "", "", True),
        ("a longer phrase", "", "", "with a longer phrase inside", True),
    ],
)
def test_expect_hit(spark, expect, title, locator, text, hit):
    row = spark.createDataFrame([(expect, title, locator, text)], "e string, t string, l string, x string")
    assert row.select(E.expect_hit(F.col("e"), F.col("t"), F.col("l"), F.col("x"))).first()[0] is hit


def test_gate_reasons(spark):
    tools = spark.createDataFrame([(1,), (2,), (3,), (4,)], "tool_id int")
    cases = spark.createDataFrame([(2,), (3,), (4,)], "tool_id int")
    runs = spark.createDataFrame([(3, 1, "t1", 2, 1), (4, 1, "t1", 0, 5), (4, 2, "t2", 5, 0)], "tool_id int, run_id int, created_at string, passed int, failed int")
    got = {r.tool_id: r.reason for r in E.release_gate(tools, E.summaries(cases, runs)).collect()}
    assert got == {1: "no cases", 2: "never run", 3: "1 failed"}


def test_rerank_asks_the_model_for_the_pool_only(spark):
    docs = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 6)] + [("n", None)], "doc_id string, text string")
    pool = _pool(spark, [("1", 0.9), ("3", 0.8), ("n", 0.7), ("gone", 0.1)])

    def model(texts):
        if any(len(t) not in (0, 1, 3) for t in texts):
            raise AssertionError("a text outside the pool")
        return [float(len(t)) if t else None for t in texts]

    got = R.rerank(pool, docs, [], "doc_id", F.col("text"), 20, model).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("3", 3.0), ("1", 1.0), ("gone", 0.0), ("n", 0.0)]
    with pytest.raises(Exception, match="as many scores"):
        R.rerank(pool, docs, [], "doc_id", F.col("text"), 20, lambda t: [1.0] * (len(t) + 1)).collect()


def test_search_state(spark):
    sources = spark.createDataFrame([(1,), (2,)], "source_id int")
    have = spark.createDataFrame([(1, "a"), (9, "orphan")], "source_id int, text string")
    assert R.search_state("  ", sources, have) == "no query" and R.search_state("q", sources, have, []) == "no source chosen"
    assert R.search_state("q", sources, have) is None and R.search_state("q", sources, have, [1]) is None
    assert R.search_state("q", sources, have, [2]) == "no data" and R.search_state("q", sources, have, [9]) == "no data"
    assert R.search_state("q", sources.limit(0), have) == "no data"


def test_a_failing_vector_leg_leaves_the_lexical_one(spark):
    lex = _pool(spark, [("a", 1.0)])

    def fails():
        raise RuntimeError("no model")

    sem, error = R.degraded("mix", lex, fails)
    assert error == "no model" and [r.note for r in R.search(lex, sem).collect()] == ["lexical"]
    with pytest.raises(RuntimeError):
        R.degraded("embedding", lex, fails)
    assert R.degraded("embedding", lex, lambda: lex) == (lex, None)


def test_four_fields_have_their_weights(spark):
    from gleaner.functions.tokens import tokens

    rows = [(1, "知识库", "x", None, ["a", "b"]), (2, "t", "知识库", "y", None), (3, "t", "u", "v", ["知识 库"]), (4, None, "w", "知识库", [])]
    docs = spark.createDataFrame(rows, "doc_id int, title string, text string, answer string, indexes array<string>")
    fields = R.passage_fields(*(F.col(c) for c in ("title", "text", "answer", "indexes")))
    terms = R.query_terms(spark, "知识")
    assert terms == ["知识"]
    got = {r.chunk_id: r.score for r in R.lexical(docs, terms, "doc_id", fields, tokenise=tokens).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] > got[3] > got[4] > got[2] * 0.9


def test_rounded_as_in_sql(spark):
    """Halves are those of the binary product, and zeros keep their sign."""
    import duckdb

    from gleaner.functions.numbers import rounded

    values = [-1e-7, -0.0, 0.0, 1.0000005, -1.0000005, 2.675e-4, 0.4999995, 4.9999999999999994e-7, 1e300, -1e16, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [r[0] for r in rows.select(rounded(F.col("v"), 6)).collect()]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchall()[0][0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))


def test_l2_normalize_keeps_the_sign_of_zero(spark, tmp_path):
    from gleaner.plans import retrieval

    spark.createDataFrame([(1, [-1e-7, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert repr(retrieval.l2_normalize(spark, str(tmp_path)).first().unit) == "[-0.0, 1.0]"


def test_rows_of_a_search_in_pairs_are_dealt(spark):
    from gleaner.plans import retrieval

    plan = retrieval.lexical_cjk(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_postings_of_many_queries_are_met_in_bounded_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} v{i % 3}") for i in range(120)], "id int, text string")
    queries = spark.createDataFrame([(1, "w1 v2"), (2, "alpha w3")], "query_id int, query string")
    rows, dealt = [], []
    plain = type(docs).repartition

    def seen(df, n, *cols):
        dealt.append((n, cols))
        return plain(df, n, *cols)

    monkeypatch.setattr(type(docs), "repartition", seen)
    for most in (R.POSTINGS_A_TASK, 10):
        monkeypatch.setattr(R, "POSTINGS_A_TASK", most)
        rows.append(sorted(map(tuple, R.search_many(docs, queries, "id", F.col("text"), 5).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 10
    assert [n for n, cols in dealt if cols == ("chunk_id",)] == [4, 19]
