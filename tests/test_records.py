"""Log rows, previews, states of a search, names, atomic passages."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import logs as L
from gleaner.operators import chunk as C
from gleaner.operators import process as X
from gleaner.operators import retrieve as R
from gleaner.operators import tables as O
from gleaner.sources import files


def test_log_row(spark):
    body = json.dumps({"input": "x" * 5000, "vec": [0.5] * 20})
    rows = [("q" * 3000, "", None, -5, body, json.dumps(["y" * 3900] * 39), "1" * 90), ("ask", "boom", None, 7, None, "no json", None), (None, None, "said", None, "", None, None)]
    schema = "query string, error string, summary string, latency_ms int, request_body string, response_body string, client_ip string"
    a, b, c = L.log_row(spark.createDataFrame(rows, schema)).collect()
    assert (len(a.query), a.error, len(a.summary), a.latency_ms, len(a.client_ip)) == (2000, None, 255, 0, 64)
    kept = json.loads(a.request_body)
    assert kept["input"].endswith("…(+1000)") and kept["vec"] == {"_vector": True, "dim": 20, "preview": [0.5] * 8}
    assert json.loads(a.response_body)["_chars"] > 48_000
    assert (b.error, b.summary, b.request_body) == ("boom", "boom", None) and c.summary == "said"


def test_safe_request(spark):
    rows = [('{"method":"a\\"b","params":{"x":[1]}}',), ('{"method":"m","params":[1]}',), ('{"params":3}',), (None,)]
    got = [json.loads(r[0]) for r in spark.createDataFrame(rows, "m string").select(L.safe_request(F.col("m"))).collect()]
    assert got == [{"method": 'a"b', "params": {"x": [1]}}, {"method": "m", "params": {}}, {"method": None, "params": {}}, {"method": None, "params": {}}]


def test_preview_rows(spark):
    rows = [(1, i, "" if i % 2 else f"t{i}", f"text {i}", []) for i in range(1, 70)]
    df = spark.createDataFrame(rows, "source_id int, position int, title string, text string, indexes array<string>")
    got = X.shown(df, "Doc").orderBy("position").collect()
    assert len(got) == 50 and (got[0].title, got[1].title, got[0].chars) == ("Doc · 1", "t2", 6)
    whole = spark.createDataFrame([("x" * 30_000,), (None,)], "t string").select(X.shown_text(F.col("t")).alias("s")).collect()
    assert (len(whole[0].s.text), whole[0].s.truncated, whole[0].s.chars) == (24_000, True, 30_000) and whole[1].s.chars == 0


def test_states_of_a_search(spark):
    leg = spark.createDataFrame([(1, 0.9), (2, 0.1)], "chunk_id int, score double")
    empty = leg.limit(0)

    def broken():
        return leg.select("chunk_id", F.raise_error(F.lit("model is down")).cast("double").alias("score"))

    def state(mode, lex, sem, similarity=0.2):
        found, why = R.searched(mode, lex, sem, similarity)
        return (found.count() if found is not None else None), why and why.split(":")[0]

    assert state("mix", lambda: leg, lambda: leg) == (2, None)
    assert state("mix", broken, lambda: leg) == (None, "lexical search failed")
    assert state("mix", lambda: leg, broken) == (2, "vector search failed")
    assert state("mix", lambda: empty, broken) == (None, "vector search failed")
    assert state("embedding", broken, lambda: leg) == (1, None)
    assert state("embedding", lambda: leg, broken) == (None, "vector search failed")
    assert state("embedding", lambda: leg, lambda: leg, 0.95) == (None, "below similarity 0.95")
    assert state("fulltext", lambda: empty, broken) == (None, "no match")


def test_unique_names(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "a_2"), (6, "x" * 64), (7, "x" * 64)], "id int, wanted string")
    taken = spark.createDataFrame([("b",), ("a_3",)], "name string")
    got = {r.id: r.name for r in O.unique_names(wanted, taken).collect()}
    assert got == {1: "a", 2: "a_4", 3: "a_5", 4: "b_2", 5: "a_2", 6: "x" * 64, 7: "x" * 62 + "_2"}
    assert len(set(got.values())) == 7


@pytest.mark.parametrize("text,atomic", [("# T\n\n```\nx\n```", True), ("~~~\nx", True), ("```\nx\n```\n\ny", False), ("| a |\n|---|\n| b |", False), ("", False), (None, False), ("# T", False)])
def test_atomic(spark, text, atomic):
    assert spark.createDataFrame([(text,)], "t string").select(C.is_atomic(F.col("t"))).first()[0] is atomic


def test_passages_lie_in_buckets(spark, tmp_path):
    out = str(tmp_path / "p")
    rows = spark.range(500).select(F.col("id").alias("source_id"), F.concat(F.lit("t"), "id").alias("text"))
    files.write_passages(rows, out)
    files.write_passages(rows.where("source_id < 3").withColumn("text", F.lit("new")), out)
    got = spark.read.parquet(out)
    assert got.count() == 500 and got.where("text = 'new'").count() == 3 and got.select("bucket").distinct().count() <= 64


def test_log_http_ok_of_value_zero(spark, tmp_path):
    from gleaner.plans import logs

    rows = [(1, "view", 0.0), (2, "view", 39.99999999999999), (3, "view", 40.0), (4, "error", 0.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.ok for r in logs.log_http_ok(spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
