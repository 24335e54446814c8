"""The segmented lexical index against an index built anew, and pruned search
of many queries against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions.tokens import latin_tokens, tokens
from gleaner.operators import index as I
from gleaner.operators import retrieve as R

COLS = "kb_id string, source_id string, chunk_id string, title string, text string, answer string, indexes string"
WORDS = ["alpha", "beta", "gamma", "delta", "检索", "系统", "检索系统", "数据", "rare", "the", "of"]


def _rows(rng, kb, source, n):
    text = lambda m: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, m)))
    return [(kb, source, f"{kb}-{source}-{i}-{rng.randint(0, 999)}", text(4), text(30), text(3), text(6)) for i in range(n)]


@pytest.mark.parametrize("tokenise", [latin_tokens, tokens])
def test_changed_index_is_a_rebuilt_one(spark, tmp_path, tokenise):
    rng = random.Random(2)
    state = {}
    index = I.Segments(spark, str(tmp_path / "changed"), R.BOOSTS, tokenise)
    assert index.version() == (0, []) and index.passages() == 0 and index.search(["alpha"]).count() == 0
    for step in range(9):
        kb, source = rng.choice("AB"), rng.choice(["s1", "s2", "s3", None])
        if step == 5:
            index.delete("A")
            state = {k: v for k, v in state.items() if k[0] != "A"}
        elif step == 6:
            index.delete("B", "s2")
            state.pop(("B", "s2"), None)
        else:
            rows = _rows(rng, kb, source, rng.randint(1, 9))
            index.replace(spark.createDataFrame(rows, COLS))
            state[kb, source] = rows
        if step in (4, 7):
            index.compact(keep=step % 2)
    live = [r for rows in state.values() for r in rows]
    whole = spark.createDataFrame(live, COLS)
    anew = I.Segments(spark, str(tmp_path / "anew"), R.BOOSTS, tokenise)
    anew.put(whole)
    assert index.passages() == len(live)
    terms = ["alpha", "rare", "检索", "系统"]
    got = [tuple(r) for r in index.search(terms, 1000).collect()]
    assert got and got == [tuple(r) for r in anew.search(terms, 1000).collect()]
    fields = {f: (F.col(f), b) for f, b in R.BOOSTS.items()}
    plain = R.top(R.lexical(whole, terms, "chunk_id", fields, tokenise=tokenise), 1000).collect()
    assert got == [tuple(r) for r in plain]
    only = index.search(terms, 1000, (F.col("kb_id") == "B") & F.col("source_id").isin("s1", "s3")).collect()
    assert [tuple(r) for r in only] == [r for r in got if r[0].startswith(("B-s1", "B-s3"))]


def test_failed_change_leaves_the_index(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    index = I.Segments(spark, str(tmp_path), R.BOOSTS)
    index.put(spark.createDataFrame(_rows(rng, "A", "s", 8), COLS))
    before = index.search(["alpha", "the"], 100).collect()

    def fails(self, *a):
        raise OSError("no space")

    monkeypatch.setattr(I.Segments, "_publish", fails)
    with pytest.raises(OSError):
        index.replace(spark.createDataFrame(_rows(rng, "A", "s", 3), COLS))
    monkeypatch.undo()
    assert index.search(["alpha", "the"], 100).collect() == before and index.passages() == 8


@pytest.mark.parametrize("k", [1, 5, 400])
def test_pruned_search_is_that_of_all_pairs(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [rng.choices(vocabulary, weights, k=rng.randint(0, 40)) for _ in range(300)] + [["w0"] * 30] * 100
    asked = [rng.choices(vocabulary, k=rng.randint(1, 8)) for _ in range(25)] + [["w0"], ["none"], [], ["w0", "w59"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, t string")
    queries = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(asked)], "query_id int, query string")
    got = R.search_many(docs, queries, "id", F.col("t"), k).collect()
    n, avgdl = len(texts), sum(map(len, texts)) / len(texts)
    df = {w: sum(w in t for t in texts) for w in vocabulary}
    want = []
    for q, terms in enumerate(asked):
        scores = []
        for i, t in enumerate(texts):
            s = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
                for w in set(terms)
                if w in t
            )
            if any(w in t for w in terms):
                scores.append((-round(s, 4), i))
        want += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scores)[:k])]
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == sorted(want)


def test_one_segment_is_read_without_joins(spark, tmp_path):
    """The oldest segment's tombstones hide nothing; counts are made in place."""
    from gleaner.operators import index as I

    s = I.Segments(spark, str(tmp_path), {"text": 1.0})
    s.replace(spark.createDataFrame([("kb", "s", "c", "b a b b"), ("kb", "t", "d", "")], "kb_id string, source_id string, chunk_id string, text string"))
    live = s.version()[1]
    rows = s._seen(s._rows("postings", live), live)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.term, r.tf, r.dl) for r in rows.collect()) == [("a", 1, 4), ("b", 3, 4)]


def test_a_segment_is_written_where_it_is_made(spark, tmp_path):
    """Postings are not shuffled, a term's postings in a block are one row, and
    ids stand in the rows of lengths only."""
    from gleaner.operators import index as I

    rows = spark.range(4000).selectExpr("'kb' as kb_id", "'s' as source_id", "cast(id as string) as chunk_id", "concat('common common w', id % 7) as text")
    s = I.Segments(spark, str(tmp_path), {"text": 1.0})
    s.put(rows.coalesce(2))
    blocks = s._blocks(s.version()[1][0][1])
    terms = blocks.where("head is null")
    assert terms.count() == 2 * 8 and terms.agg(F.sum(F.size("keys"))).first()[0] == 8000  # 2 tasks
    assert blocks.where("head is not null").count() == 4000 == s.passages()
    got = s._rows("postings", s.version()[1]).where("term = 'common'").agg(F.sum("tf"), F.min("dl"), F.count_distinct("key")).first()
    assert tuple(got) == (8000, 3, 4000)


def test_a_passage_in_several_rows_is_one(spark, tmp_path):
    """Rows of one passage are added up where their lengths are equal."""
    from gleaner.operators import index as I

    cols = "kb_id string, source_id string, chunk_id string, text string"
    s = I.Segments(spark, str(tmp_path), {"text": 1.0})
    s.put(spark.createDataFrame([("kb", "s", "c", "a b"), ("kb", "s", "c", "a d"), ("kb", "s", "c", "a"), ("kb", "s", "e", "a a")], cols))
    live = s.version()[1]
    got = sorted((r.term, r.tf, r.dl) for r in s._rows("postings", live).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("a", 2, 2), ("b", 1, 2), ("d", 1, 2)]
    assert s.passages() == 4  # sums count rows
    # what is replaced is dropped in compaction, the rest stays
    s.patch(spark.createDataFrame([("kb", "s", "e", "a a")], cols), spark.createDataFrame([("kb", "s", "e", "z")], cols))
    s.compact()
    got = sorted((r.term, r.tf, r.dl) for r in s._rows("postings", s.version()[1]).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 1, 2), ("d", 1, 2), ("z", 1, 1)]
    assert s.passages() == 4 and [r.chunk_id for r in s.search(["z"]).collect()] == ["e"]
