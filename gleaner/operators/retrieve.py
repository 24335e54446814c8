"""Lexical, vector and hybrid retrieval over DataFrames of passages.

Scores are rounded to six digits before they are ranked and every order ends
with the id, so results do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.numbers import rounded
from gleaner.functions.text import index_text
from gleaner.functions.tokens import latin_tokens, tokens
from gleaner.operators.cuts import spread, stored

RRF_K = 60
POOL = 50
POSTINGS_A_TASK = 500_000
K1, B = 1.2, 0.75


# The weights of the fields of a passage.
BOOSTS = {"title": 2.0, "text": 1.0, "answer": 1.2, "indexes": 1.5}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _counts(tokens: Column, terms: Sequence[str]) -> Column:
    """[length, count of each term], from one tokenisation."""
    return _let(tokens, lambda t: F.array(F.size(t), *[F.size(F.filter(t, lambda x: x == F.lit(v))) for v in terms]))


def bm25_field(docs: DataFrame, field: Column, terms: Sequence[str], tokenise=latin_tokens) -> Column:
    """BM25 of ``field`` for the given terms, as a column.

    The collection's size, average length and document frequencies come from
    one aggregation of a single row, whatever filter follows; the score itself
    is a projection, so ranking needs no shuffle but the top-k.
    """
    counts = _counts(tokenise(field), terms)
    c = F.col("c")
    stats = docs.select(counts.alias("c")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(c[0]).alias("avgdl"),
        *[F.count_if(c[i + 1] > 0).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0

    def score(c: Column) -> Column:
        length = F.lit(K1) * (1 - F.lit(B) + F.lit(B) * c[0] / F.lit(float(avgdl)))
        total = F.lit(0.0)
        for i in range(len(terms)):
            df, tf = stats[f"df{i}"], c[i + 1].cast("double")
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            total = total + F.lit(idf) * (tf * (K1 + 1)) / (tf + length)
        return total

    return _let(counts, score)


def lexical(
    docs: DataFrame,
    terms: Sequence[str],
    id_col: str,
    fields: dict[str, tuple[Column, float]],
    keep: Column | None = None,
    tokenise=latin_tokens,
) -> DataFrame:
    """chunk_id, score > 0: the best boosted field of each passage.

    ``keep`` filters passages after the statistics, which stay global.
    ``tokens`` as ``tokenise`` makes pairs of CJK texts; terms are cut alike.
    """
    best = [bm25_field(docs, col, terms, tokenise) * F.lit(boost) for col, boost in fields.values()]
    score = F.round(F.greatest(*best) if len(best) > 1 else best[0], 6)
    rows = docs if keep is None else docs.where(keep)
    return rows.select(F.col(id_col).alias("chunk_id"), score.alias("score")).where("score > 0")


def passage_fields(title: Column, text: Column, answer: Column, indexes: Column) -> dict[str, tuple[Column, float]]:
    """The four weighted fields of a passage; ``indexes`` is an array of texts."""
    joined = F.array_join(F.coalesce(indexes, F.array().cast("array<string>")), " ")
    cols = {"title": title, "text": text, "answer": answer, "indexes": joined}
    return {name: (index_text(col), BOOSTS[name]) for name, col in cols.items()}


def query_terms(spark: SparkSession, query: str, tokenise=tokens) -> list[str]:
    """The distinct terms of one query, in order."""
    return spark.createDataFrame([(query,)], "q string").select(F.array_distinct(tokenise(F.col("q")))).first()[0]


def top(scored: DataFrame, k: int = POOL) -> DataFrame:
    """The k best rows by score, ties by id."""
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def vector(points: DataFrame, query: Sequence[float], id_col: str, vec_col: str, keep: Column | None = None) -> DataFrame:
    """chunk_id, score: cosine of every point with one query vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = points if keep is None else points.where(keep)
    scored = rows.select(F.col(id_col).alias("chunk_id"), cosine(F.col(vec_col), q).alias("score"))
    return scored.select("chunk_id", rounded(F.col("score"), 6).alias("score"))


def best_point(points: DataFrame, chunk_col: str = "chunk", kind_col: str = "kind") -> DataFrame:
    """One row for each passage: its best point's score and kind; of equal
    scores the first point counts."""
    best = F.max_by(F.struct("score", kind_col), F.struct("score", -F.col("chunk_id")))
    return points.groupBy(chunk_col).agg(best.alias("b")).select(
        F.col(chunk_col).alias("chunk_id"), F.col("b.score").alias("score"), F.col(f"b.{kind_col}").alias(kind_col)
    )


def ranked(scored: DataFrame, name: str = "rank") -> DataFrame:
    """Rank from 1 within a leg.  A leg is a top-k pool, so one partition."""
    return scored.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def rrf(lex: DataFrame, sem: DataFrame, similarity: float = 0.2) -> DataFrame:
    """Reciprocal rank fusion of two pools: chunk_id, score, note.

    Lexical ranks count passages that score above 0, semantic ones passages
    that reach ``similarity``.
    """
    a = ranked(lex.where("score > 0"), "lr").select("chunk_id", "lr")
    b = ranked(sem.where(F.col("score") >= similarity), "sr").select("chunk_id", "sr")
    part = [F.coalesce(1.0 / (F.col(c) + RRF_K), F.lit(0.0)) for c in ("lr", "sr")]
    return a.join(b, "chunk_id", "full_outer").select(
        "chunk_id",
        F.round(part[0] + part[1], 6).alias("score"),
        F.when(F.col("lr").isNotNull() & F.col("sr").isNotNull(), "mixed")
        .when(F.col("lr").isNotNull(), "lexical")
        .otherwise("semantic")
        .alias("note"),
    )


def search(lex: DataFrame, sem: DataFrame, mode: str = "mix", similarity: float = 0.2, limit: int = 20) -> DataFrame:
    """Results by mode: ``mix`` fuses, ``fulltext`` keeps the lexical order
    whatever the similarity, ``embedding`` keeps what reaches it."""
    if mode == "fulltext":
        return top(lex, limit).withColumn("note", F.lit("lexical"))
    if mode == "embedding":
        return top(sem.where(F.col("score") >= similarity), limit).withColumn("note", F.lit("semantic"))
    if mode != "mix":
        raise ValueError(f"mode {mode!r}")
    return top(rrf(lex, sem, similarity), limit)


def trace(lex: DataFrame, sem: DataFrame, similarity: float = 0.2, limit: int = 20) -> DataFrame:
    """The fused results with both legs' ranks and scores.  Ranks are over the
    whole legs, so a passage below the threshold has one, marked as dropped."""
    fused = ranked(top(rrf(lex, sem, similarity), limit), "fused_rank").withColumnRenamed("score", "fused_score")
    a = ranked(lex, "lexical_rank").withColumnRenamed("score", "lexical_score")
    b = ranked(sem, "vector_rank").withColumnRenamed("score", "vector_score")
    return fused.join(a, "chunk_id", "left").join(b, "chunk_id", "left").select(
        "chunk_id",
        "fused_rank",
        "fused_score",
        "note",
        "lexical_rank",
        "lexical_score",
        "vector_rank",
        "vector_score",
        F.coalesce(F.col("vector_score") < similarity, F.lit(False)).alias("vector_dropped"),
    )


def dropped(lex: DataFrame, sem: DataFrame, similarity: float = 0.2, limit: int = 20, most: int = 8) -> DataFrame:
    """What nearly made it: points below the threshold by score, then fused
    passages behind the cut; none that are in the results."""
    fused = ranked(rrf(lex, sem, similarity), "r")
    final = fused.where(F.col("r") <= limit).select("chunk_id")
    weak = sem.where(F.col("score") < similarity).join(final, "chunk_id", "left_anti")
    weak = weak.select("chunk_id", "score", F.lit("below threshold").alias("reason"), F.lit(0).alias("g"))
    behind = fused.where(F.col("r") > limit).join(weak.select("chunk_id"), "chunk_id", "left_anti")
    behind = behind.select("chunk_id", "score", F.lit("behind the cut").alias("reason"), F.lit(1).alias("g"))
    order = Window.orderBy("g", F.desc("score"), "chunk_id")
    rows = weak.unionByName(behind).withColumn("position", F.row_number().over(order))
    return rows.where(F.col("position") <= most).select("position", "chunk_id", "score", "reason")


def rerank(
    pool: DataFrame,
    docs: DataFrame,
    query_terms: Sequence[str],
    id_col: str,
    text: Column,
    limit: int = 20,
    model: Callable[[list[str]], list[float]] | None = None,
) -> DataFrame:
    """Replaces the ranking of a pool by ``model``, which takes a list of texts
    and returns as many scores and runs in the tasks; a text it gives null goes
    last.  Without one, by the share of query terms a passage has.  The pool is
    a top-k, so its ids are broadcast and only its texts are scored."""
    ids = F.broadcast(pool.select("chunk_id").distinct())
    texts = docs.select(F.col(id_col).alias("chunk_id"), text.alias("t")).join(ids, "chunk_id", "left_semi")

    def scored(batch: pa.Array) -> pa.Array:
        asked = [x or "" for x in batch.to_pylist()]
        got = list(model(asked)) if asked else []
        if len(got) != len(asked):
            raise ValueError("as many scores as texts are expected")
        return pa.array([None if x is None else float(x) for x in got], pa.float64())

    if model is None:
        have = latin_tokens(F.col("t"))
        new = _let(have, lambda t: sum(F.array_contains(t, x).cast("int") for x in query_terms) / F.lit(len(query_terms)))
    else:
        new = F.arrow_udf(scored, "double")(F.col("t"))
    scores = texts.select("chunk_id", F.round(new, 6).alias("new"))
    out = pool.join(scores, "chunk_id", "left").select(
        "chunk_id", F.coalesce("new", F.lit(0.0)).alias("score"), F.lit("reranked").alias("note")
    )
    return top(out, limit)


def search_state(query: str, sources: DataFrame, passages: DataFrame, wanted: Sequence | None = None, source_col: str = "source_id") -> str | None:
    """Why a search cannot find anything, before it is run: ``no query``,
    ``no source chosen``, ``no data``; else None.  One row is looked for."""
    if not (query or "").strip():
        return "no query"
    if wanted is not None and not list(wanted):
        return "no source chosen"
    rows, have = sources, passages
    if wanted is not None:
        rows, have = (x.where(F.col(source_col).isin(list(wanted))) for x in (rows, have))
    found = have.join(rows.select(source_col), source_col, "left_semi") if wanted is None else have
    return None if rows.head(1) and found.head(1) else "no data"


def degraded(mode: str, lex: DataFrame, semantic: Callable[[], DataFrame]) -> tuple[DataFrame, str | None]:
    """(semantic leg, error): where ``semantic`` fails, ``mix`` goes on with an
    empty leg and the error's text; ``embedding`` fails.  The leg, a pool, is
    computed here, so a model that fails in a task is noticed."""
    try:
        found = semantic().cache()
        found.count()
        return found, None
    except Exception as e:  # whatever the model raises
        if mode != "mix":
            raise
        return lex.select("chunk_id", "score").limit(0), str(e) or type(e).__name__


def searched(mode: str, lexical: Callable[[], DataFrame], semantic: Callable[[], DataFrame], similarity: float = 0.2, limit: int = 20) -> tuple[DataFrame | None, str | None]:
    """(results, state): without results the state says why: ``lexical search
    failed``, ``vector search failed``, ``no match``, ``below similarity``; with
    some, ``vector search failed`` where ``mix`` went on without."""
    lex = None
    if mode != "embedding":
        try:
            lex = stored(lexical())
        except Exception as e:  # a broken index is a state, not a crash
            return None, f"lexical search failed: {e}"
    error = None
    try:
        if mode == "fulltext":
            sem = lex.select("chunk_id", "score").limit(0)
        else:
            sem, error = degraded(mode, lex, semantic)
    except Exception as e:
        return None, f"vector search failed: {e}"
    lex = sem.limit(0) if lex is None else lex
    out = stored(search(lex, sem, mode, similarity, limit))
    failed = f"vector search failed: {error}" if error else None
    if out.head(1):
        return out, failed
    return None, "no match" if mode == "fulltext" else failed or f"below similarity {similarity}"


def search_many(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str,
    text: Column,
    k: int = 20,
    tokenise=latin_tokens,
    owner: Column | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """query_id, chunk_id, score, rank: BM25 for a table of queries at once.

    Passages meet queries by term, an equi-join of postings, but not by all
    terms.  A term's greatest contribution bounds what it can add; the k-th
    greatest contribution of a single term is a score that k passages reach.  A
    query's weakest terms, which together stay below that, cannot bring a
    passage into its results by themselves: the join takes the other terms
    only.  Of the passages it finds, those whose score with all the weak terms'
    bounds may still count are joined with the postings of the weak terms.

    With ``allowed`` (query_id, owner) a query finds passages of its owners
    only, while statistics stay global; then only scores of what it finds bound
    what it may still find.
    """
    own = F.lit(None).cast("string") if owner is None else owner.cast("string")
    have = spread(docs.select(F.col(id_col).alias("chunk_id"), own.alias("owner"), text.alias("_t"))).select("chunk_id", "owner", tokenise(F.col("_t")).alias("t"))
    n, avgdl = have.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    want = stored(queries.select("query_id", F.explode(F.array_distinct(tokenise(F.col("query")))).alias("term")))
    counted = (
        have.select("chunk_id", "owner", F.size("t").alias("dl"), F.explode("t").alias("term"))
        .join(want.select("term").distinct(), "term", "left_semi")
        .groupBy("term", "chunk_id", "owner", "dl")
        .agg(F.count(F.lit(1)).cast("double").alias("tf"))
    )
    postings = stored(counted)
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.lit(K1) * (1 - F.lit(B) + F.lit(B) * F.col("dl") / F.lit(float(avgdl or 1.0)))
    parts = postings.join(df, "term").select("term", "chunk_id", "owner", (idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + length)).alias("s"))
    # each term's greatest contribution, and its k-th greatest; partial sorts keep k rows a task
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("s")))
    best = parts.withColumn("r", nth).where(F.col("r") <= k).groupBy("term")
    bounds = best.agg(F.max("s").alias("most"), F.when(F.count(F.lit(1)) == k, F.min("s")).alias("kth"))
    weak_first = Window.partitionBy("query_id").orderBy("most", "term")
    plan = want.join(bounds, "term").select(
        "query_id",
        "term",
        F.sum("most").over(weak_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        (F.coalesce(F.max("kth").over(Window.partitionBy("query_id")), F.lit(0.0)) if allowed is None else F.lit(0.0)).alias("reached"),
    )
    # scores are rounded to four digits before they are compared
    margin = 1e-4
    plan = stored(plan.withColumn("weak", F.col("upto") < F.col("reached") - margin))
    rest = plan.where("weak").groupBy("query_id").agg(F.max("upto").alias("rest"))
    strong = plan.where(~F.col("weak")).select("query_id", "term", "reached")
    # pairs are summed where a passage's postings meet, a bounded number to a task
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, postings.count() // POSTINGS_A_TASK)
    met = parts.repartition(tasks, "chunk_id").join(strong, "term")
    met = met if allowed is None else met.join(allowed.select("query_id", F.col("owner").cast("string").alias("owner")).distinct(), ["query_id", "owner"], "left_semi")
    found = met.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("s"), F.first("reached").alias("reached"))
    found = stored(found)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
    kth = found.withColumn("r", at).where(F.col("r") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("s")).alias("kth"))
    room = F.col("s") + F.coalesce("rest", F.lit(0.0))
    kept = found.join(rest, "query_id", "left").join(kth, "query_id").where(room >= F.greatest("reached", F.coalesce("kth", F.lit(0.0))) - margin)
    kept = stored(kept.select("query_id", "chunk_id", "s"))
    more = kept.select("query_id", "chunk_id").join(plan.where("weak").select("query_id", "term"), "query_id").join(parts, ["term", "chunk_id"])
    whole = kept.unionByName(more.select("query_id", "chunk_id", "s")).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 4).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hits_text(hits: DataFrame, order_col: str, title: Column, text: Column, locator: Column) -> DataFrame:
    """One value: the numbered results as a tool returns them."""
    line = F.concat(
        F.format_string("[%d] %s (%.2f)", F.col(order_col), title, F.col("score")),
        F.lit("\n"), text, F.lit("\nlocator: "), locator,
    )
    rows = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), line.alias("line"))))
    return hits.agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("body"))
