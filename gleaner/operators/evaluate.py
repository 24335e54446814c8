"""Evaluation of retrieval: expectations, runs, summaries, the release gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.functions.tokens import latin_tokens
from gleaner.operators.cuts import stored
from gleaner.operators.process import embedded
from gleaner.operators.retrieve import POOL, RRF_K, cosine, search_many


def expect_hit(expect: Column, title: Column, locator: Column, text: Column) -> Column:
    """In the locator or the title; in the text only if it has at least 8
    characters that are not blank."""
    needle = strip(F.coalesce(expect, F.lit("")))
    empty = F.lit("")
    long = F.length(F.regexp_replace(needle, r"(?U)\s", "")) >= 8
    return (needle != "") & (
        F.coalesce(locator, empty).contains(needle)
        | F.coalesce(title, empty).contains(needle)
        | (long & F.coalesce(text, empty).contains(needle))
    )


def run_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, ok, best_rank, n_hits: a case passes if any of its hits has
    what it expects.  ``cases``: case_id, expect; ``hits``: case_id, rank,
    title, locator, text."""
    ok = expect_hit(F.col("expect"), F.col("title"), F.col("locator"), F.col("text"))
    return (
        cases.join(hits, "case_id", "left")
        .withColumn("hit", F.coalesce(F.col("rank").isNotNull() & ok, F.lit(False)))
        .groupBy("case_id")
        .agg(
            F.bool_or("hit").alias("ok"),
            F.min(F.when(F.col("hit"), F.col("rank"))).alias("best_rank"),
            F.count("rank").alias("n_hits"),
        )
    )


def search_tools(
    tools: DataFrame,
    asked: DataFrame,
    passages: DataFrame,
    vectors: DataFrame | None = None,
    embed: Callable[[list[str]], list] | None = None,
    tokenise=latin_tokens,
) -> DataFrame:
    """case_id, rank, chunk_id, score, note: each case searched as its tool
    does, all tools in one plan.

    ``tools``: tool_id, source_ids (array), mode, similarity, top, rerank;
    ``asked``: case_id, tool_id, query, and warehouse if hits must name one;
    ``passages``: source_id, chunk_id, title, text, locator; ``vectors``:
    source_id, chunk_id, vec.  A tool without sources, and a blank query, find
    nothing.
    """
    cases = asked.join(tools, "tool_id").where(strip(F.coalesce("query", F.lit(""))) != "")
    cases = stored(cases.withColumn("pool", F.greatest("top", F.lit(POOL))))
    allowed = cases.select(F.col("case_id").alias("query_id"), F.explode("source_ids").alias("owner"))
    config = cases.select("case_id", "mode", "similarity", "top", "rerank", "pool")
    widest = cases.agg(F.max("pool")).first()[0] or POOL
    lex = search_many(passages, cases.where("mode <> 'embedding'").select(F.col("case_id").alias("query_id"), "query"), "chunk_id", F.col("text"), widest, tokenise, F.col("source_id"), allowed)
    lex = lex.select(F.col("query_id").alias("case_id"), "chunk_id", F.col("score").alias("lex"), F.col("rank").alias("lr")).join(config.select("case_id", "pool"), "case_id").where("lr <= pool").drop("pool")
    semantic = cases.where("mode <> 'fulltext'")
    sem = lex.where("false").select("case_id", "chunk_id", F.col("lex").alias("sem"), F.col("lr").alias("sr"))
    if vectors is not None and semantic.head(1):
        wanted = embedded(semantic.select("case_id", F.col("query").alias("text"), "similarity", "pool"), embed).drop("text").withColumnRenamed("vec", "q")
        met = vectors.select(F.col("source_id").cast("string").alias("owner"), "chunk_id", "vec").join(allowed.select(F.col("query_id").alias("case_id"), F.col("owner").cast("string").alias("owner")).distinct(), "owner")
        scored = met.join(wanted, "case_id").select("case_id", "chunk_id", "similarity", "pool", F.round(cosine(F.col("vec"), F.col("q")), 6).alias("sem"))
        nth = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("sem"), "chunk_id"))
        pool = scored.withColumn("n", nth).where(F.col("n") <= widest).where("n <= pool").groupBy("case_id", "chunk_id", "similarity").agg(F.max("sem").alias("sem"))
        order = Window.partitionBy("case_id").orderBy(F.desc("sem"), "chunk_id")
        sem = pool.where("sem >= similarity").select("case_id", "chunk_id", "sem", F.row_number().over(order).alias("sr"))
    both = lex.join(sem, ["case_id", "chunk_id"], "full_outer").join(config, "case_id")
    fused = F.round(sum(F.coalesce(1.0 / (F.col(c) + RRF_K), F.lit(0.0)) for c in ("lr", "sr")), 6)
    score = F.when(F.col("mode") == "fulltext", F.col("lex")).when(F.col("mode") == "embedding", F.col("sem")).otherwise(fused)
    note = F.when(F.col("sr").isNull(), "lexical").when(F.col("lr").isNull(), "semantic").otherwise("mixed")
    out = stored(both.select("case_id", "chunk_id", "top", "rerank", score.alias("score"), note.alias("note")))
    if out.where("rerank").head(1):  # pools, so that only their texts are looked at
        terms = cases.select("case_id", F.array_distinct(tokenise(F.col("query"))).alias("want"))
        texts = passages.select("chunk_id", "text").join(out.where("rerank").select("case_id", "chunk_id"), "chunk_id").join(terms, "case_id")
        share = F.round(F.size(F.array_intersect("want", tokenise(F.col("text")))) / F.size("want"), 6)
        new = texts.select("case_id", "chunk_id", share.alias("new"))
        out = out.join(new, ["case_id", "chunk_id"], "left")
        out = out.withColumns({"score": F.when(F.col("rerank"), F.coalesce("new", F.lit(0.0))).otherwise(F.col("score")), "note": F.when(F.col("rerank"), "reranked").otherwise(F.col("note"))}).drop("new")
    best = Window.partitionBy("case_id").orderBy(F.desc("score"), "chunk_id")
    out = out.withColumn("rank", F.row_number().over(best)).where("rank <= top").select("case_id", "rank", "chunk_id", "score", "note")
    if "warehouse" not in asked.columns:
        return out
    # names are looked for after the pool is cut, so ranks close up
    named = out.join(asked.select("case_id", "warehouse"), "case_id").join(passages.select("chunk_id", "title", "text", "locator"), "chunk_id")
    whole = F.lower(F.concat_ws(" ", "title", "text", "locator"))
    kept = named.where(F.coalesce(F.nullif(F.trim("warehouse"), F.lit("")), F.lit("")).eqNullSafe("") | whole.contains(F.lower(F.trim("warehouse"))))
    again = Window.partitionBy("case_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(again)).select("case_id", "rank", "chunk_id", "score", "note")


def run_tools(tools: DataFrame, cases: DataFrame, passages: DataFrame, vectors: DataFrame | None = None, embed: Callable[[list[str]], list] | None = None) -> DataFrame:
    """A run for each tool that has cases: tool_id, total, passed, failed,
    config, items (case_id, query, expect, ok, detail, hits), cases by id from
    the greatest.

    ``cases``: case_id, tool_id, query, expect.
    """
    hits = search_tools(tools, cases, passages, vectors, embed)
    said = passages.select("chunk_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "locator", "text")])
    full = said.join(stored(hits), "chunk_id").join(cases.select("case_id", "expect"), "case_id")
    hit = expect_hit(F.col("expect"), F.col("title"), F.col("locator"), F.col("text"))
    named = F.substring(F.coalesce(F.nullif("title", F.lit("")), F.nullif("locator", F.lit("")), F.lit("untitled")), 1, 40)
    rows = full.select("case_id", "rank", hit.alias("hit"), named.alias("name"), F.struct("rank", "chunk_id", "title", "locator", "score", "note").alias("h"))
    each = rows.groupBy("case_id").agg(F.bool_or("hit").alias("ok"), F.array_sort(F.collect_list("h")).alias("hits"), F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("names"))
    done = cases.join(tools, "tool_id").join(each, "case_id", "left")
    why = F.when(strip(F.coalesce("query", F.lit(""))) == "", "no query").when(F.coalesce(F.size("source_ids"), F.lit(0)) <= 0, "no source chosen")
    names = F.coalesce(F.nullif(F.array_join(F.transform("names", lambda x: x["name"]), ", "), F.lit("")), F.lit("none"))
    missed = F.format_string("missed; %d hits: %s", F.coalesce(F.size("hits"), F.lit(0)), names)
    ok = F.coalesce("ok", F.lit(False)) & why.isNull()
    detail = F.coalesce(why, F.when(ok, F.concat(F.lit("found "), F.col("expect"))).otherwise(missed))
    item = F.struct("case_id", "query", "expect", ok.alias("ok"), detail.alias("detail"), "hits")
    runs = done.groupBy("tool_id", "mode", "similarity", "top", "rerank").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.sort_array(F.collect_list(item), asc=False).alias("items")
    )
    config = F.struct("mode", "similarity", F.col("top").alias("limit"), "rerank")
    return runs.select("tool_id", "total", "passed", "failed", config.alias("config"), "items")


def runs_of(runs: DataFrame, tool_id=None, limit: int = 10) -> DataFrame:
    """The newest runs, of one tool if given, with their items nested; 1 to 50."""
    rows = runs if tool_id is None else runs.where(F.col("tool_id") == tool_id)
    return rows.orderBy(F.desc("created_at"), F.desc("run_id")).limit(max(1, min(limit, 50)))


def without_tools(gone: DataFrame, runs: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and cases without those of the tools in ``gone``."""
    return tuple(x.join(gone.select("tool_id").distinct(), "tool_id", "left_anti") for x in (runs, cases))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each tool; of equal times the larger id."""
    order = Window.partitionBy("tool_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def run_drift(runs: DataFrame) -> DataFrame:
    """Each run with whether its configuration differs from the one before."""
    order = Window.partitionBy("tool_id").orderBy("created_at", "run_id")
    before = F.lag("config").over(order)
    return runs.select("tool_id", "run_id", (before.isNotNull() & (before != F.col("config"))).alias("drifted"))


def summaries(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """tool_id, n_cases, run_id, passed, failed, ok of the latest run (null
    where the tool was never run)."""
    counts = cases.groupBy("tool_id").agg(F.count(F.lit(1)).alias("n_cases"))
    last = latest_runs(runs).select("tool_id", "run_id", "passed", "failed")
    ok = F.when(F.col("run_id").isNotNull(), (F.col("failed") == 0) & (F.col("passed") > 0))
    return counts.join(last, "tool_id", "left").select("tool_id", "n_cases", "run_id", "passed", "failed", ok.alias("ok"))


def release_gate(tools: DataFrame, summary: DataFrame) -> DataFrame:
    """tool_id, reason: why a tool must not be released; no row if it may."""
    reason = (
        F.when(F.col("n_cases").isNull(), "no cases")
        .when(F.col("run_id").isNull(), "never run")
        .when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" failed")))
    )
    rows = tools.select("tool_id").join(summary, "tool_id", "left").select("tool_id", reason.alias("reason"))
    return rows.where("reason is not null")
