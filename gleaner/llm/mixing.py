"""Mixing sources to target weights by nested hash thresholds.

Every row gets a 60-bit hash of its id.  A histogram of words by source and
hash bucket shows in which bucket a source's budget ends; only that bucket is
split further, 12 bits at a time, until it holds one hash.  Rows below the
threshold are taken once more than the others: a plain filter, no sort.

Edge cases: a null text has size 0; a null source is a source of its own, the
last; a null id hashes as the empty text; rows with one id share one hash and
are taken alike; sources without words get target 0; an empty table gives an
empty result.  Other columns are ignored by ``mix_sources`` and kept by ``mix``.

The targets are computed over a table with one row for each source, sorted by
one task: good for some ten million sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import cut

LEVEL_BITS, HASH_BITS = 12, 60


def word_count(text: str) -> Column:
    """Number of maximal runs of anything but ASCII white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaces = [9, 10, 11, 12, 13, 32]
    parts = F.size(F.split(t, r"[\x20\x09-\x0D]+"))
    lead = F.ascii(t).isin(spaces).cast("int")
    tail = F.ascii(F.substring(t, -1, 1)).isin(spaces).cast("int")
    return F.when(t == "", F.lit(0)).otherwise(parts - lead - tail).cast("long")


def id_hash(id_col: str) -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """source, source_size -> target: weights 1..cycle in order of the source,
    no target beyond ``most`` times its size, the excess reshared by weight.

    One row a source, so the windows here are over a list of names.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.select(
        "source",
        "source_size",
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(cycle)) + 1).cast("long").alias("w"),
        (F.col("source_size") * most).alias("cap"),
    ).withColumn("r", F.col("cap").cast("double") / F.col("w"))
    before = Window.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    t = t.withColumn(
        "lam",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))),
    )
    # the first source, by cap per weight, that its share does not fill
    level = F.min(F.when(F.col("lam") <= F.col("r"), F.col("lam"))).over(every)
    first = F.min(F.when(F.col("lam") <= F.col("r"), F.struct("r", "lam"))).over(every)["lam"]
    return t.withColumn("level", F.coalesce(first, level, F.lit(0.0))).select(
        "source",
        "source_size",
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"),
    )


def _thresholds(sizes: DataFrame, plan: DataFrame, few) -> DataFrame:
    """source -> bar: rows with a hash below it are taken once more."""
    todo = plan.select("source", "rem", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done: DataFrame | None = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        t = todo.select(F.col("source").alias("s"), "rem", "prefix", "below")
        inside = sizes.join(
            few(t),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")),
        )
        hist = inside.groupBy("source", "rem", "below", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        edge = (
            hist.withColumn("cum", F.col("below") + F.sum("words").over(upto))
            .where("cum >= rem and cum - words < rem")
            .select("source", "rem", "bucket", "words", "low", "high", (F.col("cum") - F.col("words")).alias("below"))
        )
        edge = cut(edge)
        # one hash left: take it if that comes nearer to the budget
        over = F.col("below") + F.col("words") - F.col("rem")
        one = edge.where("low = high").select(
            "source", (F.col("low") + (over < F.col("rem") - F.col("below")).cast("long")).alias("bar")
        )
        done = one if done is None else done.unionByName(one)
        todo = edge.where("low < high").select("source", "rem", F.col("bucket").alias("prefix"), "below")
        if todo.isEmpty():
            break
    return done


class Plan:
    """How often the rows of each source are taken: ``table`` has the columns
    s (source), source_size, target, copies and bar; rows whose hash is below
    ``bar`` are taken once more.  It is broadcast up to ``broadcast_sources``
    rows, and joined by a shuffle beyond that."""

    def __init__(self, sizes: DataFrame, cycle: int, most: int, broadcast_sources: int):
        totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
        self.small = totals.count() <= broadcast_sources
        plan = cut(
            targets(totals, cycle, most)
            .withColumn(
                "copies",
                F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)))
                .otherwise(F.lit(0))
                .cast("long"),
            )
            .withColumn("rem", F.col("target") - F.col("copies") * F.col("source_size"))
        )
        bars = _thresholds(sizes, plan.where("rem > 0"), self._few)
        t = plan.alias("p").join(bars.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left")
        self.table = cut(
            t.select(F.col("p.source").alias("s"), "source_size", "target", "copies", F.coalesce("bar", F.lit(-1)).alias("bar"))
        )

    def _few(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def of(self, rows: DataFrame, source: Column, h: Column) -> DataFrame:
        """``rows`` with a struct ``__gl_mix`` of source_size, target, copies."""
        names = [f"__gl_{c}" for c in ("s", "size", "target", "copies", "bar")]
        t = self.table.toDF(*names)
        copies = (F.col("__gl_copies") + (h < F.col("__gl_bar")).cast("long")).alias("copies")
        met = rows.join(self._few(t), source.eqNullSafe(F.col("__gl_s")))
        got = F.struct(F.col("__gl_size").alias("source_size"), F.col("__gl_target").alias("target"), copies)
        return met.withColumn("__gl_mix", got).drop(*names)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_col).alias("size"),
            id_hash(id_col).alias("h"),
        )
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: int = 3,
    most: int = 3,
    broadcast_sources: int = 100_000,
) -> DataFrame:
    """The ledger, one row for each row: doc_id, size, source_size, target,
    taken: the row's words times its copies in the mix (0 to ``most``)."""
    sizes = _sizes(docs, id_col, text_col, source_col)
    plan = Plan(sizes, cycle, most, broadcast_sources)
    return plan.of(sizes, F.col("source"), F.col("h")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("__gl_mix.source_size").alias("source_size"),
        F.col("__gl_mix.target").alias("target"),
        (F.col("size") * F.col("__gl_mix.copies")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: int = 3,
    most: int = 3,
    broadcast_sources: int = 100_000,
    copies_col: str = "copies",
) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, all columns, and how
    often each is taken.  A column named ``copies_col`` is replaced.  The texts
    stay where they are."""
    plan = Plan(_sizes(docs, id_col, text_col, source_col), cycle, most, broadcast_sources)
    met = plan.of(docs, F.col(source_col).cast("string"), id_hash(id_col)).where("__gl_mix.copies > 0")
    return met.withColumn(copies_col, F.col("__gl_mix.copies")).drop("__gl_mix")
