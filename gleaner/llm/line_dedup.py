"""Removal of repeated passages by overlapping three-line windows.

Every run of three consecutive lines is hashed to 128 bits, two halves that are
each taken from the lines themselves.  A window that
occurs more than once in the table keeps its first occurrence (smallest id,
then smallest position); the lines covered by the later ones are removed, after
merging overlapping windows.  A later occurrence that overlaps the first one
in the same text removes only what lies beyond it.

DataFrame functions only.  A window's occurrences are never gathered: they are
counted with partial sums, and joined back with the position of the first.

Edge cases: null texts stay null and have no lines; texts of fewer than three
lines are never changed; a text all of whose lines go becomes empty; rows with
a null id pass unchanged and take no part; rows that share an id are the same
occurrence.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: A place in the table as one number: id times this, plus the line's position.
_STEP = 10_000_000_000


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, w1, w2: each window of three lines and its 128-bit hash."""
    hashed = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.split(text_col, "\n").alias("lines"))
        .where("size(lines) >= 3")
        .select(
            "id",
            F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
            F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("g"),
        )
    )
    return hashed.select(
        "id",
        F.expr(
            "posexplode(transform(sequence(1, size(h) - 2), i -> struct("
            "xxhash64(h[i - 1], h[i], h[i + 1]) as w1, xxhash64(g[i + 1], g[i - 1], g[i]) as w2)))"
        ).alias("pos", "w"),
    ).select("id", "pos", "w.w1", "w.w2")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, cut: sorted positions of the lines that later occurrences cover."""
    place = F.col("id").cast("decimal(20,0)") * F.lit(_STEP).cast("decimal(11,0)") + F.col("pos")
    every = windows(docs, id_col, text_col).withColumn("at", place.cast("decimal(38,0)"))
    # materialised, so that a very frequent window is split in the join
    first = cut(
        every.groupBy("w1", "w2")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("w1", "w2", "first")
    )
    later = every.join(first, ["w1", "w2"]).where("at > first")
    ahead = (F.col("at") - F.col("first")).cast("decimal(38,0)")
    skip = F.when(ahead < 3, 3 - ahead.cast("int")).otherwise(0)
    lines = later.select("id", F.explode(F.sequence(F.col("pos") + skip, F.col("pos") + 2)).alias("line"))
    return lines.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("cut"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, text (without the covered lines), n_lines,
    n_removed."""
    gone = covered_lines(docs, id_col, text_col).withColumnRenamed("id", "_id")
    # hashing the few covered lines spares the sort of all texts
    gone = gone.hint("shuffle_hash")
    # rows with a null id are dealt out by their text and meet nothing
    key, known = F.col(id_col).cast("long"), F.col(id_col).isNotNull()
    gone = gone.withColumn("_known", F.lit(True))
    same = (F.coalesce(key, F.xxhash64(text_col)) == F.col("_id")) & (known == F.col("_known"))
    rows = docs.select(id_col, text_col).join(gone, same, "left")
    lines = F.split(text_col, "\n")
    # the gaps between covered lines, as (start, length), are what stays
    gaps = F.filter(
        F.zip_with(
            F.concat(F.array(F.lit(-1)), F.col("cut")),
            F.concat(F.col("cut"), F.array(F.size("lines"))),
            lambda a, b: F.struct((a + 2).alias("s"), (b - a - 1).alias("n")),
        ),
        lambda g: g["n"] > 0,
    )
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["s"], g["n"]))), "\n")
    return rows.withColumn("lines", F.when(F.col(text_col).isNotNull(), lines)).select(
        id_col,
        F.when(F.col("cut").isNull(), F.col(text_col)).otherwise(kept).alias(text_col),
        F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("cut").isNotNull(), F.size("cut")), F.lit(0)).cast("long").alias("n_removed"),
    )
