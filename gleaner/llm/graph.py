"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One contraction: neighbours of ``u`` are linked with the smallest one."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large and parts > 1:
        # materialised, so that a node with very many links is split in the join
        low = cut(low)
    out = both.join(low, "u").coalesce(parts)
    if large:
        moved = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct().coalesce(parts)


def components(edges: DataFrame, part_rows: int = 50_000, least_rows: int = 500) -> DataFrame:
    """(a, b) links -> (node, comp), comp the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer
    change; they then join each node with its component's smallest.  The
    number of rounds grows with the logarithm of the longest path.  A table of
    links is held in one partition for each ``part_rows`` of them, or in as many
    as a shuffle makes if each then has ``least_rows``; so few links don't make
    many small files round after round.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark["n"] == 0 or mark == before:
            break
        before = mark
        parts = 1 + max(mark["n"] // part_rows, min(mark["n"] // least_rows, most))
        now = cut(_star(_star(now.coalesce(parts), True, parts), False, parts))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
