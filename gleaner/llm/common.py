"""Shared helpers: cluster-safe materialisation, bounded Arrow batches, a
Bloom filter of bounded size built with built-in aggregates."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the corpus contracts: space and \t \n \v \f \r.
WS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate data, which all executors share.

    It is the one named by ``spark.checkpoint.dir``.  A temporary one is chosen
    only where that setting is absent and all runs on one machine; on a cluster
    it would be lost with an executor, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleaner-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder.  Unlike ``cut`` it keeps nothing
    of what the planner knew, which in long loops grows with every round."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Limit Arrow batches to ``rows`` rows and about ``size`` bytes, so that
    long texts fit a worker.

    The settings are of the session and only ever made tighter.  They hold
    when a plan runs, not when it is built, and so are not set back.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def documents_only(df: DataFrame, *cols: str) -> DataFrame:
    """Exactly the named columns; anything else in the table is ignored."""
    return df.select(*cols)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's text, modulo ``n``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


class Bloom:
    """Bloom filter with ``per_key`` bits a key, of ``most`` bits (32 MB) at
    most.

    The bits are gathered by ``bit_or`` per 64-bit word, so the driver gets at
    most ``most / 64`` rows.  With more keys than that holds the filter lets
    more rows through; it never drops one that is in the key set.
    """

    HASHES = 4

    def __init__(self, keys: DataFrame, column: str, per_key: int = 12, most: int = 1 << 28):
        n = max(1, keys.count())
        self.bits = min(most, max(1 << 10, 1 << (n * per_key - 1).bit_length()))
        spark = keys.sparkSession
        words = (
            keys.select(F.explode(F.array(*self.places(column))).alias("b"))
            .groupBy(F.shiftright("b", 6).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
        )
        table = np.zeros(max(1, self.bits >> 6), dtype=np.int64)
        got = words.toArrow()
        table[got.column("w").to_numpy()] = got.column("m").to_numpy()
        self._bits = spark.sparkContext.broadcast(table)

    def places(self, column: str) -> list[Column]:
        """Where the filter's bits for a value are."""
        return [F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(self.bits)) for i in range(self.HASHES)]

    def tester(self):
        """A function, for use in tasks, of the arrays of ``places``: true for
        every key of the filter and for few other values."""
        shared = self._bits

        def test(places: list[np.ndarray]) -> np.ndarray:
            ok = np.ones(len(places[0]), dtype=bool)
            for b in places:
                ok &= (shared.value[b >> 6] >> (b & 63)) & 1 == 1
            return ok

        return test

    def might_contain(self, column: str) -> Column:
        """``tester`` as a column."""
        test, names = self.tester(), [f"h{i}" for i in range(self.HASHES)]

        @F.pandas_udf("boolean")
        def probe(h: pd.DataFrame) -> pd.Series:
            return pd.Series(test([h[n].to_numpy() for n in names]))

        return probe(F.struct(*[p.alias(n) for n, p in zip(names, self.places(column), strict=True)]))


def without_ids(docs: DataFrame, lost: DataFrame, id_col: str, lost_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``lost``, all columns.

    A filter of bounded size lets most rows pass in place; only the rows it may
    know are joined, so their texts alone are moved.
    """
    ids = lost.where(F.col(lost_col).isNotNull()).select(F.col(lost_col).alias("__gl_lost")).distinct()
    known = Bloom(ids, "__gl_lost")
    key = docs.withColumn("__gl_key", F.col(id_col).cast("long"))
    seen = known.might_contain("__gl_key")
    clear = key.where(~seen)
    left = key.where(seen).join(ids, F.col("__gl_key") == F.col("__gl_lost"), "left_anti")
    return clear.unionByName(left).drop("__gl_key")
