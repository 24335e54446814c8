"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleaner-"))
    return f"{sc.getCheckpointDir()}/job-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder of the session, and read from
    there.  A temporary folder is used only where none is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` as Parquet in the shared folder.  Unlike ``settled`` the planner
    knows its size, so that small tables are broadcast and large ones are not."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to tasks of some 10,000 rows, if one task reads more than
    twice its share of the rows and much is done with each row.  Rows are
    counted, not splits: a row group is read by one task, however many splits
    its file makes.  A table that is even is left as it is.

    Rows are dealt by their number: without a key, Spark sorts all rows of a
    task before it deals them.  Up to 200 tasks rows are written as they come;
    beyond, they are held and sorted by task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    each = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    largest, rows = each.agg(F.max("n"), F.sum("n")).first()
    if not rows or largest * cores <= 2 * rows:
        return df
    return df.repartition(max(cores, min(200, rows // 10_000)), F.monotonically_increasing_id())


def in_place(df: DataFrame, least: int = 500) -> bool:
    """Whether each task may write what it makes of ``df`` to the folders of
    all buckets: at most 200 tasks, with ``least`` rows each on the average.
    Else the files would be many and small, and rows are dealt by bucket."""
    each = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    tasks, rows = each.agg(F.count(F.lit(1)), F.sum("n")).first()
    return tasks <= 200 and (rows or 0) >= least * tasks
