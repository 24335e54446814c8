"""Streaming jobs: log ingest and incremental page sync.

Both read files as they come, keep their progress in a checkpoint folder, and
can be stopped and started again without losing or repeating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gleaner.functions.logs import log_row, logged
from gleaner.operators.store import Store, SyncFailed, sync_site


def read_new(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 4) -> DataFrame:
    """A stream of the Parquet files under ``path``, with a known schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the calls worth a row, each event once by id within a day."""
    rows = (
        stream.where(logged(F.col("event_type")))
        .withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", "1 day")
        .dropDuplicatesWithinWatermark(["event_id"])
        .select("event_id", "at", "event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    )
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def ingest_calls(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends calls (id, created_at, method and what ``log_row`` knows) as log
    rows, each once within a day; pings and notifications are left out."""
    rows = stream.where(logged(F.col("method"))).withWatermark("created_at", "1 day").dropDuplicatesWithinWatermark(["id"])
    writer = log_row(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def count_by_day(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Events by day and type, so far: each batch writes the groups that it
    changed, in a folder of its own, and a batch that is run again writes the
    same folder again.  ``daily_counts`` reads them.  A day may still change
    until an hour after it; then its state goes."""
    rows = (
        stream.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", "1 hour")
        .groupBy(F.window("at", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    )

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.outputMode("update").trigger(availableNow=True).start()


def daily_counts(spark: SparkSession, out: str) -> DataFrame:
    """day, event_type, n, total: of each group what the last batch said."""
    rows = spark.read.option("basePath", out).parquet(out)
    last = rows.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return last.select("day", "event_type", "r.n", "r.total")


def page_store(spark: SparkSession, path: str) -> Store:
    """A store for ``sync_pages``, of pages without their passages."""
    return Store(spark, path, {"pages": ("locator string, title string, text string, hash string, status string, error string", "locator")})


def sync_pages(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Keeps a store's pages in step with fetched batches (locator, hash, code,
    seq, and title and text if there are).

    A batch writes the buckets of the pages that it holds; its number is kept
    with the version it makes, so a batch that is run again changes nothing.
    One in which no page could be read marks what is open, and the stream goes
    on.
    """
    missing = [F.lit(None).cast("string").alias(c) for c in ("title", "text") if c not in stream.columns]

    def step(batch: DataFrame, number: int) -> None:
        if store.manifest()[2] >= number:
            return
        rows = batch.select("*", *missing).groupBy("locator").agg(F.max_by(F.struct("title", "text", "hash", "code"), "seq").alias("r"))
        try:
            sync_site(store, rows.select("locator", "r.*"), batch=number)
        except SyncFailed:
            pass  # the marks are in the store

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
