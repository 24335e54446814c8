"""Session settings the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides anything."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long texts: fewer rows in each batch sent to Python
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    return builder.config(map=settings | conf).getOrCreate()
