"""All named queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import evaluation, ingest, logs, relational, retrieval, streams, text

_PLANS = (retrieval, text, ingest, evaluation, logs, relational, streams)
hybrid_search = retrieval.hybrid_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
