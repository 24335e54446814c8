"""Document services that answer in pages, as a Spark data source.

A service is a class with ``roots()`` and ``page(root, cursor)``; each root is
read by a task of its own, so a large workspace is read in parallel.  Services
that answer by network plug in here; the one below reads JSON files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, id string, kind string, title string, text string, url string"


class Service(Protocol):
    def roots(self) -> list[str]:
        """Folders or spaces that can be read apart from each other."""

    def page(self, root: str, cursor: str) -> tuple[list[dict], str]:
        """Documents of one page and the next cursor, '' at the end."""


def walk(service: Service, root: str) -> Iterator[dict]:
    """All documents below a root, page by page; a repeated cursor ends it."""
    cursor, seen = "", set()
    while cursor not in seen:
        seen.add(cursor)
        rows, cursor = service.page(root, cursor)
        yield from rows
        if not cursor:
            return


class JsonPages:
    """A service kept in one JSON object: root -> list of pages."""

    def __init__(self, body: str):
        self.pages = json.loads(body)

    def roots(self) -> list[str]:
        return sorted(self.pages)

    def page(self, root: str, cursor: str) -> tuple[list[dict], str]:
        i = int(cursor or 0)
        return self.pages[root][i], str(i + 1) if i + 1 < len(self.pages[root]) else ""


class _Root(InputPartition):
    def __init__(self, root: str):
        self.root = root


class _Reader(DataSourceReader):
    def __init__(self, service: Service):
        self.service = service

    def partitions(self) -> list[InputPartition]:
        return [_Root(r) for r in self.service.roots()]

    def read(self, partition: _Root) -> Iterator[tuple]:
        for d in walk(self.service, partition.root):
            yield (partition.root, *(d.get(k) for k in ("id", "kind", "title", "text", "url")))


class PagedSource(DataSource):
    """``spark.read.format("paged").option("pages", json)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(JsonPages(self.options["pages"]))


def read_paged(spark: SparkSession, pages: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("pages", pages).load()


def to_sources(docs: DataFrame, kb_id: str, connector: str, kinds: tuple[str, ...] = ("docx", "doc")) -> DataFrame:
    """kb_id, type, locator, title, text, seq as the upsert takes them; the
    locator is the address, else the connector and id."""
    locator = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.concat(F.lit(f"{connector}:"), "id"))
    return docs.where(F.col("kind").isin(*kinds)).select(
        F.lit(kb_id).alias("kb_id"),
        F.lit(connector).alias("type"),
        locator.alias("locator"),
        "title",
        "text",
        F.col("id").alias("seq"),
    )
