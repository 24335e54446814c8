"""Keyed tables whose changes show together.

A store holds tables of rows that belong to an owner (a source, a page).  Rows
lie in buckets by a hash of the owner; a change writes the buckets of the owners
it touches, in new folders, and nothing else.  Which folder holds which bucket
of which table, and which segments make the lexical index, is the manifest.  A
change ends with one write, of the next version of the manifest: readers see all
of it or none.  One writer at a time is assumed.

Single passages are patched in an overlay: a small table that is merged when
read, and folded into the buckets by ``fold``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.cuts import in_place, stored
from gleaner.operators.index import Segments

BUCKETS = 64


def bucket(owner: str):
    return F.pmod(F.xxhash64(F.coalesce(F.col(owner).cast("string"), F.lit(""))), F.lit(BUCKETS)).cast("int")


@dataclass
class Store:
    """``tables``: name -> (schema, owner column)."""

    spark: SparkSession
    path: str
    tables: dict[str, tuple[str, str]]
    boosts: dict[str, float] = field(default_factory=dict)

    def manifest(self) -> tuple[int, list[tuple[str, int, str]], int]:
        """Number of the version in force, its (table, bucket, folder), and the
        number of the last streamed batch in it (-1: none)."""
        try:
            rows = self.spark.read.schema("name string, bucket int, folder string, batch long, v int").parquet(f"{self.path}/versions")
            last = rows.agg(F.max("v")).first()[0]
        except AnalysisException:  # nothing was written yet
            last = None
        if last is None:
            return 0, [], -1
        got = rows.where(F.col("v") == last).collect()  # tables x buckets
        return last, [(r.name, r.bucket, r.folder) for r in got if r.name], max(r.batch for r in got)

    def current(self, name: str, buckets: list[int] | None = None, of: list | None = None) -> DataFrame:
        """A table's rows, of some buckets only if given."""
        entries = self.manifest()[1] if of is None else of
        paths = sorted({f for n, b, f in entries if n == name and (buckets is None or b in buckets)})
        # a bucket's folder is read by itself: its name says which bucket it is; no union with rows of
        # a size that the planner does not know, or small tables would not be broadcast
        return self.spark.read.schema(self.tables[name][0]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[name][0]).limit(0)

    def change(self) -> Change:
        return Change(self)

    def index(self) -> Segments:
        """The lexical index as it is, for searching."""
        return self.change().index()


class Change:
    """What will be the next version; nothing of it shows before ``commit``."""

    def __init__(self, store: Store):
        self.store = store
        self.version, self.entries, self.batch = store.manifest()

    def segments(self) -> list[tuple[int, str]]:
        return sorted((b, f) for n, b, f in self.entries if n == "index")

    def hold(self, live: list[tuple[int, str]]) -> None:
        self.entries = [e for e in self.entries if e[0] != "index"] + [("index", b, f) for b, f in live]

    def index(self) -> Segments:
        return Segments(self.store.spark, f"{self.store.path}/index", self.store.boosts, held=self)

    def current(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self.store.current(name, buckets, self.entries)

    def replace(self, name: str, rows: DataFrame, gone: DataFrame | None = None, settled: bool = False) -> None:
        """Puts ``rows`` in place of all rows of their owners and of the owners
        in ``gone``; only those owners' buckets are read and written.  Rows are
        stored first, unless they are ``settled``: read from tables that don't
        change, and cheap to read again.  Rows that stay are written where they
        are read, a task a bucket; new ones too where ``in_place`` says so."""
        schema, owner = self.store.tables[name]
        columns = self.store.spark.createDataFrame([], schema)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns.schema])
        rows = rows if settled else stored(rows)
        owners = rows.select(F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"))
        if gone is not None:
            owners = owners.unionByName(gone.select(F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner")))
        owners = stored(owners.distinct())
        touched = sorted(r[0] for r in owners.select(bucket("_owner").alias("b")).distinct().collect())  # BUCKETS at most
        if not touched:
            return
        folder = f"{self.store.path}/{name}/{uuid.uuid4().hex}"
        both = rows.withColumn("_bucket", bucket(owner))
        if not in_place(rows):
            both = both.repartition("_bucket")
        old = None
        for b in sorted({b for n, b, _ in self.entries if n == name and b in touched}):
            # two tasks, as tasks of one each would be united to one
            part = self.current(name, [b]).coalesce(2).withColumn("_bucket", F.lit(b))
            old = part if old is None else old.unionByName(part)
        if old is not None:
            left = old.withColumn("_owner", F.coalesce(F.col(owner).cast("string"), F.lit(""))).join(owners, "_owner", "left_anti").drop("_owner")
            both = left.unionByName(both)
        both.write.partitionBy("_bucket").option("compression", "zstd").parquet(folder)
        read = self.store.spark.read.schema(f"{schema}, _bucket int").parquet(folder)
        held = {r[0] for r in read.select("_bucket").distinct().collect()}
        self.entries = [e for e in self.entries if e[0] != name or e[1] not in touched]
        self.entries += [(name, b, f"{folder}/_bucket={b}") for b in touched if b in held]

    def commit(self, batch: int | None = None) -> int:
        rows = [(n, b, f, self.batch if batch is None else batch) for n, b, f in self.entries]
        rows = self.store.spark.createDataFrame(rows or [("", 0, "", self.batch if batch is None else batch)], "name string, bucket int, folder string, batch long")
        rows.coalesce(1).write.parquet(f"{self.store.path}/versions/v={self.version + 1}")
        return self.version + 1


def swept(store: Store, keep: int = 2) -> int:
    """Empties the folders that none of the last ``keep`` versions names;
    returns how many.  A folder is emptied by writing no rows over it."""
    rows = store.spark.read.parquet(f"{store.path}/versions").where("name not in ('', 'index')")
    last = store.manifest()[0]
    named = rows.where(F.col("v") > last - keep).select("name", "folder").distinct()
    old = rows.select("name", "folder").distinct().join(named, ["name", "folder"], "left_anti").collect()
    for r in old:
        store.spark.createDataFrame([], store.tables[r.name][0]).write.mode("overwrite").parquet(r.folder)
    return len(old)


class SyncFailed(RuntimeError):
    """No page of a site could be read."""


def sync_site(store: Store, fetched: DataFrame, message: str = "no page could be read", batch: int | None = None) -> int:
    """Takes a site's fetched pages (locator, title, text, hash, code) into the
    store's tables ``pages`` and ``passages``; returns how many were read.

    A page that is gone goes with its passages; another failure marks it and
    keeps them; a new, changed or unsynced page is written, with its text as
    what is to be split; an unchanged one only gets its title.  If no page was
    read, what was open and has no passages yet is marked, and the sync fails;
    the marks stay.
    """
    from gleaner.operators.tables import page_changes

    change = store.change()
    fetched = stored(fetched)
    owners = sorted(r[0] for r in fetched.select(bucket("locator").alias("b")).distinct().collect())
    known = stored(change.current("pages", owners))
    acts = page_changes(known.select("locator", "hash", "status"), fetched.select("locator", "hash", "code"))
    new = fetched.select("locator", F.nullif(F.trim("title"), F.lit("")).alias("_title"), F.col("text").alias("_text"), F.col("hash").alias("_hash"), "code")
    rows = stored(acts.where("action not in ('keep', 'skip')").join(known, "locator", "left").join(new, "locator", "left"))
    put = F.col("action").isin("insert", "update")
    pages = rows.where("action <> 'delete'").select(
        "locator",
        F.when(F.col("action") == "error", F.col("title")).otherwise(F.coalesce("_title", "title", "locator")).alias("title"),
        F.when(put, F.col("_text")).otherwise(F.col("text")).alias("text"),
        F.when(put, F.col("_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(F.col("action") == "error", "error").otherwise("synced").alias("status"),
        F.when(F.col("action") == "error", F.format_string("fetch failed: HTTP %d", "code")).alias("error"),
    )
    gone = rows.where("action = 'delete'").select("locator")
    change.replace("pages", pages, gone)
    if "passages" in store.tables:
        cleared = rows.where(put | (F.col("action") == "delete")).select(F.col("locator").alias(store.tables["passages"][1]))
        parts = rows.where(put).select(F.col("locator").alias(store.tables["passages"][1]), F.col("_text").alias("text"))
        change.replace("passages", parts, cleared)
    read = fetched.where("code < 400").count()
    if not read:
        open_ = change.current("pages").where("status = 'syncing'")
        if "passages" in store.tables:
            owner = store.tables["passages"][1]
            open_ = open_.join(change.current("passages").select(F.col(owner).alias("locator")).distinct(), "locator", "left_anti")
        change.replace("pages", open_.withColumns({"status": F.lit("error"), "error": F.lit(message)}))
    change.commit(batch)
    if not read:
        raise SyncFailed(message)
    return read
