"""Exact deduplication with a log-structured merge index of text digests.

One pass over the texts writes the log: (id, SHA-256 of the normalised text).
Each task fills a bounded memtable with entries of the log and flushes it as a
run sorted by digest, with a filter of its digests.  A digest that the filter
of an earlier run of the task may hold is searched in that run, and merged with
its entry there; when a level has ``FAN_IN`` runs they are merged into one of
the next.  The runs of all tasks are then dealt out by ranges of digests, where
sorted entries are merged as they stream by, keeping the smallest identifier
and the number of rows.

The merged runs have a filter too.  It tells which rows of the log may be hits;
only the texts of these are read again and moved, and each is compared with the
text it is a copy of, byte by byte, before it counts.

Edge cases: a null text counts as empty, and all empty texts are one group.
A null id sorts after all others and never is a group's keeper while the group
has another.  Repeated rows (same id, same text) stay in the table of
decisions; ``drop_copies`` leaves one of them.  An empty table gives an empty
result.  Other columns are ignored by ``exact_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Bloom, bound_batches, cut
from gleaner.llm.textcols import NOT_SPACE, slices

#: Runs of one level that are merged into one of the next.
FAN_IN = 8
_LAST = np.iinfo(np.int64).max
_ENTRY = "digest binary, low long, n long"


def normalised(text: str | Column) -> Column:
    """Every run of ASCII white space becomes one space; null becomes ''."""
    text = F.col(text) if isinstance(text, str) else text
    # single spaces stay as they are, so only the other runs are matched
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, digest of the normalised text)."""
    for b in batches:
        out: list[bytes] = []
        for _, _, data, off in slices(b.column(1)):
            space = ~NOT_SPACE[data]
            keep = np.ones(len(data), dtype=bool)
            keep[1:] = ~(space[1:] & space[:-1])
            first = off[:-1][off[:-1] < len(data)]
            keep[first] = True
            ends = np.concatenate(([0], np.cumsum(keep)))[off]
            plain = np.where(space, np.uint8(32), data)[keep].data
            out += [hashlib.sha256(plain[s:e]).digest() for s, e in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "digest"])


def digest_log(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest: one row for each row, the only pass over all texts."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests, "id long, digest binary")


def _fixed(column: pa.Array) -> np.ndarray:
    """A column of digests as fixed-width bytes, which sort and compare."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="S32")


def _lows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are null; a null stands after all others."""
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


class Run:
    """Sorted distinct digests, each with its smallest id and number of rows."""

    def __init__(self, digests: np.ndarray, lows: np.ndarray, null: np.ndarray, n: np.ndarray):
        order = np.argsort(digests, kind="stable")
        digests, lows, null, n = digests[order], lows[order], null[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], digests[1:] != digests[:-1])))
        self.digests = digests[first]
        self.lows = np.minimum.reduceat(lows, first)
        self.null = np.logical_and.reduceat(null, first)
        self.n = np.add.reduceat(n, first)
        self.bits = max(64, 1 << (10 * len(first)).bit_length())
        self.filter = np.zeros(self.bits, dtype=bool)
        self.filter[self._places(self.digests).reshape(-1)] = True

    def __len__(self) -> int:
        return len(self.digests)

    def _places(self, digests: np.ndarray) -> np.ndarray:
        words = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
        return (words[:, :3] & np.uint64(self.bits - 1)).astype(np.int64)

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``digests`` are here, and where; the filter is asked first."""
        maybe = np.flatnonzero(self.filter[self._places(digests)].all(axis=1))
        at = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self) - 1)
        same = self.digests[at] == digests[maybe]
        return maybe[same], at[same]

    def take_over(self, other: Run) -> Run | None:
        """Entries of ``other`` that are known here are merged into these; the
        rest of it, if any."""
        here, at = self.find(other.digests)
        self.lows[at] = np.minimum(self.lows[at], other.lows[here])
        self.null[at] &= other.null[here]
        self.n[at] += other.n[here]
        rest = np.ones(len(other), dtype=bool)
        rest[here] = False
        return Run(other.digests[rest], other.lows[rest], other.null[rest], other.n[rest]) if rest.any() else None

    @staticmethod
    def merged(runs: list[Run]) -> Run:
        return Run(*(np.concatenate([getattr(r, f) for r in runs]) for f in ("digests", "lows", "null", "n")))

    def rows(self) -> pa.RecordBatch:
        lows = pa.array(self.lows, pa.int64(), mask=self.null)
        digests = pa.array([d.ljust(32, b"\0") for d in self.digests.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([digests, lows, pa.array(self.n, pa.int64())], ["digest", "low", "n"])


def _flush(batches: Iterator[pa.RecordBatch], memtable_rows: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Entries of the log -> sorted runs.  A task holds ``most_rows`` entries
    at most; beyond that what it holds is given away."""
    levels: list[list[Run]] = [[]]
    memtable: list[pa.RecordBatch] = []

    def flush() -> None:
        t = pa.Table.from_batches(memtable)
        memtable.clear()
        run = Run(_fixed(t.column("digest")), *_lows(t.column("id").combine_chunks()), np.ones(t.num_rows, dtype=np.int64))
        for older in [r for level in levels for r in level]:
            if run is not None:
                run = older.take_over(run)
        if run is not None:
            levels[0].append(run)
        for i, level in enumerate(levels):
            if len(level) >= FAN_IN:
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(Run.merged(level))
                level.clear()

    def held() -> list[Run]:
        return [r for level in levels for r in level]

    rows = 0
    for b in batches:
        for at in range(0, b.num_rows, memtable_rows):
            memtable.append(part := b.slice(at, memtable_rows))
            rows += part.num_rows
            if rows >= memtable_rows:
                flush()
                rows = 0
                if sum(map(len, held())) >= most_rows:
                    yield Run.merged(held()).rows()
                    levels[:] = [[]]
    if rows:
        flush()
    if held():
        yield Run.merged(held()).rows()


def flush_runs(log: DataFrame, memtable_rows: int = 1 << 16, most_rows: int = 1 << 20) -> DataFrame:
    """Sorted runs of (digest, low, n), one or more for each task."""
    return log.select("digest", "id").mapInArrow(lambda it: _flush(it, memtable_rows, most_rows), _ENTRY)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries -> one for each digest that has several rows.  Only the
    entry at the end of a batch is held."""
    open_: Run | None = None
    for b in batches:
        if not b.num_rows:
            continue
        run = Run(_fixed(b.column(0)), *_lows(b.column(1)), b.column(2).to_numpy())
        if open_ is not None:
            run = Run.merged([open_, run])
        out = run.rows().slice(0, len(run) - 1)
        yield out.filter(pa.array(run.n[:-1] > 1))
        open_ = Run(run.digests[-1:], run.lows[-1:], run.null[-1:], run.n[-1:])
    if open_ is not None:
        yield open_.rows().filter(pa.array(open_.n > 1))


def compact(runs: DataFrame, ranges: int) -> DataFrame:
    """Merge of runs: digest, keep (smallest id), n, of the digests with more
    than one row.  Each task gets ranges of digests with the same lead; as
    digests are uniform, tasks are alike in size, and a frequent digest has one
    entry for each run."""
    dealt = runs.repartition(ranges, F.substring("digest", 1, 3)).sortWithinPartitions("digest")
    return dealt.mapInArrow(_merge, _ENTRY).withColumnRenamed("low", "keep")


class Index:
    """The merged runs of a table: ``log`` (id, digest), ``repeated`` (digest,
    keep, n of the digests seen more than once) and ``kept`` (these with the
    text that stays)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, memtable_rows: int, range_rows: int, **size: int):
        spark = docs.sparkSession
        self.log = cut(digest_log(docs, id_col, text_col))
        rows = self.log.count()
        ranges = max(rows // range_rows, min(rows // 10_000, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
        self.repeated = cut(compact(flush_runs(self.log, memtable_rows), ranges))
        self.filter = Bloom(self.repeated, "digest", **size)
        self.known = self.log.where(self.filter.might_contain("digest"))
        self.ids = Bloom(self.known, "id", **size)
        maybe = self.hits(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)
        maybe = maybe.select(F.col(_I).alias("i"), F.col(_N).alias("t"), F.col(_D).alias("d"))
        r = self.repeated
        # found by digest and id, so that no group meets in one task;
        # materialised, so that a very large group is split in later joins
        self.kept = cut(
            maybe.join(r, (maybe["d"] == r["digest"]) & maybe["i"].eqNullSafe(r["keep"]))
            .groupBy("digest")
            .agg(F.first("keep").alias("keep"), F.first("n").alias("n"), F.first("t").alias("text"))
            .select(*[F.col(c).alias(f"__gl_kept_{c}") for c in ("digest", "keep", "n", "text")])
        )

    def single(self) -> DataFrame:
        """id, keep, n, digest of the rows whose digest no other row has."""
        unknown = self.log.where(~self.filter.might_contain("digest"))
        alone = self.known.join(self.repeated.select("digest"), "digest", "left_anti")
        return unknown.unionByName(alone).select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), "digest")

    def hits(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The rows that may have copies, with id, normalised text and digest.
        The other texts are not looked at."""
        rows = docs.withColumn(_I, F.col(id_col).cast("long"))
        return _hashed(rows.where(self.ids.might_contain(_I)), text_col)


_I, _N, _D = "__gl_id", "__gl_norm", "__gl_digest"
_KEPT = ("__gl_kept_digest", "__gl_kept_keep", "__gl_kept_n", "__gl_kept_text")


def _hashed(rows: DataFrame, text_col: str) -> DataFrame:
    # never null, or a join's test for null would be pushed below the filter
    # of rows, and every text be hashed for it
    rows = rows.withColumn(_N, normalised(text_col))
    return rows.withColumn(_D, F.coalesce(F.unhex(F.sha2(F.col(_N).cast("binary"), 256)), F.lit(b"")))


def exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memtable_rows: int = 1 << 16,
    range_rows: int = 1 << 20,
    filter_bits: int = 1 << 28,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id (smallest id with an
    equal text), group_size, kept, text_sha256 (of the normalised text).

    ``range_rows``: entries of a range of the merged index, about.
    ``filter_bits``: size of a filter at most.
    """
    index = Index(docs, id_col, text_col, memtable_rows, range_rows, most=filter_bits)
    rows = index.hits(docs.select(id_col, text_col), id_col, text_col)
    same = F.col(_N) == F.col("__gl_kept_text")
    verified = cut(
        rows.join(index.kept, F.col(_D) == F.col("__gl_kept_digest")).select(
            F.col(_I).alias("id"),
            F.col("__gl_kept_keep").alias("keep"),
            F.col("__gl_kept_n").alias("n"),
            F.col(_D).alias("digest"),
            F.when(same, F.lit(None)).otherwise(F.col(_N)).alias("other"),
        )
    )
    if not verified.where("other is not null").isEmpty():
        # two texts under one digest: group these again by their bytes
        again = verified.groupBy("digest", "other").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        v, g = verified.alias("v"), again.alias("g")
        equal = (F.col("v.digest") == F.col("g.digest")) & F.col("v.other").eqNullSafe(F.col("g.other"))
        verified = v.join(g, equal).select("v.id", "g.keep", "g.n", "v.digest")
    every = index.single().unionByName(verified.select("id", "keep", "n", "digest"))
    return every.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    memtable_rows: int = 1 << 16,
    range_rows: int = 1 << 20,
    filter_bits: int = 1 << 28,
) -> DataFrame:
    """``docs`` without the copies, all columns; of equal texts exactly one row
    stays, one with the smallest id."""
    index = Index(docs, id_col, text_col, memtable_rows, range_rows, most=filter_bits)
    rows = docs.withColumn(_I, F.col(id_col).cast("long"))
    clear = rows.where(~index.ids.might_contain(_I))
    # materialised, as it is read for each of the three cases
    met = index.hits(docs, id_col, text_col).join(index.kept, F.col(_D) == F.col("__gl_kept_digest"), "left")
    met = cut(met)
    single = met.where("__gl_kept_digest is null").drop(*_KEPT)
    copy = met.where(F.col(_N) == F.col("__gl_kept_text"))
    first = copy.where(F.col(_I).eqNullSafe(F.col("__gl_kept_keep"))).drop(*_KEPT).dropDuplicates([_D])
    # other texts under the same digest, which do not occur in practice
    w = Window.partitionBy(_N).orderBy(F.col(_I).asc_nulls_last())
    odd = met.where(F.col(_N) != F.col("__gl_kept_text")).drop(*_KEPT)
    odd = odd.withColumn("__gl_rank", F.row_number().over(w)).where("__gl_rank = 1").drop("__gl_rank")
    stays = single.unionByName(first).unionByName(odd).drop(_N, _D)
    return clear.unionByName(stays).drop(_I)
