"""Stored indexes: postings in segments, and vectors.

A batch of passages becomes a segment: postings partitioned by a hash of the
term, so that a search reads its terms' partitions only, and a row of sums for
each source and field.  Each task writes its postings where they are made, in
order of the terms, so that nothing is shuffled; the postings of a term in a
block of passages are one row.  A posting names its passage and field by a
number; whose it is stands once, in a row of lengths beside the partitions.  Segments are never changed.  Replacing or deleting a
source writes a tombstone, which hides the source's rows in older segments;
what a search needs of the whole collection (number of passages, lengths) are
sums over the sources that are not hidden, so they need no scan of postings.
Compaction merges the oldest segments and drops what is hidden in them.

A change shows by one write, of the list of segments under a new version; a
job that fails before it leaves the index as it was, and what it wrote is never
read.  One writer at a time is assumed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.tokens import latin_tokens
from gleaner.operators.cuts import in_place, spread, stored
from gleaner.operators.retrieve import K1, B

BUCKETS = 64
#: Postings of a bucket beyond which it is dealt to several files.
BUCKET_ROWS = 4_000_000

_KEY = "kb_id string, source_id string"
#: As stored: a row is a term with its postings in a block of passages, or has
#: a head, the length of a passage's field. Those lie in a bucket of their own.
_HEAD = "struct<kb_id: string, source_id: string, chunk_id: string, field: string, key: bigint, dl: bigint>"
_STORED = f"term string, run long, keys array<long>, tfs array<int>, dls array<int>, head {_HEAD}"
_TABLES = {
    "postings": "term string, run long, key long, tf long, dl long, bucket int",
    "lengths": f"{_KEY}, chunk_id string, field string, key long, dl long, run long",
    "sums": f"{_KEY}, field string, n long, total long",
    "gone": f"{_KEY}, chunk_id string",
}
#: Tokens, or postings, of which a task makes a block.
BLOCK = 1_000_000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(passages: DataFrame, id_col: str, text: Column, tokenise=latin_tokens) -> DataFrame:
    """bucket, term, chunk_id, tf, dl of one field."""
    rows = spread(passages).select(F.col(id_col).alias("chunk_id"), tokenise(text).alias("t"))
    rows = rows.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    counted = rows.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return counted.select(bucket(F.col("term")).alias("bucket"), "term", "chunk_id", "tf", "dl")


def _gathered(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.Table]:
    """Batches put together to blocks of at least BLOCK by ``size``."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += size(b)
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n or held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _lists(starts: np.ndarray, n: int, columns: dict) -> dict:
    """Columns cut to lists at ``starts``."""
    offsets = pa.array(np.append(starts, n).astype(np.int32))
    return {name: pa.ListArray.from_arrays(offsets, pa.array(values)) for name, values in columns.items()}


_ARROW_HEAD = pa.struct([*[(c, pa.string()) for c in ("kb_id", "source_id", "chunk_id", "field")], ("key", pa.int64()), ("dl", pa.int64())])
_ARROW = pa.schema([("term", pa.string()), ("keys", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())), ("head", _ARROW_HEAD)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of passages' tokens, blocks of postings and the passages' lengths."""
    for block in _gathered(batches, lambda b: len(b.column("t").flatten())):
        if not block.num_rows:
            continue
        tokens = _whole(block["t"])
        terms = tokens.flatten().dictionary_encode()
        head = pa.StructArray.from_arrays([_whole(block[f.name]) for f in _ARROW_HEAD], fields=list(_ARROW_HEAD))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(head), f.type) for f in list(_ARROW)[:4]], head], schema=_ARROW)
        if not len(terms):
            continue
        # a number for each term and row, so that equal ones are counted and terms lie together
        at = terms.indices.to_numpy().astype(np.int64) * block.num_rows + pc.list_parent_indices(tokens).to_numpy()
        at, tf = np.unique(at, return_counts=True)
        row, code = at % block.num_rows, at // block.num_rows
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        key, dl = (_whole(block[c]).to_numpy() for c in ("key", "dl"))
        made = _lists(starts, len(at), {"keys": key[row], "tfs": tf.astype(np.int32), "dls": dl[row].astype(np.int32)})
        yield pa.RecordBatch.from_arrays([terms.dictionary.cast(pa.string()), *made.values(), pa.nulls(len(starts), _ARROW_HEAD)], schema=_ARROW)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of single postings, blocks."""
    for block in _gathered(batches, len):
        if not block.num_rows:
            continue
        terms = _whole(block["term"]).dictionary_encode()
        code = terms.indices.to_numpy()
        run, key, tf, dl = (_whole(block[c]).to_numpy() for c in ("run", "key", "tf", "dl"))
        order = np.lexsort((key, run, code))
        code, run = code[order], run[order]
        starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
        made = _lists(starts, len(code), {"keys": key[order], "tfs": tf[order].astype(np.int32), "dls": dl[order].astype(np.int32)})
        names = ["term", "run", *made]
        yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[starts])).cast(pa.string()), pa.array(run[starts]), *made.values()], names)


def _single(blocks: DataFrame) -> DataFrame:
    """term, run, key, tf, dl, bucket: a row a posting."""
    rows = blocks.select("term", "run", "bucket", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("x"))
    return rows.select("term", "run", F.col("x.keys").alias("key"), F.col("x.tfs").cast("long").alias("tf"), F.col("x.dls").cast("long").alias("dl"), "bucket")


def _listed(postings: DataFrame) -> DataFrame:
    """Postings as blocks again, made in each task."""
    rows = postings.select("term", "run", "key", "tf", "dl").mapInArrow(_list, "term string, run long, keys array<long>, tfs array<int>, dls array<int>")
    return rows.select("*", F.lit(None).cast(_HEAD).alias("head"), bucket(F.col("term")).alias("bucket"))


@dataclass(frozen=True)
class Segments:
    """A lexical index of several weighted fields below ``path``.

    Passages are given as kb_id, source_id, chunk_id and one column a field.
    """

    spark: SparkSession
    path: str
    boosts: dict[str, float]
    tokenise: object = latin_tokens
    #: where the list of segments is kept, if not here: an object with
    #: ``segments()`` and ``hold(segments)``, as of ``store.Change``
    held: object = None

    def version(self) -> tuple[int, list[tuple[int, str]]]:
        """Number of the version in force and its segments (order, name)."""
        if self.held is not None:
            return 0, self.held.segments()
        try:
            rows = self.spark.read.schema("seq int, segment string, v int").parquet(f"{self.path}/live")
            last = rows.agg(F.max("v")).first()[0]
        except AnalysisException:  # nothing was written yet
            last = None
        if last is None:
            return 0, []
        live = rows.where((F.col("v") == last) & (F.col("seq") >= 0)).collect()  # a row a segment
        return last, sorted((r.seq, r.segment) for r in live)

    def _publish(self, version: int, live: list[tuple[int, str]]) -> None:
        if self.held is not None:
            self.held.hold(live)
            return
        rows = self.spark.createDataFrame(live or [(-1, "")], "seq int, segment string")
        rows.coalesce(1).write.parquet(f"{self.path}/live/v={version + 1}")

    def _blocks(self, segment: str) -> DataFrame:
        return self.spark.read.schema(f"{_STORED}, bucket int").parquet(f"{self.path}/postings/{segment}")

    def _rows(self, name: str, live: list[tuple[int, str]]) -> DataFrame:
        """A table's rows in the segments in force, with their order."""
        out = None
        for seq, segment in live:
            try:
                if name == "lengths":
                    rows = self.spark.read.schema(_STORED).parquet(f"{self.path}/postings/{segment}/bucket={BUCKETS}").select("head.*", "run")
                elif name == "postings":
                    rows = _single(self._blocks(segment).where(F.col("bucket") < BUCKETS))
                else:
                    rows = self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}/{segment}")
            except AnalysisException:  # the segment has none
                continue
            rows = rows.withColumn("seq", F.lit(seq))
            out = rows if out is None else out.unionByName(rows)
        # no rows of a size that the planner does not know
        return self.spark.createDataFrame([], f"{_TABLES[name]}, seq int").limit(0) if out is None else out

    def _seen(self, rows: DataFrame, live: list[tuple[int, str]], hidden: bool = False) -> DataFrame:
        """Rows that no tombstone of a later segment hides, or the others.
        Those of the oldest hide nothing; the others are stored, so that few of
        them are broadcast and the rows not moved."""
        if len(live) < 2:
            return rows.limit(0) if hidden else rows
        gone = stored(self._rows("gone", live[1:]))
        sources = gone.where("source_id is not null and chunk_id is null").groupBy("kb_id", "source_id").agg(F.max("seq").alias("_source"))
        whole = gone.where("source_id is null").groupBy("kb_id").agg(F.max("seq").alias("_kb"))
        last = F.greatest(F.coalesce("_source", F.lit(-1)), F.coalesce("_kb", F.lit(-1)))
        rows = rows.join(sources, ["kb_id", "source_id"], "left").join(whole, "kb_id", "left")
        if "chunk_id" in rows.columns:  # sums have the changes of single passages in them
            single = gone.where("chunk_id is not null").groupBy("kb_id", "source_id", "chunk_id").agg(F.max("seq").alias("_chunk"))
            rows = rows.join(single, ["kb_id", "source_id", "chunk_id"], "left").withColumn("_last", F.greatest(last, F.coalesce("_chunk", F.lit(-1)))).drop("_chunk")
        else:
            rows = rows.withColumn("_last", last)
        kept = F.col("seq") >= F.col("_last")
        return rows.where(~kept if hidden else kept).drop("_source", "_kb", "_last")

    def _write(self, segment: str, rows: DataFrame) -> None:
        """``rows`` as stored, and their bucket, in the order of their terms."""
        files = rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd")
        files.parquet(f"{self.path}/postings/{segment}")

    def _tokens(self, passages: DataFrame) -> DataFrame:
        """kb_id, source_id, chunk_id, field, t, dl: a row a field."""
        one = F.array(*[F.struct(F.lit(f).alias("field"), self.tokenise(F.col(f)).alias("t")) for f in self.boosts])
        # a null key is the key ""
        key = [*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("kb_id", "source_id")], F.col("chunk_id").cast("string").alias("chunk_id")]
        rows = passages.select(*key, F.explode(one).alias("x"))
        return rows.select("kb_id", "source_id", "chunk_id", "x.field", "x.t", F.size("x.t").cast("long").alias("dl"))

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kb_id", "source_id", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))

    def _add(self, passages: DataFrame, gone: DataFrame | None, less: DataFrame | None = None) -> None:
        """A segment of ``passages``; ``less`` are sums to take away."""
        version, live = self.version()
        segment, seq = f"segment-{uuid.uuid4().hex}", live[-1][0] + 1 if live else 0
        passages = spread(passages)
        # a number is of the row in its task, so it and the row's lengths come from one run of the task
        rows = self._tokens(passages).withColumn("key", F.monotonically_increasing_id())
        rows = rows.mapInArrow(_count, f"term string, keys array<long>, tfs array<int>, dls array<int>, head {_HEAD}")
        where = F.when(F.col("head").isNotNull(), BUCKETS).otherwise(bucket(F.col("term")))
        rows = rows.withColumns({"run": F.lit(seq).cast("long"), "bucket": where})
        self._write(segment, rows if in_place(passages) else rows.repartition("bucket"))
        sums = self._sums(self._rows("lengths", [(seq, segment)]))
        segment = self._added_up(seq, segment)
        if less is not None:
            sums = sums.unionByName(less).groupBy("kb_id", "source_id", "field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        sums.write.parquet(f"{self.path}/sums/{segment}")
        if gone is not None:
            gone.write.parquet(f"{self.path}/gone/{segment}")
        self._publish(version, [*live, (seq, segment)])

    def _added_up(self, seq: int, segment: str) -> str:
        """The segment, or if passages were given in several rows, another in
        which those of equal lengths are one."""
        rows = self._rows("lengths", [(seq, segment)])
        id_, field = F.xxhash64("kb_id", "source_id", "chunk_id"), next(iter(self.boosts))
        twice = stored(rows.where(F.col("field") == field).groupBy(id_.alias("id")).count().where("count > 1").select("id"))
        if not twice.head(1):
            return segment
        several = rows.withColumn("id", id_).join(twice, "id", "left_semi")
        key = F.min("key").over(Window.partitionBy("kb_id", "source_id", "chunk_id", "field", "dl"))
        several = stored(several.select("key", key.alias("one")))
        blocks = self._blocks(segment)
        rows = _single(blocks.where("head is null")).join(several, "key", "left")
        sums = rows.where("one is not null").groupBy("term", "run", F.col("one").alias("key"), "dl").agg(F.sum("tf").alias("tf"))
        rows = _listed(rows.where("one is null").drop("one", "bucket").unionByName(sums))
        heads = blocks.where("head is not null").join(several, F.col("head.key") == F.col("key"), "left").where("one is null or one = key")
        segment = f"segment-{uuid.uuid4().hex}"
        self._write(segment, rows.unionByName(heads.drop("key", "one")).repartition("bucket"))
        return segment

    def put(self, passages: DataFrame, gone: DataFrame | None = None) -> None:
        """Adds passages in a new segment; ``gone`` (kb_id, source_id, where a
        null source means all of them) hides older rows in the same step."""
        if gone is not None:
            gone = gone.select(F.col("kb_id").cast("string"), F.col("source_id").cast("string"), F.lit(None).cast("string").alias("chunk_id")).distinct()
        self._add(passages, gone)

    def patch(self, old: DataFrame, new: DataFrame) -> None:
        """Puts passages in place of single ones, both given in full: only they
        are tokenised, and lengths change by the difference."""
        before = self._tokens(old)
        less = self._sums(before).select("kb_id", "source_id", "field", (-F.col("n")).alias("n"), (-F.col("total")).alias("total"))
        self._add(new, before.select("kb_id", "source_id", "chunk_id").distinct(), less)

    def replace(self, passages: DataFrame) -> None:
        """Puts passages in place of all that their sources had before."""
        self.put(passages, passages.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("kb_id", "source_id")]))

    def delete(self, kb_id: str, source_id: str | None = None) -> None:
        """Deletes a source, or without one a knowledge base."""
        gone = self.spark.createDataFrame([(kb_id, source_id)], _KEY)
        none = self.spark.createDataFrame([], ", ".join([_KEY, "chunk_id string", *[f"{f} string" for f in self.boosts]]))
        self.put(none, gone)

    def compact(self, keep: int = 0) -> None:
        """Merges all segments but the newest ``keep`` into one."""
        version, live = self.version()
        old, rest = live[: len(live) - keep], live[len(live) - keep :]
        if len(old) < 2:
            return
        segment = f"segment-{uuid.uuid4().hex}"
        sums = self._seen(self._rows("sums", old), old).groupBy("kb_id", "source_id", "field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        sums.write.parquet(f"{self.path}/sums/{segment}")
        total = self.spark.read.schema(_TABLES["sums"]).parquet(f"{self.path}/sums/{segment}").agg(F.sum("total")).first()[0] or 0
        # each bucket of all segments is read by tasks of its own, so that it is merged where it is read
        held = {}
        for _, name in old:
            for b in {int(re.search(r"/bucket=(\d+)/", f)[1]) for f in self._blocks(name).inputFiles()}:
                held.setdefault(b, []).append(f"{self.path}/postings/{name}/bucket={b}")
        # two at least: tasks of one each would be united to one
        tasks, rows = max(2, -(-total // BUCKETS // BUCKET_ROWS)), self.spark.createDataFrame([], f"{_STORED}, bucket int").limit(0)
        for b, paths in sorted(held.items()):
            rows = rows.unionByName(self.spark.read.schema(_STORED).parquet(*paths).coalesce(tasks).withColumn("bucket", F.lit(b)))
        hidden = stored(self._seen(self._rows("lengths", old), old, hidden=True).select("run", "key"))
        if hidden.head(1):  # few are broadcast
            left = _listed(_single(rows.where("head is null")).join(hidden, ["run", "key"], "left_anti"))
            heads = rows.where("head is not null")
            rows = left.unionByName(heads.join(hidden, (heads["run"] == hidden["run"]) & (heads["head.key"] == hidden["key"]), "left_anti"))
        self._write(segment, rows)
        # tombstones of merged segments hide nothing that is left
        self._publish(version, [(old[-1][0], segment), *rest])

    def passages(self) -> int:
        _, live = self.version()
        field = next(iter(self.boosts))
        return self._seen(self._rows("sums", live), live).where(F.col("field") == field).agg(F.sum("n")).first()[0] or 0

    def search(self, terms: Sequence[str], k: int = 50, keep: Column | None = None) -> DataFrame:
        """chunk_id, score: BM25 of the best field, weighted; ``keep`` filters
        by kb_id and source_id after the statistics, which stay global."""
        _, live = self.version()
        sums = self._seen(self._rows("sums", live), live).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        sizes = {r.field: (r.n, r.total / r.n or 1.0) for r in sums.collect()}  # a row a field
        asked = self.spark.createDataFrame([(t,) for t in terms] or [("",)], "t string").select(bucket(F.col("t"))).distinct()
        buckets = [r[0] for r in asked.collect()]
        rows = self._rows("postings", live).where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
        # whose they are; neither side is held whole, and it is done once for counts and scores
        rows = rows.drop("seq", "bucket").hint("merge").join(self._rows("lengths", live).where("dl > 0").drop("dl"), ["run", "key"])
        rows = stored(self._seen(rows, live))
        df = rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # terms x fields at most
        n, avgdl, boost = F.lit(0.0), F.lit(1.0), F.lit(0.0)
        for field, (count, average) in sizes.items():
            at = F.col("field") == field
            n, avgdl = F.when(at, float(count)).otherwise(n), F.when(at, float(average)).otherwise(avgdl)
            boost = F.when(at, float(self.boosts.get(field, 0.0))).otherwise(boost)
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = F.lit(K1) * (1 - F.lit(B) + F.lit(B) * F.col("dl") / avgdl)
        scored = (rows if keep is None else rows.where(keep)).join(F.broadcast(df), ["field", "term"])
        scored = scored.withColumn("s", idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + length) * boost)
        fields = scored.groupBy("chunk_id", "field").agg(F.sum("s").alias("s"))
        best = fields.groupBy("chunk_id").agg(F.round(F.max("s"), 6).alias("score")).where("score > 0")
        return best.orderBy(F.desc("score"), "chunk_id").limit(k)


def write_index(passages: DataFrame, path: str, id_col: str, text: Column) -> None:
    """An index of one field, in one segment, below ``path``."""
    rows = passages.select(F.lit("").alias("kb_id"), F.lit("").alias("source_id"), F.col(id_col).alias("chunk_id"), text.alias("text"))
    Segments(passages.sparkSession, path, {"text": 1.0}).replace(rows)


def search_index(spark: SparkSession, path: str, terms: Sequence[str], k: int = 50) -> DataFrame:
    """chunk_id (a string), score of the best passages of such an index."""
    return Segments(spark, path, {"text": 1.0}).search(terms, k)


def upsert_vectors(known: DataFrame, fresh: DataFrame, key: str = "point_id", vec: str = "vec") -> DataFrame:
    """``known`` with the points of ``fresh`` added or replaced.  Vectors of
    another length than the fresh ones' make the collection start anew."""
    dim = fresh.agg(F.max(F.size(vec))).first()[0]
    if fresh.where(F.size(vec) != dim).head(1):
        raise ValueError("vectors of several lengths")
    kept = known.where(F.size(vec) == dim).join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh)


def delete_points(known: DataFrame, **where) -> DataFrame:
    """``known`` without the points that have all the given values."""
    hit = None
    for name, value in where.items():
        one = F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
        hit = one if hit is None else hit & one
    return known if hit is None else known.where(~F.coalesce(hit, F.lit(False)))
