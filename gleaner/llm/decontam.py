"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the windows of ``width`` consecutive words of the
benchmark items (a shorter item is one window).  For each window length there
is one searcher: a shift table over blocks of two words says how far the
search may jump, so most positions of a text are never looked at; where the
jump is zero, the hash of the last block selects a bucket of test strings, and
these are compared directly, word by word and then byte by byte.

The windows are cut and made distinct by Spark, and sent to the workers in
shards of ``shard_bytes`` at most, as the searcher takes them in memory.  With
more than one shard each is a job of its own over the texts, whose broadcast is
destroyed before the next one's; the hit spans are merged by text afterwards.

Edge cases: null and empty texts have no words and are never contaminated;
items without words are ignored; an item with a null id marks words but is not
named; repeated ids count once; empty tables give no hits or no rows.  Other
columns are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Bloom, bound_batches, cut
from gleaner.llm.textcols import ALNUM, lowered, mix, slices, word_hashes, words

RESULT = "struct<n_words: long, spans: array<int>, items: array<long>>"
_LANE = 512
_C = np.uint64(0x9FB21C651E98DF25)


class Searcher:
    """All test strings of one length, in words."""

    def __init__(self, length: int, hashes: np.ndarray, texts: pa.Array, items: pa.Array):
        self.length, self.block = length, min(2, length)
        suffix = self._block(hashes, length - 1)
        order = np.argsort(suffix, kind="stable")
        self.hashes, self.suffix = hashes[order], suffix[order]
        self.texts, self.items = texts.take(pa.array(order)), items.take(pa.array(order))
        bits = max(12, int(np.ceil(np.log2(max(1, hashes.size)))) + 3)
        self.mask = np.uint64((1 << bits) - 1)
        # a jump that is too short is never wrong, so one byte will do
        self.shift = np.full(1 << bits, min(255, length - self.block + 1), dtype=np.uint8)
        for end in range(self.block - 1, length):
            at = (self._block(hashes, end) & self.mask).astype(np.int64)
            self.shift[at] = np.minimum(self.shift[at], np.uint8(min(255, length - 1 - end)))

    def _block(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self._join(rows[:, end - 1] if self.block == 2 else None, rows[:, end])

    @staticmethod
    def _join(first: np.ndarray | None, second: np.ndarray) -> np.ndarray:
        return mix(second if first is None else (first * _C) ^ second)

    def _at(self, wh: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return self._join(wh[pos - 1] if self.block == 2 else None, wh[pos])

    def find(self, wh: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, test string) of the occurrences by word hashes."""
        first, stop = begin[:-1] + self.length - 1, begin[1:]
        lanes = np.maximum(0, -(-(stop - first) // _LANE))
        owner = np.repeat(np.arange(len(first)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = first[owner] + nth * _LANE
        end = np.minimum(pos + _LANE, stop[owner])
        found = []
        while len(pos):
            jump = self.shift[(self._at(wh, pos) & self.mask).astype(np.int64)]
            if (zero := jump == 0).any():
                found.append(pos[zero])
            pos = pos + np.maximum(jump, 1).astype(np.int64)
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.concatenate(found)
        key = self._at(wh, pos)
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        n = high - low
        out_p, out_t = [], []
        for s in range(0, len(pos), 1 << 14):
            c = n[s : s + (1 << 14)]
            p = np.repeat(pos[s : s + (1 << 14)], c)
            t = np.repeat(low[s : s + (1 << 14)], c) + np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
            for k in range(self.length - 1, -1, -1):
                if not len(p):
                    break
                same = wh[p - (self.length - 1 - k)] == self.hashes[t, k]
                p, t = p[same], t[same]
            out_p.append(p)
            out_t.append(t)
        return np.concatenate(out_p), np.concatenate(out_t)


def _cut_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (k, words, hashes, item): each window of ``width`` words."""
    for b in batches:
        k, joined, hashes, item = [], [], [], []
        for row in range(b.num_rows):
            _, _, data, off = next(slices(b.column(1).slice(row, 1)))
            s, e, _ = words(data, off, ALNUM)
            n = min(width, len(s))
            wh, low = word_hashes(data, s, e), lowered(data).tobytes()
            ws = [low[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
            for i in range(len(s) - n + 1 if n else 0):
                k.append(n)
                joined.append(b" ".join(ws[i : i + n]))
                hashes.append(wh[i : i + n].tobytes())
                item.append(b.column(0)[row].as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(joined, pa.binary()), pa.array(hashes, pa.binary()), pa.array(item, pa.int64())],
            ["k", "words", "hashes", "item"],
        )


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """k, words, hashes, items: the distinct windows and the items they are in."""
    bound_batches(benchmark.sparkSession)
    b = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    cuts = b.mapInArrow(lambda it: _cut_windows(it, width), "k int, words binary, hashes binary, item long")
    return cuts.groupBy("k", "words").agg(F.first("hashes").alias("hashes"), F.sort_array(F.collect_set("item")).alias("items"))


def searchers(table: pa.Table) -> list[Searcher]:
    """One searcher for each length among the windows of a shard."""
    found = []
    t = table.combine_chunks()
    k = t.column("k").to_numpy()
    for n in np.unique(k).tolist():
        part = t.filter(pa.array(k == n)).combine_chunks()
        hashes = np.frombuffer(b"".join(part.column("hashes").to_pylist()), dtype=np.uint64).reshape(-1, n)
        texts, items = (part.column(c).combine_chunks() for c in ("words", "items"))
        found.append(Searcher(n, hashes, texts, items))
    return found


def scan(column: pa.Array, found_by: list[Searcher]) -> pa.Array:
    """n_words, merged hit spans [first, last, ...] in words, and item ids."""
    n_words = np.zeros(len(column), dtype=np.int64)
    spans: list[list[int]] = [[] for _ in range(len(column))]
    items: list[list[int]] = [[] for _ in range(len(column))]
    for at, rows, data, off in slices(column):
        starts, ends, begin = words(data, off, ALNUM)
        n_words[at : at + rows] = np.diff(begin)
        wh = word_hashes(data, starts, ends)
        low = None
        edge = np.zeros(len(starts) + 1, dtype=np.int32)
        per_doc: dict[int, set[int]] = {}
        for s in found_by:
            pos, which = s.find(wh, begin)
            if not len(pos):
                continue
            low = lowered(data).tobytes() if low is None else low
            doc = np.searchsorted(begin, pos, side="right") - 1
            for p, t, d in zip(pos.tolist(), which.tolist(), doc.tolist(), strict=True):
                first = p - s.length + 1
                if b" ".join([low[starts[i] : ends[i]] for i in range(first, p + 1)]) == s.texts[t].as_py():
                    edge[first] += 1
                    edge[p + 1] -= 1
                    per_doc.setdefault(d, set()).update(s.items[t].as_py())
        # over all texts at once: what ends with a text counts down in the next
        covered = np.cumsum(edge) > 0 if per_doc else edge
        for d, got in per_doc.items():
            items[at + d] = sorted(got)
            hit = covered[begin[d] : begin[d + 1]]
            step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            both = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1], axis=1)
            spans[at + d] = both.reshape(-1).tolist()
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
        ["n_words", "spans", "items"],
    )


def _scanner(shared):
    @F.arrow_udf(RESULT)
    def search(text: pa.Array) -> pa.Array:
        return scan(text, shared.value)

    return search


def _shards(benchmark: DataFrame, item_col: str, text_col: str, width: int, shard_bytes: int) -> list[DataFrame]:
    """The windows in parts that take about ``shard_bytes`` in memory."""
    every = cut(windows(benchmark, item_col, text_col, width))
    # hashes, their share of the shift table and the sort key, words, items
    each = F.col("k") * 24 + F.length("words") + F.size("items") * 8 + 32
    size = every.agg(F.sum(each)).first()[0] or 0
    n = -(-size // shard_bytes) or 1
    part = F.pmod(F.xxhash64("words"), F.lit(n))
    return [every.where(part == i) for i in range(n)]


def _hit_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(x, text) -> x, key, spans, items of the texts with a hit."""
    for b in batches:
        got = scan(b.column(1), shared.value)
        spans, items = got.field("spans"), got.field("items")
        hit = np.flatnonzero(spans.value_lengths().to_numpy(zero_copy_only=False) > 0)
        at = pa.array(hit)
        key = [hashlib.sha256(t.encode()).digest() for t in b.column(1).take(at).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), pa.array(key, pa.binary()), spans.take(at), items.take(at)], ["x", "key", "spans", "items"]
        )


def _positions(spans: Column) -> Column:
    """The positions inside the spans."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int"))

    def inside(k: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.when(k * 2 + 1 < F.size(spans), F.sequence(F.get(spans, k * 2), F.get(spans, k * 2 + 1))).otherwise(none)

    return F.flatten(F.transform(pairs, inside))


def _runs(positions: Column) -> Column:
    """Spans (first, last, first, last, ...) of sorted distinct positions."""

    def spans(p: Column) -> Column:
        starts = F.filter(p, lambda w, i: (i == 0) | (w > F.get(p, i - 1) + 1))
        ends = F.filter(p, lambda w, i: (i == F.size(p) - 1) | (w < F.get(p, i + 1) - 1))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b)))

    # bound once, so that no position computes them all again
    return F.get(F.transform(F.array(positions), spans), F.lit(0))


def _n_hit(spans: Column) -> Column:
    """Words covered by merged spans."""
    starts = F.filter(spans, lambda _, i: i % 2 == 0)
    ends = F.filter(spans, lambda _, i: i % 2 == 1)
    zero = F.lit(0).cast("long")
    return F.aggregate(F.zip_with(starts, ends, lambda a, b: (b - a + 1).cast("long")), zero, lambda x, y: x + y)


def _marked(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, width: int, shard_bytes: int) -> DataFrame:
    """``docs`` with a struct column ``__gl_c``: n_words, spans, items."""
    spark = docs.sparkSession
    bound_batches(spark)
    shards = _shards(benchmark, item_col, item_text, width, shard_bytes)
    if len(shards) == 1:
        shared = spark.sparkContext.broadcast(searchers(shards[0].toArrow()))
        return docs.withColumn("__gl_c", _scanner(shared)(F.col(text_col)))
    return _merged(docs, [_hits(docs, shard, text_col) for shard in shards], text_col)


def _hits(docs: DataFrame, shard: DataFrame, text_col: str) -> DataFrame:
    """x, key, spans, items of the distinct texts that one shard hits."""
    shared = docs.sparkSession.sparkContext.broadcast(searchers(shard.toArrow()))
    rows = docs.select(F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(lambda it: _hit_rows(it, shared), "x long, key binary, spans array<int>, items array<long>")
    found = cut(found.dropDuplicates(["key"]))
    shared.destroy()
    return found


def _merged(docs: DataFrame, found: list[DataFrame], text_col: str) -> DataFrame:
    """The hits of all shards at their texts.  Texts without one stay in place."""
    every = reduce(DataFrame.unionByName, found)
    words_hit = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", _positions))))
    table = (
        every.groupBy("key")
        .agg(F.first("x").alias("x"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
        .select(
            F.col("key").alias("__gl_key"),
            F.col("x").alias("__gl_x"),
            _runs(words_hit).alias("__gl_spans"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("__gl_items"),
        )
    )
    table = cut(table)
    known = Bloom(table, "__gl_x")

    @F.arrow_udf("long")
    def n_words(text: pa.Array) -> pa.Array:
        return scan(text, []).field("n_words")

    rows = docs.withColumn("__gl_x", F.xxhash64(text_col)).withColumn("__gl_n", n_words(F.col(text_col)))
    seen = known.might_contain("__gl_x")
    none = F.lit(None)
    clear = rows.where(~seen).withColumns({"__gl_spans": none.cast("array<int>"), "__gl_items": none.cast("array<long>")})
    met = rows.where(seen).withColumn("__gl_key", F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)))
    met = met.join(table.drop("__gl_x"), "__gl_key", "left").drop("__gl_key")
    both = clear.unionByName(met)
    empty = F.array()
    return both.withColumn(
        "__gl_c",
        F.struct(
            F.col("__gl_n").alias("n_words"),
            F.coalesce("__gl_spans", empty.cast("array<int>")).alias("spans"),
            F.coalesce("__gl_items", empty.cast("array<long>")).alias("items"),
        ),
    ).drop("__gl_x", "__gl_n", "__gl_spans", "__gl_items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    share: int = 20,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """One row for each row: doc_id, n_words, n_hit, spans (word positions of
    the hits, first and last in turn), items, contaminated (a hit, and at least
    one word in ``share`` is hit)."""
    rows = _marked(docs.select(id_col, text_col), benchmark, text_col, item_col, item_text, width, shard_bytes)
    n_hit = _n_hit(F.col("__gl_c.spans"))
    return rows.select(id_col, "__gl_c").select(
        id_col,
        F.col("__gl_c.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.col("__gl_c.spans").alias("spans"),
        F.col("__gl_c.items").alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("__gl_c.n_words"))).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    share: int = 20,
    shard_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` without the contaminated rows, all columns."""
    rows = _marked(docs, benchmark, text_col, item_col, item_text, width, shard_bytes)
    n_hit = _n_hit(F.col("__gl_c.spans"))
    return rows.where((n_hit == 0) | (n_hit * share < F.col("__gl_c.n_words"))).drop("__gl_c")
