"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed terms: character 4-grams of its layout (case,
digits, punctuation, with runs of letters shortened), byte 3-grams, and how
often words repeat close by.  Counts are weighted by inverse frequency and
projected on the leading singular vectors of a bounded sample of labelled
texts.  The sample's vectors are broadcast; every text is compared with all of
them by blocked matrix products, and the nearest vote, weighted by similarity.

Edge cases: null and empty texts have no terms and get the sample's share of
label 1; without labelled rows every score is 0.5; labels other than 0 and 1,
and rows with a null label or id, are not learned from; of several labels for
one id all count; an empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import bound_batches
from gleaner.llm.textcols import NOT_SPACE, slices, word_hashes, words

LAYOUT, BYTES, REPEAT = 2048, 1024, 16
DIM = LAYOUT + BYTES + REPEAT
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[[9, 11, 12, 13]] = 32


def _hashed(c: np.ndarray, width: int, bits: int) -> np.ndarray:
    n = len(c) - width + 1
    h = np.zeros(n, dtype=np.uint32)
    for k in range(width):
        h = h * np.uint32(0x01000193) ^ c[k : k + n]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Term counts (rows x DIM) for parts of a column, in order."""
    for _, rows, data, off in slices(column, 1 << 20):
        x = np.zeros((rows, DIM), dtype=np.float32)
        doc = np.repeat(np.arange(rows), np.diff(off)).astype(np.int64)
        # layout: of a run of letters of one case at most two are left
        c = _CLASS[data]
        keep = np.ones(len(c), dtype=bool)
        if len(c) > 2:
            run = (c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & ((c[2:] == 97) | (c[2:] == 65))
            keep[2:] = ~run
        for codes, owner, width, bits, at, size in (
            (c[keep], doc[keep], 4, 11, 0, LAYOUT),
            (data, doc, 3, 10, LAYOUT, BYTES),
        ):
            if len(codes) < width:
                continue
            h = _hashed(codes.astype(np.uint32), width, bits)
            one = owner[: len(h)] == owner[width - 1 :]
            key = (owner[: len(h)] * size + h)[one]
            x[:, at : at + size] = np.bincount(key, minlength=rows * size).reshape(rows, size)
        # does a word equal the one before, two before, ...; or none of them
        starts, ends, begin = words(data, off, NOT_SPACE)
        wh, of = word_hashes(data, starts, ends), np.repeat(np.arange(rows), np.diff(begin))
        fresh = np.ones(len(wh), dtype=bool)
        for k in range(1, 9):
            same = (wh[k:] == wh[:-k]) & (of[k:] == of[:-k])
            x[:, LAYOUT + BYTES + k] = np.bincount(of[k:][same], minlength=rows)
            fresh[k:] &= ~same
        x[:, LAYOUT + BYTES] = np.bincount(of[fresh], minlength=rows)
        yield x


class Space:
    """Latent-semantic space of labelled texts, and the vote in it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, power: float):
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        w = self._weighted(x)
        # leading right singular vectors, by iterating on a random block
        block = np.random.Generator(np.random.PCG64(3)).standard_normal((w.shape[1], min(rank, *w.shape))).astype(np.float32)
        for _ in range(6):
            block, _ = np.linalg.qr(w.T @ (w @ block))
        self.axes = block
        self.vectors = self._unit(w @ block)
        self.labels = labels.astype(np.float32)
        self.neighbours, self.power, self.base = min(neighbours, len(x)), power, float(labels.mean())

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for a, b, share in ((0, LAYOUT, 1.0), (LAYOUT, LAYOUT + BYTES, 0.5), (LAYOUT + BYTES, DIM, 1.0)):
            v = x[:, a:b] / np.maximum(x[:, a:b].sum(axis=1, keepdims=True), 1)
            v = np.sqrt(v) * (self.idf[a:b] if a < LAYOUT + BYTES else 1)
            parts.append(share * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6))
        return np.hstack(parts)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)

    def score(self, x: np.ndarray, rows: int = 256) -> np.ndarray:
        out = np.full(len(x), self.base)
        full = np.flatnonzero(x.any(axis=1))
        z = self._unit(self._weighted(x[full]) @ self.axes)
        for i in range(0, len(full), rows):
            cos = z[i : i + rows] @ self.vectors.T
            k = self.neighbours
            near = np.argpartition(cos, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k :]
            weight = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-3) ** self.power
            vote = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            out[full[i : i + rows]] = vote
        return np.clip(out, 0.0, 1.0)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str,
    label_col: str,
    id_col: str,
    sample_rows: int,
    rank: int,
    neighbours: int,
    power: float,
) -> Space | None:
    """Space of about ``sample_rows`` labelled rows, chosen by hash of the id.

    The labels are sampled first, so what is broadcast to find their texts has
    a fixed size, and no text is moved.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    n = known.count()
    h = F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(1 << 30))
    few = known.where(h < int((1 << 30) * min(1.0, sample_rows / max(1, n))))
    some = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("_text"))
    some = some.join(F.broadcast(few), F.col("_d") == F.col("_id")).select("_id", "_y", "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for x in counts(b.column(2)):
                part = b.slice(at, len(x))
                at += len(x)
                packed = pa.array([np.minimum(v, 65535).astype(np.uint16).tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.int32()), packed], ["id", "label", "x"]
                )

    got = some.mapInArrow(rows, "id long, label int, x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["id", "label"], kind="stable")
    x = np.stack([np.frombuffer(v, dtype=np.uint16) for v in got["x"]]).astype(np.float32)
    return Space(x, got["label"].to_numpy(), rank, neighbours, power)


def scorer(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    label_col: str = "quality",
    id_col: str = "doc_id",
    sample_rows: int = 3000,
    rank: int = 64,
    neighbours: int = 15,
    power: float = 8.0,
):
    """A function of a text column: the score that its label is 1.

    ``labels``: rows of ``id_col`` and ``label_col`` to learn from; about
    ``sample_rows`` of them are used, so that the vectors broadcast have a
    fixed size.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(
        learn(docs, labels, text_col, label_col, id_col, sample_rows, rank, neighbours, power)
    )

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        space, out = shared.value, []
        for x in counts(text):
            out.append(space.score(x) if space else np.full(len(x), 0.5))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def keep_good(docs: DataFrame, score: Column, least: float = 0.3) -> DataFrame:
    """``docs`` whose score reaches ``least``, all columns."""
    return docs.withColumn("__gl_score", score).where(F.col("__gl_score") >= least).drop("__gl_score")
