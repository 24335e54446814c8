"""Runs of words that repeat with a period, found by divide and conquer.

Words of a text are interned to ids.  A segment is halved until it is shorter
than a run may be; a run that lies over a midpoint is found there, from the
values of the Z-functions of both halves: for a period p, how far the words
from the midpoint on equal those p further on, and how far back the words
before it equal those p before.  All midpoints of one depth, of all texts of a
batch, are treated at once.  The first four words are compared directly (a run
of three periods and 24 words agrees in so many at its midpoint, on one side or
the other); where they agree, the Z-value is found by bisection over prefix
sums of word hashes, up to the ends of the text, which also extends the run to
its full length.  Equal intervals are kept once, with the smallest period.
Hashes only propose: the words of each run are compared before it counts, and a
text in which that fails is done again with other hashes.

Edge cases: null and empty texts, and texts without words, have no runs and no
words; null and repeated ids are rows like others; an empty table gives an
empty one; columns but the id and the text are ignored.  A text is handled in
one task in memory of some 100 bytes a word; pairs of a midpoint and a period
are made in blocks, so that none of it grows with the square of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bound_batches
from gleaner.llm.textcols import NOT_SPACE, mix, slices, words

_U = np.uint64


def interned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Id of each word, by its bytes, and the words of the ids."""
    bounds = np.empty(2 * len(starts) + 1, dtype=np.int64)
    bounds[0:-1:2], bounds[1::2] = starts, ends
    bounds[-1] = ends[-1] if len(ends) else 0
    # words and what is between them, in turn
    raw = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = raw.take(pa.array(np.arange(0, len(raw), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int32), coded.dictionary


class Sums:
    """Prefix sums of word hashes: stretches of equal words have equal sums,
    once those are brought to the same place."""

    def __init__(self, ids: np.ndarray, seed: int):
        n = len(ids)
        base = int(mix(np.array([2 * seed + 1], dtype=np.uint64))[0]) | 1
        self.up = np.full(n + 1, base, dtype=np.uint64)
        self.up[0] = 1
        np.cumprod(self.up, out=self.up)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * self.up[:n], out=self.sums[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from i on are those from j on (i < j)."""
        return (self.sums[i + n] - self.sums[i]) * self.up[j - i] == self.sums[j + n] - self.sums[j]

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, ``most`` at most."""
        low, high = np.zeros(len(i), dtype=np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            k = (low + high + 1) // 2
            same = self.equal(i, j, k)
            low, high = np.where(open_ & same, k, low), np.where(open_ & ~same, k - 1, high)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before i and before j."""
        low, high = np.zeros(len(i), dtype=np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            k = (low + high + 1) // 2
            same = self.equal(i - k, j - k, k)
            low, high = np.where(open_ & same, k, low), np.where(open_ & ~same, k - 1, high)
        return low


def _crossing(ids: np.ndarray, sums: Sums, mid: np.ndarray, room: np.ndarray, ahead: bool, bounds: tuple[np.ndarray, np.ndarray], least: int, powers: int) -> list[np.ndarray]:
    """(start, end, period) of runs over midpoints of which the half ahead
    (or behind), ``room`` words long, holds the larger part."""
    found, first, last = [], *bounds
    # that part is half a run at least: 1.5 of its 3 periods
    count = np.maximum(room * 2 // powers, 0)
    at, block = 0, 1 << 21
    total = np.concatenate(([0], np.cumsum(count)))
    while at < total[-1]:
        to = min(at + block, int(total[-1]))
        k = np.arange(at, to)
        s = np.searchsorted(total, k, side="right") - 1
        p = k - total[s] + 1
        m = mid[s]
        at = to
        if ahead:  # words m, m+1, ... against m+p, m+p+1, ...
            i, j = m, m + p
            sides = [(i + d, j + d) for d in range(4)]
        else:  # words m-1, m-2, ... against m-p-1, m-p-2, ...
            i, j = m - p, m
            sides = [(i - d, j - d) for d in range(1, 5)]
        ok = np.ones(len(p), dtype=bool)
        live = np.arange(len(p))
        for x, y in sides:
            x, y = x[live], y[live]
            inside = (x >= first[s[live]]) & (y < last[s[live]])
            live, x, y = live[inside], x[inside], y[inside]
            live = live[ids[x] == ids[y]]
        if not len(live):
            continue
        i, j, s, p = i[live], j[live], s[live], p[live]
        e = j + sums.forward(i, j, last[s] - j)
        b = i - sums.backward(i, j, i - first[s])
        long = e - b >= np.maximum(least, powers * p)
        if long.any():
            found.append(np.stack([b[long], e[long], p[long]]))
    return found


def find_runs(ids: np.ndarray, begin: np.ndarray, least: int = 24, powers: int = 3, seed: int = 0) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs of the texts whose words
    are ``ids[begin[k]:begin[k + 1]]``, in order of start and period."""
    found = []
    texts = np.flatnonzero(np.diff(begin) >= least)
    left, right, of = begin[texts].astype(np.int64), begin[texts + 1].astype(np.int64), texts
    sums = Sums(ids, seed)
    while len(left):
        mid = (left + right) // 2
        bounds = begin[of].astype(np.int64), begin[of + 1].astype(np.int64)
        found += _crossing(ids, sums, mid, right - mid, True, bounds, least, powers)
        found += _crossing(ids, sums, mid, mid - left, False, bounds, least, powers)
        left, right, of = np.concatenate((left, mid)), np.concatenate((mid, right)), np.concatenate((of, of))
        open_ = right - left >= least
        left, right, of = left[open_], right[open_], of[open_]
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    runs = np.unique(np.concatenate(found, axis=1).T, axis=0)
    same = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    runs = runs[np.concatenate(([True], ~same))]
    for s, e, p in runs.tolist():
        if not np.array_equal(ids[s : e - p], ids[s + p : e]) or _extends(ids, begin, s, e, p):
            return find_runs(ids, begin, least, powers, seed + 1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _extends(ids: np.ndarray, begin: np.ndarray, s: int, e: int, p: int) -> bool:
    k = int(np.searchsorted(begin, s, side="right")) - 1
    return bool((s > begin[k] and ids[s - 1] == ids[s + p - 1]) or (e < begin[k + 1] and ids[e] == ids[e - p]))


def _longest(length: np.ndarray, period: np.ndarray) -> int:
    """Index of the greatest length / period, the first of equal ones."""
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-12)).tolist()
    best = near[0]
    for k in near[1:]:
        if int(length[k]) * int(period[best]) > int(length[best]) * int(period[k]):
            best = k
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, powers: int = 3) -> DataFrame:
    """One row a text: ``runs``, an array of (start, length, period) in words,
    by start, then period; ``strongest``, the index of the one of greatest
    length / period (ties: the first), null without runs; and ``collapsed``, the
    words, joined by one space, without those that lie in a run after its first
    period.

    A run has ``least`` words and ``powers`` (3 or more) periods at least.
    """
    if powers < 3 or least < 8 * powers:
        raise ValueError("runs of fewer than three periods, or 24 words, are not told from chance by four words")
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows, data, off in slices(b.column(1), 1 << 22):
                starts, ends, begin = words(data, off, NOT_SPACE)
                ids, names = interned(data, starts, ends)
                runs = find_runs(ids, begin, least, powers)
                doc = np.searchsorted(begin, runs[:, 0], side="right") - 1
                own = np.searchsorted(doc, np.arange(rows + 1))
                length, period = runs[:, 1] - runs[:, 0], runs[:, 2]
                best = [_longest(length[x:y], period[x:y]) if y > x else None for x, y in zip(own[:-1], own[1:], strict=True)]
                depth = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(depth, runs[:, 0] + period, 1)
                np.add.at(depth, runs[:, 1], -1)
                kept = np.cumsum(depth[:-1]) == 0
                left = pa.array(np.concatenate(([0], np.cumsum(kept)))[begin].astype(np.int64))
                text = names.take(pa.array(ids[kept]))
                joined = pc.binary_join(pa.LargeListArray.from_arrays(left, text), pa.scalar(b" ", pa.large_binary()))
                of_runs = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begin[doc]), pa.array(length), pa.array(period)], fields=list(entry))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, rows),
                        pa.array(np.diff(begin), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), of_runs),
                        pa.array(best, pa.int32()),
                        pc.cast(joined, pa.string(), safe=False),
                    ],
                    ["id", "n_words", "runs", "strongest", "collapsed"],
                )

    schema = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, strongest int, collapsed string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(task, schema).withColumnRenamed("id", id_col)
