"""Alignment of two tokenizers on the same bytes.

A text, with one space before it, is cut into stretches where both tokenizers
must cut it: before a single space that follows a visible character.  A stretch
is tokenised once by each side and its token ends are written as one label a
byte: ``0`` none, ``1`` end of an A token, ``2`` end of a B token, ``3`` both.
A regular expression takes spans up to each ``3``; the labels counted in a span
say how many tokens of each side form the group.  Every label but ``0`` is one
link: the A and the B token that hold that byte.  Words repeat, so a worker
keeps what it knows of a bounded number of stretches.

The links of each text are pre-aggregated by id pair in the task that reads it,
and written once with the text's counts; texts are neither moved nor tokenised
again.  Pair counts are an aggregate of that table.  The commonest pairs (at
most ``hot_pairs``, found by a histogram of counts) and the highest count of
each B id (at most its vocabulary) are broadcast and looked up in place; all
rarer pairs, none of which can be a hot key, meet their counts by a join.

Edge cases: null and empty texts, and texts whose A or B bytes are not those of
the text with a space before it, have no tokens: zeros and an empty groups
column.  Special tokens are never made; their strings are plain text.  Null and
repeated ids are rows like others; an empty table gives an empty one; columns
but the id and the text are ignored.  A text without spaces is one stretch,
however long; a text of any length is otherwise held with its stretches' slots
(8 bytes each) only.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bound_batches, written
from gleaner.llm.textcols import slices

#: How byte-level vocabularies cut a text into words before merging (fixed value).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GROUP = re.compile(rb"[^3]*3")
#: of a stretch: A tokens, B tokens, groups, links, groups as text (a semicolon after each), id pairs of the links (int64)
Fact = tuple[int, int, int, int, bytes, bytes]
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 letters stand
    for themselves, the other bytes for the letters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers (A: a byte-level BPE vocabulary in JSON; B: a piece model) and what is known of stretches already seen."""

    def __init__(self, byte_bpe: str, pieces: str, keep: int = 350_000, keep_bytes: int = 24 << 20):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        self.b = SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        with open(byte_bpe, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        # ids are in the order of merges, so they are the ranks; no special tokens
        ranks = {token: i for i, token in self.a_bytes.items()}
        self.a = tiktoken.Encoding(byte_bpe, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.n_b = self.b.get_piece_size()
        self.b_bytes, whole = [], True
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            whole &= re.search("[^▁]▁", piece) is None
            byte = _BYTE_PIECE.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.may_cut = whole  # no piece runs over the space before a word
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.a_len = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        self.a_len[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        names = [str(i).encode() for i in range(max(len(self.a_len), self.n_b))]
        self.decimals = [np.array([n + end for n in names], dtype=object) for end in (b",", b"|", b";")]
        self.keep, self.keep_bytes, self.size = keep, keep_bytes, 0
        self.young: dict[bytes, Fact | None] = {}
        self.old: dict[bytes, Fact | None] = {}

    def aligned(self, stretches: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[Fact | None]:
        """The facts of each stretch, or None where the tokens do not spell it."""
        good = range(len(stretches))
        ends = np.cumsum([len(s) for s in stretches])
        ids = [np.fromiter(chain.from_iterable(x), dtype=np.int64) for x in (a, b)]
        spelt = b"".join(stretches)
        for side, flat, spell, size in ((a, ids[0], self.a_bytes, self.a_len), (b, ids[1], self.b_bytes, self.b_len)):
            to = np.concatenate(([0], np.cumsum(size[flat])))[np.cumsum([len(x) for x in side])]
            if not np.array_equal(to, ends) or b"".join([spell[i] for i in flat.tolist()]) != spelt:
                good = [k for k in good if b"".join([spell[i] for i in side[k]]) == stretches[k]]
        out: list[Fact | None] = [None] * len(stretches)
        if not good:
            return out
        if len(good) < len(stretches):
            ends = np.cumsum([len(stretches[k]) for k in good])
            ids = [np.fromiter(chain.from_iterable(x[k] for k in good), dtype=np.int64) for x in (a, b)]
        ids_a, ids_b = ids
        ends_a, ends_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        labels = np.full(ends_a[-1], 48, dtype=np.uint8)
        labels[ends_a - 1] += 1
        labels[ends_b - 1] += 2
        # a stretch ends with both tokens, so no span runs over its end
        spans = _GROUP.findall(labels.tobytes())
        n_a = np.array([span.count(b"1") for span in spans]) + 1
        n_b = np.array([span.count(b"2") for span in spans]) + 1
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        # the A tokens of a group, then its B tokens, each with what follows it
        said = np.empty(len(ids_a) + len(ids_b), dtype=object)
        comma, bar, semicolon = self.decimals
        for ids, to, of, last in (
            (ids_a, to_a, np.arange(len(ids_a)) + np.repeat(to_b - n_b, n_a), bar),
            (ids_b, to_b, np.arange(len(ids_b)) + np.repeat(to_a, n_b), semicolon),
        ):
            said[of] = comma[ids]
            said[of[to - 1]] = last[ids[to - 1]]
        said = said.tolist()
        at = np.flatnonzero(labels > 48)
        label = labels[at] - 48
        x, y = np.cumsum(label & 1) - (label & 1), np.cumsum(label >> 1) - (label >> 1)
        pairs = (ids_a[x] * self.n_b + ids_b[y]).tobytes()
        group_at = np.searchsorted(at[label == 3], ends)
        link_at, said_at = np.searchsorted(at, ends).tolist(), (to_a + to_b)[group_at - 1].tolist()
        g = u = w = 0
        for k, h, v, z in zip(good, group_at.tolist(), link_at, said_at, strict=True):
            out[k] = (len(a[k]), len(b[k]), h - g, v - u, b"".join(said[w:z]), pairs[8 * u : 8 * v])
            g, u, w = h, v, z
        return out

    def look_up(self, stretches: list[bytes]) -> list[Fact | None]:
        """The facts of each stretch; new ones are tokenised.

        What is known is kept in two generations: a full young one becomes the
        old one, and what is met again moves on to the young one.
        """
        new, young, old = [], self.young, self.old
        for s in stretches:
            if s not in young:
                if s in old:
                    young[s] = old[s]
                else:
                    new.append(s)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            texts = [s.decode("utf-8", "replace") for s in part]
            encode = self.a.encode_ordinary
            found_a = [encode(t) for t in texts]
            found_b = self.b.encode([t[1:] for t in texts], num_threads=1)
            young.update(zip(part, self.aligned(part, found_a, found_b), strict=True))
            self.size += sum(map(len, part))
        facts = [young[s] for s in stretches]
        if len(young) > self.keep or self.size > self.keep_bytes:
            self.young, self.old, self.size = {}, young, 0
        return facts


def stretch_ends(data: np.ndarray, off: np.ndarray, may_cut: bool) -> np.ndarray:
    """Ends of the stretches of texts, each of which starts with a space."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if may_cut and n > 2:
        seen = (data > 32) & (data < 127)
        before, after = data[:-2], seen[2:]
        cut[1 : n - 1] = (data[1:-1] == 32) & (seen[:-2] | ((before >= 128) & after))
        # a text's last byte is never a stretch of its own
        last = off[1:] - 1
        cut[last[last > 0]] = False
    cut[off] = True
    return np.flatnonzero(cut)[1:] if n else np.zeros(0, dtype=np.int64)


@lru_cache(maxsize=2)
def _aligner(byte_bpe: str, pieces: str) -> Aligner:
    return Aligner(byte_bpe, pieces)


def _spaced(texts: pa.Array) -> pa.Array:
    """Each text after one space; nulls stay null."""
    import pyarrow.compute as pc

    kind = pa.large_binary()
    return pc.binary_join_element_wise(pa.scalar(b"", kind), texts.cast(kind), pa.scalar(b" ", kind))


def _measured(aligner: Aligner, texts: pa.Array, digest: bool) -> Iterator[tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]]:
    """For parts of a column, in order: counts (rows x 4: A, B, groups, links),
    groups of each row, its id pairs and how often each is linked."""
    for _, rows, data, off in slices(_spaced(texts), 1 << 22):
        ends = stretch_ends(data, off, aligner.may_cut)
        bounds = np.concatenate(([0], ends)).astype(np.int64)
        raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = raw.dictionary_encode()
        slot, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        facts = aligner.look_up(names)
        sizes = np.array([f[:4] if f else (0, 0, 0, 0) for f in facts], dtype=np.int64).reshape(-1, 4)
        bad = np.array([f is None for f in facts], dtype=bool)
        first = np.searchsorted(ends, off[:-1], side="right")
        last = np.searchsorted(ends, off[1:], side="right")
        counts, groups, pairs, times = np.zeros((rows, 4), dtype=np.int64), [], [], []
        for i in range(rows):
            own = slot[first[i] : last[i]]
            # a text of nothing but the space put before it has no tokens
            if off[i + 1] - off[i] < 2 or bad[own].any():
                groups.append("")
                pairs.append(np.zeros(0, np.int64))
                times.append(np.zeros(0, np.int64))
                continue
            counts[i] = sizes[own].sum(axis=0)
            parts = [facts[s][4] for s in own.tolist()]
            parts[-1] = parts[-1][:-1]  # no semicolon at the end
            if digest:
                h = hashlib.sha256()
                for at in range(0, len(parts), 1 << 16):
                    h.update(b"".join(parts[at : at + (1 << 16)]))
                groups.append(h.hexdigest())
            else:
                groups.append(b"".join(parts).decode())
            kind, often = np.unique(own, return_counts=True)
            long = np.frombuffer(b"".join([facts[s][5] for s in kind.tolist()]), dtype=np.int64)
            key, where = np.unique(long, return_inverse=True)
            pairs.append(key)
            times.append(np.bincount(where, weights=np.repeat(often, sizes[kind, 3]), minlength=len(key)).astype(np.int64))
        yield counts, groups, pairs, times


_ROW = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def token_groups(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row a text: its id, counts of tokens, groups and links, the groups
    (``a1,a2|b1;a3|b2,b3``, or their SHA-256 in hex), and its id pairs, as
    A id * size of B + B id, with how often each is linked.

    ``byte_bpe`` and ``pieces`` are vocabulary files that every executor finds
    at the same place.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects, none in cycles: looking for those takes a third of the time
        aligner = _aligner(byte_bpe, pieces)
        for b in batches:
            at = 0
            for counts, groups, keys, times in _measured(aligner, b.column(1), digest):
                off = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate(x), pa.int64())) for x in (keys, times)]
                cols = [pa.array(counts[:, k], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(groups)), *cols, pa.array(groups, pa.string()), *lists],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )
                at += len(groups)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(task, f"id {kind}, {_ROW}").withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair.  Partial sums
    are made before anything is moved."""
    one = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return one.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))


def _floor_of_hot(counts: DataFrame, most: int) -> int:
    """Least count of a pair such that at most ``most`` pairs have it or more,
    up to the width of a histogram bucket (a sixteenth of a power of two)."""
    width = F.floor(F.log2("n") * 16)
    rows = counts.groupBy(width.alias("b")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low")).collect()
    total, floor = 0, None  # some 1,000 rows at most
    for r in sorted(rows, key=lambda r: -r.b):
        total += r.m
        if total > most:
            break
        floor = r.low
    return floor if floor is not None else (1 << 62)


def alignment(
    docs: DataFrame,
    byte_bpe: str,
    pieces: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
    hot_pairs: int = 1 << 19,
) -> DataFrame:
    """``token_groups`` of every text with ``n_best``, the links whose pair is the
    commonest (or one of them) of its B id, and ``count_sum``, the corpus-wide
    counts of the pairs added up over the links."""
    spark = docs.sparkSession
    table = written(token_groups(docs, byte_bpe, pieces, id_col, text_col, digest).withColumn("rid", F.monotonically_increasing_id()))
    counts = written(pair_counts(table))
    n_b = _pieces(pieces)
    top = counts.groupBy((F.col("pair") % n_b).cast("int").alias("b")).agg(F.max("n").alias("most")).toArrow()
    best = np.zeros(n_b, dtype=np.int64)  # one number an id of B
    best[top.column("b").to_numpy()] = top.column("most").to_numpy()
    floor = _floor_of_hot(counts, hot_pairs)
    hot = counts.where(F.col("n") >= floor).orderBy("pair").toArrow()  # hot_pairs rows at most
    shared = spark.sparkContext.broadcast((best, hot.column("pair").to_numpy(), hot.column("n").to_numpy()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, keys, sums = shared.value
        for b in batches:
            lists, often = b.column("pairs"), b.column("times").flatten().to_numpy()
            pair = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            known, n = np.zeros(len(pair), dtype=bool), np.zeros(len(pair), dtype=np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                known = keys[at] == pair
                n[known] = sums[at[known]]
            whole = np.zeros((2, len(b)), dtype=np.int64)
            np.add.at(whole[0], row, np.where(known & (n == best[pair % n_b]), often, 0))
            np.add.at(whole[1], row, often * n)
            off = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~known], minlength=len(b))))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(off, pa.array(x[~known], pa.int64())) for x in (pair, often)]
            kept = [b.column(c) for c in facts]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(whole[0]), pa.array(whole[1]), *rest], [*facts, "n_best", "count_sum", "pairs", "times"])

    facts = [c for c in table.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name in facts)
    sums = table.mapInArrow(task, f"{schema}, n_best long, count_sum long, pairs array<long>, times array<long>")
    if floor <= 1:  # every pair is among the hot ones
        return sums.drop("pairs", "times", "rid")
    sums = written(sums)
    rare = sums.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", "x.pairs", "x.times")
    high = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))
    rare = rare.join(counts.where(F.col("n") < floor), F.col("pairs") == F.col("pair"))
    rare = rare.join(F.broadcast(high), F.col("b") == F.col("pair") % n_b).groupBy("rid").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more_sum"),
    )
    out = sums.drop("pairs", "times").join(rare, "rid", "left")
    for name, more in (("n_best", "more_best"), ("count_sum", "more_sum")):
        out = out.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return out.drop("rid", "more_best", "more_sum")


@lru_cache(maxsize=8)
def _pieces(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()
