"""Chat formatting by columnar byte assembly.

The rows of a batch are written into one preallocated Arrow buffer: numpy
computes the length of every piece (marker, role, text), the cumulative
offsets, and the indices that scatter headers and contents to their places.

Conversations are dealt out by ranges of (id, turn), so a very long one is
formatted by several tasks.  The result is segments of about
``SEGMENT_BYTES``, in order of (part, seq), and of any number; a conversation
as a whole is never in one place.  ``format_conversations`` puts the segments
of each together where conversations are known to be small: there a formatted
conversation is one value, so at most 2 GB.

Template, for each turn: ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.
Inside roles and texts a backslash is doubled, and every control string gets a
backslash after its first character; in roles a line break is written ``\\n``.

Edge cases: null texts and roles count as empty; turns that share a number are
ordered by role and text; a null id is a conversation of its own; an empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bound_batches

START, END = "<|im_start|>", "<|im_end|>\n"
# Strings that public chat templates give a meaning.
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
# a segment ends with the turn that reaches so many bytes
SEGMENT_BYTES = 1 << 20
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_CONTROL = rf"([<\[])({_TAILS})"
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}", re.DOTALL)


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), "\\", "\\\\")
    if role:
        column = pc.replace_substring(column, "\n", "\\n")
    return pc.replace_substring_regex(column, _CONTROL, r"\1\\\2")


def unescape(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; the whole value must be turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1], True), unescape(m[2])))
        at = m.end()
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer with all turns; where each turn starts (and the end); where
    each text starts in it."""
    n = len(roles)
    head, mid, tail = (np.frombuffer(x.encode(), dtype=np.uint8) for x in (START, "\n", END))
    (role, role_off), (text, text_off) = _buffers(roles), _buffers(texts)
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(head), len(mid), len(tail)
    lengths[:, 1], lengths[:, 3] = np.diff(role_off), np.diff(text_off)
    flat = np.zeros(n * 5 + 1, dtype=np.int64)
    np.cumsum(lengths.reshape(-1), out=flat[1:])
    at = flat[:-1].reshape(n, 5)
    buffer = pa.allocate_buffer(int(flat[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    for k, piece in ((0, head), (2, mid), (4, tail)):
        out[at[:, k, None] + np.arange(len(piece))] = piece
    for k, (data, off) in ((1, (role, role_off)), (3, (text, text_off))):
        out[np.repeat(at[:, k] - off[:-1], lengths[:, k]) + np.arange(len(data))] = data
    return buffer, np.append(at[:, 0], flat[-1]), at[:, 3]


def _segments(batches: Iterator[pa.RecordBatch], learn: str, size: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part, seq = context.partitionId() if context else 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0)
        key, null = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
        roles, texts = escape(b.column(1), True), escape(b.column(2))
        buffer, turn_at, text_at = assemble(roles, texts)
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])))
        begins = turn_at[:-1]
        within = (begins - begins[fresh][np.cumsum(fresh) - 1]) // size
        fresh[1:] |= within[1:] != within[:-1]
        first = np.flatnonzero(fresh)
        seg_at = turn_at[np.append(first, b.num_rows)]
        body = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(seg_at.tobytes()), buffer)
        owner = np.cumsum(fresh) - 1
        learned = pc.fill_null(pc.equal(b.column(1), learn), False).to_numpy(zero_copy_only=False)
        begin = text_at - seg_at[owner]
        end = begin + np.diff(_buffers(texts)[1])
        bounds = np.concatenate(([0], np.cumsum(learned)))[np.append(first, b.num_rows)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[learned])) for x in (begin, end)]
        out = pa.RecordBatch.from_arrays(
            [
                conv.take(pa.array(first)),
                pa.array(np.full(len(first), part, dtype=np.int32)),
                pa.array(np.arange(seq, seq + len(first), dtype=np.int32)),
                body,
                pa.array(np.diff(np.append(first, b.num_rows))),
                *lists,
            ],
            ["conv", "part", "seq", "body", "turns", "starts", "ends"],
        )
        seq += len(first)
        # a batch of long texts goes back in several, each below what a string column can hold
        cuts = np.flatnonzero(np.diff(seg_at[:-1] // (64 * SEGMENT_BYTES))) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)], strict=True):
            piece = out.take(pa.array(np.arange(a, z))) if len(cuts) else out
            yield piece.set_column(3, "body", piece.column(3).cast(pa.string()))


def format_segments(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """Segments of the formatted conversations, each whole turns: conv_id, part
    and seq (their order), body, turns (how many), starts and ends (byte
    offsets in ``body`` of the texts to learn, those whose role is ``learn``)."""
    bound_batches(rows.sparkSession, 4000)
    size = SEGMENT_BYTES
    given = rows.select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    )
    dealt = given.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    segments = dealt.select("conv", "role", "text").mapInArrow(
        lambda it: _segments(it, learn, size),
        "conv long, part int, seq int, body string, turns long, starts array<long>, ends array<long>",
    )
    return segments.withColumnRenamed("conv", id_col)


def format_conversations(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row for each conversation, gathered from ``format_segments``, for
    conversations that fit a value: conv_id, n_turns, formatted, loss_starts
    and loss_ends (byte offsets in ``formatted`` of the texts to learn, those
    whose role is ``learn``)."""
    whole = format_segments(rows, id_col, turn_col, role_col, text_col, learn).groupBy(id_col).agg(
        F.sum("turns").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("part", "seq", "body", "starts", "ends"))).alias("s"),
    )
    # bytes before each segment
    before = F.aggregate(
        F.transform("s", lambda x: F.octet_length(x["body"]).cast("long")),
        F.array(F.lit(0).cast("long")),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )

    def spans(name: str):
        moved = F.zip_with(
            F.col("s"), F.slice("before", 1, F.size("s")), lambda x, b: F.transform(x[name], lambda y: y + b)
        )
        return F.flatten(moved)

    return whole.withColumn("before", before).select(
        id_col,
        "n_turns",
        F.array_join(F.transform("s", lambda x: x["body"]), "").alias("formatted"),
        spans("starts").alias("loss_starts"),
        spans("ends").alias("loss_ends"),
    )
