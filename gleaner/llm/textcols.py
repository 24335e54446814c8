"""Columnar word handling on the UTF-8 bytes of an Arrow string column.

All separators used by the corpus contracts are ASCII, so words can be cut on
bytes: every byte of a multi-byte character is a word byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240131))
#: A random 64-bit value for each byte, after lower-casing A-Z.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}

#: Word bytes: everything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: digits, letters, everything beyond ASCII (A-Z count as a-z).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _POW["up"], _POW["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POW["up"], _POW["down"]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of parts of about ``most`` bytes.

    One text is never split.  Nulls are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to - at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each text's words begin (one more
    entry than there are texts)."""
    inside = table[data]
    first = np.empty(len(data) + 1, dtype=bool)
    last = np.empty(len(data) + 1, dtype=bool)
    first[0], first[-1] = True, False
    last[0], last[-1] = False, True
    if len(data):
        first[1:-1] = ~inside[:-1]
        last[1:-1] = ~inside[1:]
        edge = off[(off > 0) & (off < len(data))]
        first[edge] = True
        last[edge] = True
        starts = np.flatnonzero(first[:-1] & inside)
        ends = np.flatnonzero(last[1:] & inside) + 1
    else:
        starts = ends = np.zeros(0, dtype=np.int64)
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hash of each word, blind to the case of A-Z.

    Words are taken in blocks of about ``block`` bytes, so that the tables and
    sums stay small however long a text is.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
        low = int(starts[at])
        first, size = starts[at:to] - low, (ends[at:to] - starts[at:to]).astype(np.uint64)
        part = data[low : ends[to - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        out[at:to] = mix((sums[ends[at:to] - low] - sums[first]) * down[first] + size)
        at = to
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(hashes: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of each text, and where each
    text's runs begin.  A text of fewer words, but not none, has one run."""
    n = np.diff(begin)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_begin = np.concatenate(([0], np.cumsum(count)))
    total = int(out_begin[-1])
    owner = np.repeat(np.arange(len(n)), count)
    pos = begin[owner] + (np.arange(total) - out_begin[owner])
    end = begin[owner + 1]
    pad = np.concatenate((hashes, np.zeros(width, dtype=np.uint64)))
    out = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        live = pos + k < end
        part = pad[np.minimum(pos + k, len(pad) - 1)] * _U((0xD6E8FEB86659FD93 * (2 * k + 1) + 2 * k) % (1 << 64) | 1)
        out += np.where(live, part, _U(k + 1))
        out = (out << _U(7)) | (out >> _U(57))
    return mix(out), out_begin
