"""Whole texts as byte arrays: words, rolling hashes and sliding minima in numpy.

Every function works on one slice of an Arrow batch (about ``SLICE`` bytes, or a
single longer text), so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def class_table(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of words that white space parts: all but blank, tab and the line breaks.
SPACED = class_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words of letters and digits; all non-ASCII characters count as letters.
ALNUM = class_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * MIX2
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * MULT)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and its inverse for 0 <= i < n, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE + 1024)
        inv = pow(int(MULT), -1, 1 << 64)
        for key, base in (("up", int(MULT)), ("down", inv)):
            out = np.full(size, np.uint64(base), dtype=np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[key] = out
    return _powers["up"][:n], _powers["down"][:n]


def looked_up(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of 256 bytes or booleans."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return looked_up(data, LOWER)


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
        yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[i] the polynomial hash sum of the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    values = byte_values().take(data.astype(np.intp))
    values *= up[: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    length = (end - start).astype(np.uint64)
    return mix((prefix[end] - prefix[start]) * down[start] + length * MIX2)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word bounds, and for each row the index of its first word (one more at the end)."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = looked_up(data, member)
    at = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = at[0::2], at[1::2]
    inner = np.unique(offsets[1:-1])
    if len(inner) and len(starts):  # a run of word bytes that goes on into the next row is two words
        k = np.searchsorted(starts, inner, side="left") - 1
        cut = inner[(k >= 0) & (inner > starts[np.maximum(k, 0)]) & (inner < ends[np.maximum(k, 0)])]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data, offsets, member):
    """Lower-cased word hashes of a slice, with ``first`` as in :func:`words`."""
    low = lower(data)
    starts, ends, first = words(low, offsets, member)
    return span_hash(prefix_hash(low), starts, ends), first


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, for every start at which k items are left in the array."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * MULT + h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive items, by doubling."""
    if len(x) < w:
        return x[:0]
    cur, span = x, 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    n = len(x) - w + 1
    return np.minimum(cur[:n], cur[w - span : w - span + n])


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
