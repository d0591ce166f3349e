"""Vectorised word handling shared by the text operators.

Texts arrive as Arrow string columns. Words are maximal runs of bytes other than space and
0x09-0x0D, found on the UTF-8 buffer with numpy, so a text is never split into Python strings
unless an operator needs the strings themselves. A null text counts as an empty one.

Rows are taken in slices of about ``SLICE`` bytes, which bounds the temporaries of a worker; a
single longer text forms a slice of its own, since texts are always processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Odd, so that it has an inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE, kind: str = "up") -> np.ndarray:
    """The first n powers of base modulo 2^64; the longest table so far is kept."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of a string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def spans(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def parts(column: pa.Array, limit: int = 4 * SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Zero-copy pieces of a string column of at most limit bytes or one row, with their first row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off = buffers(column)
    for i, j in spans(off, limit):
        yield i, column.slice(i, j - i)


@dataclass
class Words:
    """Words of the rows i..j-1 of a column: byte bounds in ``data``, row (from 0) and 64-bit hash.

    ``first[r]`` is the index of row r's first word; ``first[-1]`` is the number of words.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(raw: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool = False, hashes: bool = True) -> Words:
    lo, hi = int(off[i]), int(off[j])
    data = raw[lo:hi]
    if lower:
        data = LOWER[data]
    cut = off[i : j + 1] - lo
    n = len(data)
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = cut[(cut > 0) & (cut < n)]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, cut)
    row = np.repeat(np.arange(j - i), np.diff(first))
    if not hashes:
        return Words(data, start, end, row, first, np.zeros(0, np.uint64))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * powers(n), out=total[1:])
    h = (total[end] - total[start]) * powers(n + 1, INVERSE, "down")[start]
    return Words(data, start, end, row, first, mix(h + (end - start).astype(np.uint64) * BASE))


def rolling(h: np.ndarray, n: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Rabin-Karp hashes of the len(h)-n+1 runs of n values, over all of h (no regard to rows)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    up = powers(len(h), np.uint64(base), f"up{base}")
    np.cumsum(h * up, out=total[1:])
    down = powers(len(h), np.uint64(pow(base, -1, 1 << 64)), f"down{base}")
    k = len(h) - n + 1
    return mix((total[n:] - total[:-n]) * down[:k])


def runs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices at which a run of n words of one row starts, and their hashes."""
    h = rolling(w.hash, n)
    at = np.flatnonzero(w.row[: len(h)] == w.row[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    return at, h[at]
