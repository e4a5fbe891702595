"""Vectorised word kernels shared by the operators that run over Arrow batches.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D after A-Z are lower-cased.  Words are
hashed without building Python strings: every byte maps to a fixed random 64-bit value, a word is the
polynomial of its bytes modulo 2**64, and a bijective finaliser spreads the bits.  The constants are
part of the method; equal words hash equally on every executor.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 & ~7 | 5)
_COMBINE = U64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes handled at once; bounds the temporaries of the vectorised steps to a few dozen MB.
SLICE_BYTES = 2 << 20


def trim() -> None:
    """Give freed memory back to the system: the allocator keeps blocks of some MB, and a worker lives on."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row gets a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[raw]


def word_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first bytes of the words of `data`, whose rows begin at `begins`."""
    start = ~_SPACE[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = start[:-1]
    inner[begins[begins < len(data)]] = False
    return np.flatnonzero(start & ~inner)


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row offsets into them) of the rows whose bytes lie at `offs` in `raw`."""
    return placed_words(raw, offs)[:2]


def placed_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Also the words' first bytes, counted from offs[0]."""
    base = int(offs[0])
    data = _LOWER[raw[base : int(offs[-1])]]
    at = offs - base
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | begins[1:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offs), np.int64), starts
    packed = data[solid]
    rank = np.cumsum(solid, dtype=np.int64) - 1
    first = rank[starts]
    lengths = np.diff(np.append(first, len(packed)))
    place = np.arange(len(packed), dtype=np.int64) - np.repeat(first, lengths)
    powers = np.empty(int(lengths.max()), dtype=U64)
    powers[0] = 1
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    sums = np.add.reduceat(_BYTE_VALUE[packed] * powers[place], first)
    return mix64(sums), np.searchsorted(starts, at), starts


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one row (or of many rows laid end to end)."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * _COMBINE + hashes[k : len(hashes) - n + 1 + k]
    return mix64(out)


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct `size`-word shingles; fewer words make one shingle."""
    every = ngrams(hashes, size) if len(hashes) >= size else np.zeros(0, U64)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield ngrams(hashes[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)
