"""Words and shingles of Arrow text columns as 64-bit hashes, computed over whole buffers.

The kernel works on the UTF-8 bytes of an Arrow column, so a document costs a few numpy passes
and no Python object for each word.  A word is a run of ``[^\\x20\\x09-\\x0D]`` bytes; A-Z may be
folded to a-z.  Texts are read whole: buffers are walked in pieces of ``PIECE`` bytes, and a word
that crosses pieces is put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, seed: int = 1) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_RAW = seeds(256, 77)
_FOLDED = _RAW.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _RAW[ord("a") : ord("z") + 1]
_tables: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        for base in (_P, pow(_P, -1, 1 << 64)):
            out = np.full(PIECE + 1, base, dtype=_U)
            out[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(out, out=out)
            _tables.append(out)
    return _tables[0], _tables[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 byte offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, most: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end: n+1 entries)."""
    power, inverse = _powers()
    table = _FOLDED if fold else _RAW
    hashes: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    total, open_end = len(data), -1
    inner = offsets[1:-1]
    with np.errstate(over="ignore"):
        for a in range(0, total, PIECE):
            x = data[a : a + PIECE]
            n = len(x)
            space = IS_SPACE[x]
            cuts = inner[(inner > a) & (inner < a + n)] - a
            before, after = np.empty(n, bool), np.empty(n, bool)
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
            before[cuts] = True
            after[cuts - 1] = True
            solid = ~space
            s = np.flatnonzero(solid & before)
            e = np.flatnonzero(solid & after) + 1
            if not len(s):
                open_end = -1
                continue
            sums = np.empty(n + 1, _U)
            sums[0] = 0
            np.cumsum(table[x] * power[:n], out=sums[1:])
            h = (sums[e] - sums[s]) * inverse[s]
            size = e - s
            start = s + a
            if open_end == start[0] == a and not np.any(offsets == a):
                long = int(sizes[-1][-1])
                hashes[-1][-1] += _U(pow(_P, long, 1 << 64)) * h[0]
                sizes[-1][-1] += size[0]
                h, size, start = h[1:], size[1:], start[1:]
            if len(h):
                hashes.append(h)
                starts.append(start)
                sizes.append(size)
            open_end = a + n if e[-1] == n else -1
        if not hashes:
            return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
        h, start, size = (np.concatenate(v) for v in (hashes, starts, sizes))
        h = mix(h + size.astype(_U) * _U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(start, offsets).astype(np.int64)


def column_words(column: pa.Array, fold: bool = True, most: int = 4 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, word hashes, word offsets) over groups of a column's documents."""
    data, offsets = buffers(column)
    for a, b in groups(offsets, most):
        at = offsets[a : b + 1]
        h, w = word_hashes(data[at[0] : at[-1]], at - at[0], fold)
        yield a, b, h, w


def shingles(h: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their offsets by document; fewer words than k are one shingle."""
    keys = seeds(k, 5)
    counts = np.diff(w)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(n)))
    if not off[-1]:
        return np.zeros(0, _U), off
    doc = np.repeat(np.arange(len(counts)), n)
    first = w[:-1][doc] + (np.arange(off[-1]) - off[:-1][doc])
    out = np.zeros(off[-1], _U)
    last = np.maximum(len(h) - 1, 0)
    left = w[1:][doc] - first
    with np.errstate(over="ignore"):
        for j in range(k):
            there = left > j
            part = np.where(there, h[np.minimum(first + j, last)], _U(0))
            out += part * keys[j]
        out = mix(out + np.minimum(left, k).astype(_U))
    return out, off


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate(([0], np.cumsum(sizes)))
