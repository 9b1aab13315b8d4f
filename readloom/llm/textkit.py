"""Vectorised word and shingle hashing over Arrow string columns.

Everything here works on whole buffers: a batch of texts is one byte array with
document offsets, a word is a pair of positions in it, and a word's hash comes
from one running sum over the buffer. Python never loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1_000_000

_M = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_M_INV = pow(_M, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for name, base in (("p", _M), ("q", _M_INV)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _tables[name] = np.multiply.accumulate(step)
    return _tables["p"], _tables["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into (first row, past-last row, bytes, offsets).

    Null texts are empty. Each chunk holds at most ``most`` bytes unless one
    text alone is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    kind = np.int64 if large else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offs, dtype=kind, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _spans(inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and past-ends of runs of ``inside``, also cut wherever ``edge`` is set."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _span_hash(weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, q = _powers(len(weights) + 1)
    run = np.empty(len(weights) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(weights * p[: len(weights)], out=run[1:])
    return mix((run[ends] - run[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated words: 64-bit hashes, starts, ends and word offsets per text."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets[:-1]] = True
    starts, ends = _spans(inside, edge[: len(raw)])
    table = _BYTE[_LOWER] if lower else _BYTE
    return _span_hash(table[raw], starts, ends), starts, ends, np.searchsorted(starts, offsets)


#: Byte classes for words() of the other kind: letters, digits, space, every other byte by itself.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123), *range(128, 256)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[b for b in range(33, 127) if not _CLASS[b]]] = 4


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters (capitals only at their head), of digits and of other signs, as words() but with shapes too.

    A shape tells the class of a run's first and last byte and whether it is longer than one.
    """
    kind = _CLASS[raw]
    edge = np.ones(len(raw) + 1, dtype=bool)
    edge[1 : len(raw)] = (kind[1:] != kind[:-1]) & ~((kind[1:] == 2) & (kind[:-1] == 1))
    edge[offsets[:-1]] = True
    starts, ends = _spans(kind > 0, edge[: len(raw)])
    shape = kind[starts] * 16 + kind[ends - 1] * 2 + (ends - starts > 1) if len(starts) else kind[:0]
    return _span_hash(_BYTE[_LOWER][raw], starts, ends), starts, ends, np.searchsorted(starts, offsets), shape


_STEP = np.random.default_rng(7).integers(1, _MASK, 16, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` neighbouring words; one of the whole sequence if it is shorter, none if empty."""
    n = len(hashes)
    if not n:
        return hashes
    take = min(width, n)
    out = np.full(n - take + 1, take, dtype=np.uint64)
    for k in range(take):
        out = out + hashes[k : n - take + 1 + k] * _STEP[k]
    return mix(out)
