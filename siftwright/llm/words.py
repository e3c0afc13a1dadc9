"""Words and shingles of whole batches of texts as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Every word gets a 64-bit polynomial
hash over its bytes, computed for all words of a batch at once from one running sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (arrays over them take some 60 times as many); longer texts make a chunk of their own.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C13 | 3
_INVERSE = pow(_BASE, -1, 2**64)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return what earlier batches have left with the allocators to the system: workers stay between tasks, and their unused memory would count against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the (UTF-8) bytes of `column` and each row's offsets in them; null counts as empty."""
    give_back()
    col = batch.column(batch.schema.get_field_index(column))
    binary = pa.types.is_binary(col.type)
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col if binary else col.cast(pa.string()), np.int32
    if not len(col):
        return
    if col.null_count:
        col = col.fill_null(b"" if binary else "")
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end (in bytes) of each word."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, none
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=run[1:])
    found = mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))
    return found, np.searchsorted(offsets, start, side="right") - 1, start, end


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Raw hashes of the byte ranges [start, end), by the same running sum."""
    power, inverse = _power_tables(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=run[1:])
    return (run[end] - run[start]) * inverse[start]


def grams(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-word shingle hashes, their rows, and each row's number of words; a row of fewer words has one shingle of all."""
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    if len(hashes) >= k:
        total = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
        for i in range(k):
            total += mix(hashes[i : len(hashes) - k + 1 + i] + _MIX[i]) * _MIX[k + i]
        own = rows[: len(total)] == rows[k - 1 :]
        shingles, of = mix(total[own]), rows[: len(total)][own]
    else:
        shingles, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += mix(hashes[(ends - counts)[short[has]] + i] + _MIX[i]) * _MIX[k + i]
        shingles = np.concatenate([shingles, mix(extra + _MIX[40] * counts[short].astype(np.uint64))])
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        shingles, of = shingles[order], of[order]
    return shingles, of, counts


def distinct_by_row(values: np.ndarray, of: np.ndarray, n_rows: int) -> Iterator[np.ndarray]:
    """Each row's distinct values, ascending."""
    bounds = np.searchsorted(of, np.arange(n_rows + 1))
    for i in range(n_rows):
        yield np.unique(values[bounds[i] : bounds[i + 1]])
