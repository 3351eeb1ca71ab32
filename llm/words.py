"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes outside ``{0x20, 0x09-0x0D}`` of the UTF-8 text.  All hashes are
64-bit functions of the bytes alone (no per-process seed), so every executor agrees on them.
The arrays of one step are bounded by ``STEP_BYTES`` of text, or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP_BYTES = 1 << 20

_M64 = (1 << 64) - 1
_ROOT = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x + np.uint64((seed * 2 + 1) * _ROOT & _M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = (mix(np.arange(256, dtype=np.uint64), 7), mix(np.arange(256, dtype=np.uint64), 8))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, row offsets into them) with at most ``limit`` bytes or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def split_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word, and for each row its first word's number (rows + 1 values)."""
    word = np.zeros(len(raw) + 1, bool)
    word[:-1] = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, lane: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes, with A-Z lower-cased if asked; ``lane`` picks independent functions."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[lane][_LOWER[raw] if lower else raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), lane)


def hash_runs(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words; entry i covers words i .. i + length - 1."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    n = len(words) - length + 1
    return mix((sums[length:] - sums[:n]) * down[:n] + np.uint64(length), 2 + lane)


def prefix_hashes(raw: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the n bytes from each start), A-Z lower-cased; meaningless where fewer bytes follow."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[0][_LOWER[raw]] * up[: len(raw)], out=sums[1:])
    for n in lengths:
        yield n, mix((sums[np.minimum(starts + n, len(raw))] - sums[starts]) * down[starts], 5)
