"""Distributed Bloom filters of bounded size.

Tasks set bits in planes of ``2**bits`` bits and emit only the chunks they touched; the chunks are
merged by streaming tasks keyed by chunk, never by gathering filters.  The finished plane that is
sent to the executors has at most ``2**MAX_BITS`` bits (32 MB), which serve 22 million keys at 12 bits
each.  For more keys the setting ``llm.bloom.maxBits`` of the session raises the bound: 32 gives 512 MB,
which an executor holds once and a filling task twice, for 358 million keys.  Beyond the bound the filter
grows denser and lets more rows through: callers treat a hit as "possibly" only, so results stay the
same and more rows shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_arrow
from .words import mix

MIN_BITS, MAX_BITS, PROBES, CHUNK_BYTES = 16, 28, 4, 1 << 13


def bits_for(rows: int, most: int = MAX_BITS, per_row: int = 12) -> int:
    """log2 of the plane's bits for so many keys, ``most`` at most."""
    return int(np.clip(np.ceil(np.log2(max(rows, 1) * per_row)), MIN_BITS, most))


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit positions of each 64-bit key, by double hashing: shape (PROBES, keys)."""
    a, b = mix(keys, 11), mix(keys, 12) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) >> np.uint64(64 - bits) for k in range(PROBES)])


def hits(keys: np.ndarray, plane: np.ndarray, bits: int) -> np.ndarray:
    """Whether all bits of a key are set in ``plane`` (bytes)."""
    found = np.ones(len(keys), bool)
    for at in slots(keys, bits):
        found &= (plane[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


class Planes:
    """Bits set at least once, and bits set by at least two keys."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(1 << bits - 3, np.uint8)
        self.twice = np.zeros(1 << bits - 3, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        """``keys`` holds one entry per row; equal keys count as often as they occur."""
        for at in slots(keys, self.bits):
            at, n = np.unique(at, return_counts=True)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
            again = (n > 1) | (self.once[byte] & bit > 0)
            np.bitwise_or.at(self.twice, byte[again], bit[again])
            np.bitwise_or.at(self.once, byte, bit)

    def chunks(self):
        once, twice = (x.reshape(-1, CHUNK_BYTES) for x in (self.once, self.twice))
        for k in np.flatnonzero(once.any(axis=1)):
            yield int(k), zlib.compress(once[k].tobytes(), 1), zlib.compress(twice[k].tobytes(), 1)


def _chunk_batch(rows):
    k, once, twice = zip(*rows, strict=True)
    return batch([("chunk", np.array(k, np.int32)), ("once", pa.array(once)), ("twice", pa.array(twice))])


def _emit(planes: Planes):
    rows = []
    for row in planes.chunks():
        rows.append(row)
        if len(rows) == 512:
            yield _chunk_batch(rows)
            rows = []
    if rows:
        yield _chunk_batch(rows)


def repeated_plane(keys: DataFrame, rows: int, key: str = "key", repeated: bool = True) -> tuple[np.ndarray, int]:
    """The plane (bytes) and its log2 size: bits hit by two or more rows, or by any row if not ``repeated``."""
    bits = bits_for(rows, int(keys.sparkSession.conf.get("llm.bloom.maxBits", str(MAX_BITS))))

    def fill(batches):
        planes = Planes(bits)
        for b in batches:
            if b.num_rows:
                planes.add(np.asarray(b.column(0)).view(np.uint64))
        yield from _emit(planes)

    def merge(batches):
        done: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, once, twice in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
                if k in done:
                    have = done[k]
                    done[k] = [have[0] | once, have[1] | twice | (have[0] & once)]
                else:
                    done[k] = [once, twice]
        rows = [(k, zlib.compress(v[0].tobytes(), 1), zlib.compress(v[1].tobytes(), 1)) for k, v in done.items()]
        for at in range(0, len(rows), 512):
            yield _chunk_batch(rows[at : at + 512])

    schema = "chunk int, once binary, twice binary"
    pieces = map_arrow(keys.select(key), fill, schema).repartition("chunk")
    plane = np.zeros(1 << bits - 3, np.uint8)
    for row in map_arrow(pieces, merge, schema).select("chunk", "twice" if repeated else "once").toLocalIterator():
        plane[row[0] * CHUNK_BYTES : (row[0] + 1) * CHUNK_BYTES] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return plane, bits
