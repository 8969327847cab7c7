"""Compact packets of sorted hashes: what a task has gathered goes out by ranges of the hash space.

A task sends for each range one row with its distinct hashes, so a hash that is everywhere costs one entry a
task, and a range's size follows the distinct hashes, which spread evenly.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text for each range; ranges for each shuffle partition at least, counted for so many partitions at most.
RANGE_BYTES, RANGES_EACH, PARTITIONS = 32 << 20, 4, 256
_U = np.uint64


def n_ranges(docs: DataFrame, text: str) -> int:
    """Ranges of the hash space for a table of texts: by its size, so that a range fits a task at any size.

    Small tables have as many as keep the cluster busy; a larger one has no more than its size asks for, as every task sends a
    packet to every range.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(RANGES_EACH * min(partitions, PARTITIONS), -(-size // RANGE_BYTES))


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Range of each hash, rising with it."""
    return ((keys >> _U(32)) * _U(n)) >> _U(32)


def cuts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges that sorted keys fall into, where each begins, and the end)."""
    r = range_of(keys, n)
    begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    return r[begin].astype(np.int64), np.append(begin, len(keys))


def _planes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _from_planes(b: bytes, dtype: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising uint64 as compressed differences."""
    return _planes(np.diff(keys, prepend=_U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(b, np.uint64), dtype=np.uint64)


def pack(values: np.ndarray, dtype: type = np.uint32) -> bytes:
    return _planes(values.astype(dtype))


def unpack(b: bytes, dtype: type = np.uint32) -> np.ndarray:
    return _from_planes(b, dtype)
