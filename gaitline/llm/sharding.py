"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in its own order (an offset and a skip drawn from its
name) and the shards take turns claiming the next free slot, so each ends with the same number of slots
(in proportion to its weight) and adding or losing a shard moves few slots. A row's key is hashed to a
slot; the table is broadcast, its size being a parameter and checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537
N_SHARDS = 256
MAX_TABLE = 4_000_003


def _is_prime(n: int) -> bool:
    return n >= 2 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> np.ndarray:
    """slot -> index of the shard in names.

    weights: turns that a shard takes in each round (1 each by default). size must be a prime of at least
    the number of turns in a round; ValueError otherwise, and for no or repeated names.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and distinct")
    turns = list(weights or [1] * len(names))
    if len(turns) != len(names) or min(turns) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    if not _is_prime(size) or size < sum(turns) or size > MAX_TABLE:
        raise ValueError(f"table size must be a prime from {sum(turns)} to {MAX_TABLE}")
    digests = [hashlib.sha256(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digests]
    table, left = np.full(size, -1, np.int32), size
    owners = table.tolist()
    while left:
        for s, n in enumerate(turns):
            for _ in range(n):
                if not left:
                    break
                p = at[s]
                while owners[p] >= 0:
                    p = (p + skip[s]) % size
                owners[p], at[s], left = s, (p + skip[s]) % size, left - 1
    return np.array(owners, np.int32)


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: the first 60 bits of its text's md5, mod size. A null key has the slot of the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, names: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with slot_col int and shard_col int (index in names) added or replaced; one row out for each row in.

    Rows of the same key go to the same shard. Null keys share one slot; an empty table stays empty. A key column of
    either name serves as the key and is then replaced.
    No shuffle: the table goes to the executors once (size slots of 4 bytes, at most MAX_TABLE of them).
    """
    kept = df.drop(slot_col, shard_col)
    owners = lookup_table(names, size, weights).tolist()
    table = df.sparkSession.createDataFrame(list(enumerate(owners)), f"`{slot_col}` int, `{shard_col}` int")
    placed = df.select(*(f"`{c}`" for c in kept.columns), slot_of(F.col(f"`{key}`"), size).alias(slot_col)).join(F.broadcast(table), slot_col)
    return placed.select(*(f"`{c}`" for c in kept.columns), slot_col, shard_col)
