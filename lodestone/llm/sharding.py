"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of their ids; a keyed Feistel network with cycle walking permutes the
numbers 0 to n-1.  Place p of the permutation is slot ``p // shards`` of shard ``p % shards``, so shard
and slot of any row can be computed from its number alone, the shuffle depends on nothing but n and
the key, and counts of shards differ by one at most (law ``rows``).

Only ids and digests are sorted, never texts.  Row numbers need the row counts of the sorted
partitions, one figure for each.

Defined cases: a null text has no bytes and size 1; null ids are numbered before all others; rows that
repeat an id are numbered by size, then by digest, and identical rows are interchangeable; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import column, materialise, text_bytes

SHARDS = 16
ROUNDS = 4
KEY = 20_240_229


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A bijection of 0 to n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS) -> None:
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        seeds = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = _mix(seeds + np.uint64(key))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right + key) & mask)
        return left << half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        """Apply ``step`` until the value is below n again: a walk along the cycle of the larger domain."""
        x = step(np.asarray(x).astype(np.uint64))
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = step(x[out])
        return x.astype(np.int64)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, lambda x: self._network(x, self.keys))

    def number(self, places: np.ndarray) -> np.ndarray:
        """The inverse of ``place``."""
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)

        def swap(x):
            return (x & mask) << half | x >> half

        return self._walk(places, lambda x: swap(self._network(swap(x), self.keys[::-1])))


_OUT = "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long"


def _assign(n: int, shards: int, key: int, first: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Feistel(n, key)
        parts = np.array(sorted(first), np.int64)
        firsts = np.array([first[p] for p in parts.tolist()], np.int64)
        for batch in batches:
            at = batch.column("at").to_numpy()
            number = firsts[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1))
            place = permutation.place(number)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("size"),
                    batch.column("text_crc32"),
                    pa.array(number),
                    pa.array((place % shards).astype(np.int32)),
                    pa.array(place // shards),
                ],
                names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"],
            )

    return run


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, key: int = KEY
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, row_number, shard, slot."""
    spark = docs.sparkSession
    text = text_bytes(text_col)
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # Written rows sit in files of their sorted partitions; ``at`` is (partition, place within it).
    order = ["doc_id", "size", "text_crc32"]
    numbered = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "row-numbers",
    )
    part = F.shiftright("at", 33).alias("part")
    first, n = {}, 0
    for p, count in sorted(tuple(r) for r in numbered.groupBy(part).count().collect()):
        first[p] = n
        n += count
    return numbered.mapInArrow(_assign(n, shards, key, first), _OUT)
