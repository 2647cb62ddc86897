"""Exact deduplication through an extendible-hash index on shared files.

1. *Local chains.*  Each task walks its rows, hashes the whitespace-normalised text to 64 bits and
   compares bytes with the chain of texts under that hash.  Copies inside a task collapse to one
   index entry before anything is shuffled, so a group that holds a third of all rows sends at most
   a few entries per task.
2. *Directory.*  Entry counts per hash prefix form the directory.  It starts with one bucket;
   an overfull bucket is split on its next bit and the directory doubles whenever that bit is
   deeper than its depth.  Doubling costs nothing, as only buckets are stored and cells follow from
   them.  Only counts of prefixes reach the driver, at most ``ROUND_COUNTS`` of them in a round.
3. *Owner tasks.*  Buckets are contiguous key ranges, and an owner takes neighbouring ones.  It streams
   their entries in key order, chains those that share a key and compares bytes; equal entries take
   the identity of the smallest row.  Only the chain of the current key is in memory, so a bucket may
   grow: beyond ``MAX_BUCKETS`` times the capacity in all, the capacity grows instead of the directory.
4. Group sizes are sums over index entries; rows look up their entry, which no other task's rows share.

Equality is that of bytes throughout; the hash only narrows what is compared.

Defined cases: a null text counts as empty; a null id sorts after every other id; rows that repeat
an id are told apart, and exactly one row of each group is kept, of those with the smallest id the
first as read; an empty table gives an empty table; other columns of the input are ignored, whatever
their names and types.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import column, listed, materialise, new_folder, numbered, small_batches, text_bytes, workspace

#: Distinct keys that one bucket should hold, and neighbouring buckets that an owner takes.
BUCKET_ENTRIES, OWNED_BUCKETS = 4096, 4
#: Bits that one counting pass adds to the known prefixes, at most.
PREFIX_BITS = 12
#: Overfull buckets there can be at a time, and counts that reach the driver in one round.
MAX_BUCKETS, ROUND_COUNTS = 1 << 16, 1 << 18
#: Text bytes that a task keeps in its local chains before it sends them on and starts anew.
LOCAL_BYTES = 64 << 20

_LOCAL = T.StructType(
    [
        T.StructField("head", T.BooleanType()),
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("entry", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("copies", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("text", T.BinaryType()),
    ]
)
_LOCAL_ARROW = pa.schema(
    [
        ("head", pa.bool_()),
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("entry", pa.int64()),
        ("key", pa.int64()),
        ("copies", pa.int64()),
        ("text_sha256", pa.string()),
        ("text", pa.binary()),
    ]
)
_BLANKS = b" \t\n\r\x0b\x0c"


def normalise_blanks(text: bytes) -> bytes:
    """Every run of ASCII blanks becomes one space."""
    if not text:
        return text
    body = b" ".join(text.split())
    if not body:
        return b" "
    return b" " * (text[0] in _BLANKS) + body + b" " * (text[-1] in _BLANKS)


def default_hash(text: bytes) -> int:
    """Signed 64-bit key of a normalised text."""
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _local_chains(hash_text):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[int, list[list]] = {}  # key -> [text, entry, smallest (id, row), copies, sha]
        held = 0

        def heads() -> pa.RecordBatch:
            rows = [
                (True, best[1], None if best[0] == _NO_ID else best[0], entry, key, copies, sha, text)
                for key, chain in chains.items()
                for text, entry, best, copies, sha in chain
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows), _LOCAL_ARROW)], schema=_LOCAL_ARROW
            )

        for batch in batches:
            rows, entries, shas = [], [], []
            ids = batch.column(0).to_pylist()
            for doc_id, raw, serial in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = normalise_blanks(raw)
                key = hash_text(text)
                at = (_NO_ID if doc_id is None else doc_id, serial)
                chain = chains.setdefault(key, [])
                link = next((link for link in chain if link[0] == text), None)
                if link is None:
                    link = [text, serial, at, 0, hashlib.sha256(text).hexdigest()]
                    chain.append(link)
                    held += len(text) + 200
                link[2] = min(link[2], at)
                link[3] += 1
                rows.append(serial)
                entries.append(link[1])
                shas.append(link[4])
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([False] * n),
                    pa.array(rows, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(entries, pa.int64()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.nulls(n, pa.binary()),
                ],
                schema=_LOCAL_ARROW,
            )
            if held > LOCAL_BYTES:
                yield heads()
                chains.clear()
                held = 0
        if chains:
            yield heads()

    return run


#: Sorts after every id.
_NO_ID = 1 << 63


class Directory:
    """Extendible-hash directory over the top bits of unsigned 64-bit keys.

    Cell ``i`` of the 2**``depth`` cells is the bucket of the prefix ``i``; a bucket is (local depth,
    prefix) and fills all cells that begin with its prefix.  Memory goes with buckets, not with cells.
    """

    def __init__(self) -> None:
        self.depth = 0
        self._buckets: set[tuple[int, int]] = {(0, 0)}

    def split(self, bucket: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Deepen an overfull bucket by one bit; only a bucket at full depth doubles the directory."""
        local, prefix = bucket
        self._buckets.remove(bucket)
        if local == self.depth:
            self.depth += 1
        halves = (local + 1, prefix << 1), (local + 1, prefix << 1 | 1)
        self._buckets.update(halves)
        return halves

    @property
    def cells(self) -> list[tuple[int, int]]:
        """All cells one by one; for directories of small depth."""
        return [bucket for bucket in self.buckets() for _ in range(1 << (self.depth - bucket[0]))]

    def buckets(self) -> list[tuple[int, int]]:
        return sorted(self._buckets, key=lambda bucket: bucket[1] << (64 - bucket[0]))

    def starts(self) -> list[int]:
        """First key of each bucket, in order."""
        return [prefix << (64 - local) for local, prefix in self.buckets()]


def build_directory(keys: DataFrame, capacity: int = BUCKET_ENTRIES, step: int = PREFIX_BITS) -> Directory:
    """Split buckets until none holds more than ``capacity`` distinct keys or its keys cannot be told apart.

    Each round counts keys by their next bits, for the overfull prefixes alone, by as many bits as keep
    the counts of a round within ``ROUND_COUNTS``.  The capacity is raised to a ``MAX_BUCKETS``-th of all
    keys if that is more, so at most ``MAX_BUCKETS`` prefixes are overfull at a time.
    """
    directory = Directory()
    spark = keys.sparkSession
    keys = materialise(keys.select("key").distinct(), "dedup-keys")
    overfull = [(0, 0)]
    depth = 0
    while depth < 64 and overfull:
        wide = min(64, depth + min(step, max(1, (ROUND_COUNTS // len(overfull)).bit_length() - 1)))
        counted = keys.select(F.shiftrightunsigned("key", 64 - wide).alias("prefix"))
        if depth:
            parents = spark.createDataFrame([(_signed(p),) for _, p in overfull], "parent long")
            above = F.shiftrightunsigned("prefix", wide - depth)
            counted = counted.withColumn("parent", above).join(F.broadcast(parents), "parent", "left_semi")
        fine = counted.groupBy("prefix").agg(F.count("*").alias("n")).toArrow()
        names = fine["prefix"].to_numpy().view(np.uint64)
        order = np.argsort(names)
        names = names[order]
        totals = np.concatenate(([0], np.cumsum(fine["n"].to_numpy()[order])))
        if not depth:
            capacity = max(capacity, -(-int(totals[-1]) // MAX_BUCKETS))

        def load(bucket: tuple[int, int]) -> int:
            local, p = bucket
            low, high = p << (wide - local), (p + 1 << (wide - local)) - 1
            at = np.searchsorted(names, np.array([low], np.uint64), "left")[0]
            to = np.searchsorted(names, np.array([high], np.uint64), "right")[0]
            return int(totals[to] - totals[at])

        waiting, overfull = overfull, []
        while waiting:
            bucket = waiting.pop()
            if load(bucket) > capacity:
                if bucket[0] < wide:
                    waiting.extend(directory.split(bucket))
                else:
                    overfull.append(bucket)
        depth = wide
    return directory


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _owner_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, chain = None, []  # of the current key: [text, keep_row, keep_id]
    for batch in batches:
        kept_rows, kept_ids, places = [], [], []
        for k, row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "doc_id", "text"))):
            if k != key:
                key, chain = k, []
            for place, link in enumerate(chain):
                if link[0] == text:
                    break
            else:  # entries of a key come smallest row first
                place, link = len(chain), (text, row, doc_id)
                chain.append(link)
            places.append(place)
            kept_rows.append(link[1])
            kept_ids.append(link[2])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("bucket"),
                batch.column("key"),
                pa.array(places, pa.int32()),
                batch.column("entry"),
                pa.array(kept_rows, pa.int64()),
                pa.array(kept_ids, pa.int64()),
                batch.column("copies"),
            ],
            names=["bucket", "key", "place", "entry", "keep_row", "keep_id", "copies"],
        )


def _indexed(
    docs: DataFrame, id_col: str, text_col: str, capacity: int, hash_text, row_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, index): rows with the entry they belong to, and entries with the row that stays."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        text_bytes(text_col).alias("text"),
        (F.monotonically_increasing_id() if row_col is None else column(row_col)).alias("row"),
    )
    local = materialise(source.mapInArrow(_local_chains(hash_text), _LOCAL), "dedup-local", ("head",))
    entries = local.where("head").select("key", "row", "doc_id", "entry", "copies", "text")
    members = local.where("not head").select("row", "doc_id", "entry", "text_sha256")

    starts = np.array(build_directory(entries, capacity).starts(), np.uint64)
    shared_starts = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        found = np.searchsorted(shared_starts.value, keys.to_numpy().view(np.uint64), "right") - 1
        return pd.Series(found.astype(np.int32))

    owners = -(-len(starts) // OWNED_BUCKETS)
    owned = (
        entries.withColumn("bucket", bucket_of("key"))
        .repartitionById(owners, F.floor(F.col("bucket") / F.lit(OWNED_BUCKETS)).cast("int"))
        .sortWithinPartitions("bucket", "key", F.col("doc_id").asc_nulls_last(), "row")
    )
    index = materialise(
        owned.mapInArrow(
            _owner_chains, "bucket int, key long, place int, entry long, keep_row long, keep_id long, copies long"
        ),
        "dedup-index",
    )
    return members, index


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_ENTRIES,
    hash_text=default_hash,
) -> DataFrame:
    """One row per input row: row, doc_id, keep_id, group_size, kept, text_sha256, bucket, place.

    ``row`` tells repeated ids apart; ``place`` is the position in the chain of the row's key;
    ``hash_text`` can be replaced, as the result does not depend on it.
    """
    members, index = _indexed(docs, id_col, text_col, capacity, hash_text)
    sizes = index.groupBy("keep_row").agg(F.sum("copies").alias("group_size"))
    sized = index.join(sizes, "keep_row").select("entry", "keep_row", "keep_id", "group_size", "bucket", "place")
    return members.join(sized, "entry").select(
        "row",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
        "bucket",
        "place",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without exact copies, all columns kept; rows are told apart by number."""
    spark = docs.sparkSession
    rows, (doc_id, text), restore = numbered(docs, "dedup-rows", id_col, text_col)
    path = new_folder(spark, "dedup-kept")
    with workspace(spark):
        _, index = _indexed(rows, doc_id, text, BUCKET_ENTRIES, default_hash, "row")
        kept = listed(index.select(F.col("keep_row").alias("row")).distinct(), "dedup-kept", path)
    return restore(rows.where(kept))
