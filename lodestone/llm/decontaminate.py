"""Benchmark decontamination with spaced seeds.

A spaced seed is a mask over consecutive tokens: it hashes the tokens under ``1`` and ignores those
under ``0``, so a substituted token under a hole does not hide a match.  ``SEEDS`` hit every pair of
13-token windows that differ in at most two places, wherever those are (a test walks through all
cases); benchmark items shorter than 13 tokens get every mask with as many holes as they may have
substitutions.  No leak that the rule below describes can therefore be missed.

*Rule.*  Tokens are the lower-cased runs between ASCII punctuation, blanks and control characters.
A document holds a leak of an item if, along one alignment without gaps, some window of
``min(13, item length)`` tokens agrees in at least 80 % of its places.

Benchmark seeds are hashed in blocks of at most ``block_tokens`` tokens; each block is a bounded
broadcast that is joined with all documents, so a benchmark of any size works.  Documents outside
the block's vocabulary cost one dictionary lookup per word.

Defined cases: null and empty texts hold no tokens and no leaks; null ids stay null; items of fewer than
five tokens are reported where they occur as they stand, those without tokens never; items with equal texts
are reported each; repeated rows are reported each; an empty benchmark gives an empty result; other columns
are ignored.  ``min_item`` leaves out items of fewer tokens than that; none by default.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import column, listed, numbered, small_batches

#: Tokens of the window that a leak must agree in, and the share that must agree.
WINDOW = 13
SIMILARITY = 0.8
#: Masks that between them hit any window of 13 tokens with up to two substitutions.
SEEDS = ("11101011", "11001111")
#: Benchmark tokens in one broadcast.
BLOCK_TOKENS = 2_000_000

_SPLIT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

SCHEMA = "doc_id long, item_id long, overlap_tokens int, matched_tokens int, doc_start long, item_start int"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("overlap_tokens", pa.int32()),
        ("matched_tokens", pa.int32()),
        ("doc_start", pa.int64()),
        ("item_start", pa.int32()),
    ]
)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def needed(window: int) -> int:
    """Tokens of a window that must agree."""
    return -(-window * 4 // 5)


def masks_for(window: int) -> tuple[str, ...]:
    """Masks that hit every allowed pattern of substitutions in a window of this length."""
    if window >= WINDOW:
        return SEEDS
    holes = window - needed(window)
    found = {}
    for places in itertools.combinations(range(window), holes):
        found["".join("0" if i in places else "1" for i in range(window)).strip("0")] = None
    return tuple(found)


class Seeds:
    """Seed hashes of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, list[bytes]]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = [
            (item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
            for item_id, words in items
        ]
        by_mask: dict[str, list[tuple[int, int, int]]] = {}
        for n, (_, ids) in enumerate(self.items):
            for mask in masks_for(min(WINDOW, len(ids))):
                at = np.arange(len(ids) - len(mask) + 1)
                for place, value in zip(at.tolist(), _hash(ids, at, mask).tolist()):
                    by_mask.setdefault(mask, []).append((value, n, place))
        self.tables = {}
        for mask, rows in by_mask.items():
            rows.sort()
            values, numbers, places = zip(*rows)
            self.tables[mask] = (
                np.array(values, np.uint64),
                np.array(numbers, np.int64),
                np.array(places, np.int64),
            )

    def alignments(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, start of the item in ids) pairs that some seed hits."""
        known = ids != 0
        found = []
        for mask, (values, numbers, places) in self.tables.items():
            on = [i for i, c in enumerate(mask) if c == "1"]
            n = len(ids) - len(mask) + 1
            if n <= 0:
                continue
            good = known[on[0] : on[0] + n].copy()
            for offset in on[1:]:
                good &= known[offset : offset + n]
            at = np.flatnonzero(good)
            if not len(at):
                continue
            hashed = _hash(ids, at, mask)
            low = np.searchsorted(values, hashed, "left")
            count = np.searchsorted(values, hashed, "right") - low
            hit = count > 0
            low, count, at = low[hit], count[hit], at[hit]
            spread = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            found.append(np.stack([numbers[spread], np.repeat(at, count) - places[spread]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _hash(ids: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    value = np.zeros(len(at), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            value = (value + ids[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    return value


def overlap(ids: np.ndarray, start: int, item: np.ndarray) -> tuple[int, int, int] | None:
    """(tokens in agreeing windows, tokens that agree in them, first such place of the item), if any window agrees."""
    window = min(WINDOW, len(item))
    first, last = max(0, -start), min(len(item), len(ids) - start)
    if not window or last - first < window:
        return None
    same = ids[start + first : start + last] == item[first:last]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[window:] - sums[:-window] >= needed(window))
    if not len(good):
        return None
    edge = np.zeros(len(same) + 1, np.int64)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return int(covered.sum()), int((covered & same).sum()), first + int(good[0])


def _leaks(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = broadcast.value
        number = seeds.vocabulary.get
        for batch in batches:
            lengths, parts = [], []
            for text in batch.column(1).to_pylist():
                ids = [number(w, 0) for w in tokens(text)]
                ids.append(0)  # no seed spans two documents
                lengths.append(len(ids))
                parts.append(np.array(ids, np.int64))
            starts = np.concatenate(([0], np.cumsum(lengths)))
            rows = {}
            # An alignment may begin before its document; what a seed hit lies in decides the document.
            for doc in _documents_hit(seeds, parts):
                ids = parts[doc][:-1]
                for n, start in seeds.alignments(ids).tolist():
                    if (found := overlap(ids, start, seeds.items[n][1])) is not None:
                        size, agreed, place = found
                        best = rows.get((doc, n))
                        if best is None or (-size, -agreed, start + place) < (-best[0], -best[1], best[2]):
                            rows[doc, n] = (size, agreed, start + place, place)
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([doc for doc, _ in rows], pa.int64())),
                    pa.array([seeds.items[n][0] for _, n in rows], pa.int64()),
                    pa.array([r[0] for r in rows.values()], pa.int32()),
                    pa.array([r[1] for r in rows.values()], pa.int32()),
                    pa.array([r[2] for r in rows.values()], pa.int64()),
                    pa.array([r[3] for r in rows.values()], pa.int32()),
                ],
                schema=_ARROW,
            )

    return run


def _documents_hit(seeds: Seeds, parts: list[np.ndarray]) -> list[int]:
    """Documents of a batch that any seed hits, found in one pass over the joined batch."""
    if not parts:
        return []
    joined = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    known = joined != 0
    found = []
    for mask, (values, _, _) in seeds.tables.items():
        on = [i for i, c in enumerate(mask) if c == "1"]
        n = len(joined) - len(mask) + 1
        if n <= 0:
            continue
        good = known[on[0] : on[0] + n].copy()
        for offset in on[1:]:
            good &= known[offset : offset + n]
        at = np.flatnonzero(good)
        hashed = _hash(joined, at, mask)
        low = np.searchsorted(values, hashed, "left")
        hit = (low < len(values)) & (values[np.minimum(low, len(values) - 1)] == hashed)
        # A hole may lie over a document's end: the document of the first token is enough, as later
        # documents are reported by seeds of their own.
        found.append(np.searchsorted(ends, at[hit], "right"))
    return np.unique(np.concatenate(found)).tolist() if found else []


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_tokens: int, min_item: int) -> Iterator[list]:
    """Benchmark items in bounded blocks, one item at a time from one partition after another."""
    block, size = [], 0
    rows = benchmark.select(column(item_col).cast("long").alias("i"), column(text_col).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        words = tokens(row.t)
        if len(words) < max(1, min_item):
            continue
        if block and size + len(words) > block_tokens:
            yield block
            block, size = [], 0
        block.append((row.i, words))
        size += len(words)
    if block:
        yield block


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    min_item: int = 1,
) -> DataFrame:
    """One row for each row of ``docs`` and benchmark item that it leaks: doc_id, item_id,
    overlap_tokens, matched_tokens, doc_start, item_start (places count tokens from 0)."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, block_tokens, min_item):
        shared = spark.sparkContext.broadcast(Seeds(block))
        part = source.mapInArrow(_leaks(shared), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_item: int = 1
) -> DataFrame:
    """The rows of ``docs`` whose text leaks no benchmark item, all columns kept; rows are told apart by number."""
    rows, (text,), restore = numbered(docs, "leak-rows", text_col)
    leaked = benchmark_leaks(rows, benchmark, "row", text, min_item=min_item).select(F.col("doc_id").alias("row"))
    return restore(rows.where(~listed(leaked.distinct(), "leaks")))
