"""SimHash near-duplicates through a Gray-order hierarchical index.

*Fingerprints.*  Words of the text with A-Z in lower case, shingles of three words with repeats, XXH64
of each, majority of every bit.  Equal fingerprints are one node from here on.

*Index.*  Fingerprints are sorted by Gray rank, so that neighbours differ in few bits.  Leaves are runs of
neighbours; a node of the index keeps the bits that all fingerprints below it share (a mask and their
values), and its parent factors out what its children share, up to one node over all.  The search goes
down pairs of nodes: differences in bits that both masks hold bound those of all pairs below, so pairs of
whole groups with more than three such differences are dropped at once.  Linked pairs become
components right away, and only a spanning star of each leaves the task, never all pairs.

*Owners.*  One task searches an index of about ``group_nodes`` fingerprints.  A larger table is dealt to
more: two fingerprints within three bits agree in one of four blocks of 16 bits, so each goes to four owners,
named by the block and as many leading bits of its value as the number of owners asks for.  Groups that
near copies make much larger are dealt again, up to ``REDEALS`` times, by blocks of the bits that their members
do not share, for which the same argument holds, so no link is lost.  What is large after that agrees in 37
of 64 bits; its owner holds eight bytes of each distinct fingerprint, and 27 free bits bound their number.

*Components* of all owners' stars are joined by ``lodestone.llm.components``.

Defined cases: null and empty texts have no words and fingerprint zero, which is linked like any
other; texts of fewer than three words are one shingle; repeated rows count each; null ids never name
a component (it is null if all its ids are); an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, join_hubs
from lodestone.llm.shared import column, listed, materialise, new_folder, numbered, small_batches, text_bytes, workspace

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that an owner's index should hold, and how many times that it may.
GROUP_NODES, OVERFULL = 16_384, 4
#: Times that overfull groups are dealt again; each time makes four copies of their rows.
REDEALS = 2
#: Fingerprints that an owner task takes, whole groups only, and owner tasks, at most.
OWNED_NODES, OWNERS = 8192, 50_000
#: Fingerprints in a leaf, children of an upper node, and pairs looked at in one step.
LEAF, FAN, STEP = 4, 4, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text given as UTF-8."""
    words = text.lower().split()  # bytes: A-Z alone, blanks of ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: 1 - shingle].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    # Bits of at most 255 hashes are summed as bytes at a time.
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduce(bits, axis=0, dtype=np.int32) if len(bits) < 4096 else _long_sum(bits)
    value = np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)
    return int(value[0])


def _long_sum(bits: np.ndarray) -> np.ndarray:
    return sum(np.add.reduce(bits[i : i + 4096], axis=0, dtype=np.int64) for i in range(0, len(bits), 4096))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray-code order."""
    rank = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Hierarchy over fingerprints in (group, Gray rank) order; nodes never span two groups.

    ``levels[0]`` are the leaves.  Each level has, for its nodes, the first and last child, a mask of
    the bits all fingerprints below share, and their values.
    """

    def __init__(self, groups: np.ndarray, values: np.ndarray) -> None:
        self.values = values
        self.compared = 0  # pairs of nodes and of fingerprints that the search has looked at
        n = len(values)
        cut = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.empty(0, np.int64)
        self.levels = []
        mask, value, fan = np.full(n, ~np.uint64(0)), values, LEAF
        while True:
            sizes = np.diff(np.concatenate((cut, [len(value)])))
            per = -(-sizes // fan)
            group_of = np.repeat(np.arange(len(cut)), per)
            within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            first = cut[group_of] + within * fan
            last = np.minimum(first + fan, (cut + sizes)[group_of])
            if not len(first):
                break
            every = np.bitwise_and.reduceat(value, first)
            some = np.bitwise_or.reduceat(value, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(every ^ some)
            mask, value = shared, every & shared
            self.levels.append((first, last, mask, value))
            cut = np.cumsum(per) - per
            if (per <= 1).all():
                break
            fan = FAN

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of places (i < j) within ``radius`` differing bits in the same group."""
        if self.levels:
            top = np.arange(len(self.levels[-1][0]))
            for at in range(0, len(top), STEP):
                yield from self._below(len(self.levels) - 1, top[at : at + STEP], top[at : at + STEP], radius)

    def _below(self, level: int, a: np.ndarray, b: np.ndarray, radius: int):
        first, last, mask, value = self.levels[level]
        self.compared += len(a)
        apart = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b])
        near = apart <= radius
        a, b = a[near], b[near]
        widths = (last[a] - first[a]) * (last[b] - first[b])
        ends = np.cumsum(widths)
        at = 0
        while at < len(a):  # expand as many pairs at a time as a step holds
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + STEP * 4, "right")))
            x, y, w = a[at:to], b[at:to], widths[at:to]
            place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            width = np.repeat(last[y] - first[y], w)
            i = np.repeat(first[x], w) + place // width
            j = np.repeat(first[y], w) + place % width
            keep = i < j if level == 0 else i <= j
            i, j = i[keep], j[keep]
            if level:
                for k in range(0, len(i), STEP):
                    yield from self._below(level - 1, i[k : k + STEP], j[k : k + STEP], radius)
            else:
                self.compared += len(i)
                close = np.bitwise_count(self.values[i] ^ self.values[j]) <= radius
                if close.any():
                    yield i[close], j[close]
            at = to


def spanning_star(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each linked place with the smallest place of its component."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "row", "print"]
        )


#: Rows that an owner task looks at together; whole groups only.
_TOGETHER = 1 << 16


def _owner_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars(groups: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(prints), groups))
        groups, prints = groups[order], prints[order]
        moved, root = spanning_star(len(prints), GrayIndex(groups, prints).links(RADIUS))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root])], names=["a", "b"])

    held_groups, held = [], []
    size = 0
    for batch in batches:
        held_groups.append(batch.column("group").to_numpy())
        held.append(batch.column("print").to_numpy().view(np.uint64))
        size += batch.num_rows
        if size >= _TOGETHER:
            groups, prints = np.concatenate(held_groups), np.concatenate(held)
            cut = int(np.searchsorted(groups, groups[-1], "left"))  # the last group may go on
            if cut:
                yield stars(groups[:cut], prints[:cut])
                held_groups, held, size = [groups[cut:]], [prints[cut:]], size - cut
            else:
                held_groups, held = [groups], [prints]
    if size:
        yield stars(np.concatenate(held_groups), np.concatenate(held))


def _blocks(free: int, bits: int) -> list[int]:
    """The first ``bits`` bits of each of four blocks that part the bits of ``free``."""
    places = [i for i in range(64) if free >> i & 1]
    step = -(-len(places) // 4)
    return [sum(1 << i for i in places[k * step : (k + 1) * step][:bits]) for k in range(4)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


_ALL = (1 << 64) - 1


def _deal(rows: DataFrame, shared: list[int], bits: int) -> tuple[DataFrame, list[int]]:
    """Four copies of every (path, print) row, one for each block of the bits that its group does not share.

    ``shared[path]`` are the bits that the rows of a path agree in within their group.  Returns
    (path, group, print) rows and the shared bits of the new paths.
    """
    masks = [mask | block for mask in shared for block in _blocks(~mask & _ALL, bits)]
    steps = F.array(
        *[
            F.array(*[F.struct(F.lit(p).alias("path"), _signed(masks[p]).alias("mask")) for p in range(4 * n, 4 * n + 4)])
            for n in range(len(shared))
        ]
    )
    return rows.select("print", F.explode(F.get(steps, F.col("path"))).alias("next")).select(
        F.col("next.path").alias("path"),
        F.xxhash64(F.col("next.path"), F.col("print").bitwiseAND(F.col("next.mask"))).alias("group"),
        "print",
    ), masks


def _grouped(nodes: DataFrame, group_nodes: int) -> tuple[DataFrame, int]:
    """((group, print) rows in which any two prints within the radius share a group, their number)."""
    spark = nodes.sparkSession
    n = nodes.count()
    start = nodes.select(F.lit(0).alias("path"), "print")
    bits = min(16, max(0, (-(-n // group_nodes) - 1).bit_length()))
    if not bits:
        return start.select(F.lit(0).cast("long").alias("group"), "print"), n
    rows, shared = _deal(start, [0], bits)
    done, total = [], 4 * n
    for _ in range(REDEALS):
        sizes = rows.groupBy("path", "group").agg(F.count("*").alias("n")).where(F.col("n") > OVERFULL * group_nodes)
        large = materialise(sizes, "large-groups")
        held = large.agg(F.sum("n")).first()[0]
        if held is None:
            break
        names = large.select("path", "group")
        done.append(rows.join(names, ["path", "group"], "left_anti"))
        free = 64 - max(mask.bit_count() for mask in shared)
        rows, shared = _deal(rows.join(names, ["path", "group"], "left_semi").select("path", "print"), shared, free // 4)
        rows = materialise(rows, "dealt-again")
        total += 3 * held
    return reduce(DataFrame.unionByName, [part.select("group", "print") for part in [*done, rows]]), total


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_nodes: int = GROUP_NODES,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, linked (whether the
    component holds more than one fingerprint), root (the component's own name), row (its number)."""
    small_batches(docs.sparkSession)
    source = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        text_bytes(text_col).alias("text"),
        (F.monotonically_increasing_id() if row_col is None else column(row_col)).alias("row"),
    )
    prints = materialise(source.mapInArrow(_fingerprints, "doc_id long, row long, print long"), "prints")
    prints = prints.withColumn("part", F.shiftright("row", 33))
    nodes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "print-nodes")

    grouped, total = _grouped(nodes, group_nodes)
    owners = min(OWNERS, -(-total // OWNED_NODES) or 1)
    owned = grouped.repartition(owners, "group").sortWithinPartitions("group")
    roots = components(owned.mapInArrow(_owner_links, "a long, b long"))
    named = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    named = materialise(named, "print-roots")
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("degree"))
    labels = join_hubs(named.select("print", "root", "linked"), firsts, "root", total)
    # A fingerprint that many rows share is met once for each part of the table, then part by part.
    local = prints.select("part", "print").distinct().join(labels, "print")
    return prints.join(local, ["part", "print"]).select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        "linked",
        "root",
        "row",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, that with the smallest id; all columns kept.

    Null ids come last; of rows that repeat the smallest id the first as read stays.
    """
    spark = docs.sparkSession
    rows, (doc_id, text), restore = numbered(docs, "near-rows", id_col, text_col)
    path = new_folder(spark, "near-kept")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    with workspace(spark):
        found = near_duplicates(rows, doc_id, text, row_col="row")
        kept = listed(found.groupBy("root").agg(least).select(F.col("least.row").alias("row")), "near-kept", path)
    return restore(rows.where(kept))
