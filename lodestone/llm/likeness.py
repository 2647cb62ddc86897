"""Near copies down to a similarity of 0.8, by wide SimHashes, Gray-order indexes and exact verification.

The 64-bit rule of ``lodestone.llm.simhash`` (three differing bits) is far stricter than a Jaccard similarity
of 0.8 over shingles of five words, at which about 15 % of the bits of a SimHash differ.  This search widens
that operator to it:

*Fingerprints.*  The same majority of bits, over the distinct five-word shingles, with ``WORDS`` times 64 bits.

*Owners.*  A fingerprint goes to ``TABLES`` owners, each named by ``SAMPLED`` of its bits, drawn once by a seed.
At a similarity of exactly 0.8 two texts share such an owner with probability 0.95, at 0.85 with 0.99; unrelated
texts share one of ``2 ** SAMPLED`` keys.  An owner searches a ``GrayIndex`` over the first 64 bits and compares the
``CARRIED`` words that travel with a row.

*Forest.*  Only the edges of a minimum spanning forest (by differing bits) leave an owner, never all pairs: of a group of
n like texts n - 1 edges.  Blocks of pairs are folded into the forest as they are found, and pairs that closer edges
already connect are dropped, so a task holds its rows, a forest and a block.

*Verification.*  Each distinct edge is decided by the exact Jaccard similarity of its two shingle sets; sets of
texts with many edges are dealt to many tasks.  What the owners suggest is thus never trusted.

*Rounds.*  An edge to a look-alike can hide one to a true copy, so the search is repeated over the rows that had edges,
without those that are linked now: of each component its row with most links stays in the search.  It ends when a round links nothing.
What two texts share no owner for, lies beyond the radius, or stays hidden at the end is missed
(``tests/llm/test_likeness.py`` measures the recall by bands and in a large group).

Defined cases: texts without a word have no shingles and are linked with none; fewer than five words are one
shingle; words are split and lower-cased as in ``simhash``; null ids come last, of rows that repeat an id the first as read stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components, join_hubs
from lodestone.llm.shared import among, listed, materialise, new_folder, numbered, parts_of, small_batches, text_bytes, workspace
from lodestone.llm.simhash import OWNED_NODES, OWNERS, SEED, GrayIndex, gray_rank, near_duplicates, spanning_star

SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint, and those of them that travel to owners.
WORDS, CARRIED = 4, 2
#: Owners of a fingerprint, and the bits that name each.
TABLES, SAMPLED = 40, 16
#: Differing bits in the first word, and in the carried words, up to which two rows are compared exactly.
FIRST_RADIUS, RADIUS = 18, 28
#: Rows that an owner task looks at together; whole groups only.
TOGETHER = 1 << 16
#: Differing bits between two steps at which a forest remembers what is connected.
LEVEL = 4


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a text in UTF-8, sorted."""
    words = text.lower().split()  # bytes: A-Z alone, blanks of ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: 1 - size].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64))


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits for each hash: the finaliser of the splitmix64 generator, ``word`` steps on."""
    z = hashes + np.uint64((word * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words whose bits are set where over half of the hashes set them."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        wide = np.stack([_mixed(part, w) for w in range(WORDS)], axis=1)
        total += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def _sampled_masks() -> np.ndarray:
    """The bits that name the owner of each table, as masks of the words."""
    rng = np.random.default_rng(SEED)
    masks = np.zeros((TABLES, WORDS), np.uint64)
    for table in masks:
        for bit in rng.choice(64 * WORDS, SAMPLED, replace=False).tolist():
            table[bit // 64] |= np.uint64(1 << (bit % 64))
    return masks.view(np.int64)


def _chosen(batch: pa.RecordBatch, lists: tuple[str, ...]) -> tuple[list[int], list[bytes]]:
    """(row numbers, texts) of the rows of a batch that all lists name.

    Lists are read where texts are hashed: a filter before that would need a second worker for each task.
    """
    rows = batch.column(0).to_numpy()
    keep = np.ones(len(rows), bool)
    for path in lists:
        keep &= among(path, rows)
    return rows[keep].tolist(), batch.column(1).filter(pa.array(keep)).to_pylist()


def _prints(lists: tuple[str, ...]):
    names = ["row", *[f"p{w}" for w in range(WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints = [], []
            for row, text in zip(*_chosen(batch, lists)):
                hashes = shingles(text)
                if len(hashes):
                    rows.append(row)
                    prints.append(wide_fingerprint(hashes))
            held = np.array(prints, np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *[pa.array(held[:, w]) for w in range(WORDS)]], names=names)

    return run


def _sets(lists: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = _chosen(batch, lists)
            found = [shingles(text).view(np.int64) for text in texts]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["row", "hashes"])

    return run


class Forest:
    """Minimum spanning forest of pairs that come in blocks."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.i, self.j, self.apart = (np.empty(0, np.int64) for _ in range(3))
        self.labels = np.tile(np.arange(n), (RADIUS // LEVEL + 1, 1))

    def add(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        level = apart // LEVEL
        new = self.labels[level, i] != self.labels[level, j]  # else edges at most as long connect them
        if not new.any():
            return
        i, j, apart = (np.concatenate((a, b[new])) for a, b in ((self.i, i), (self.j, j), (self.apart, apart)))
        order = np.argsort(apart, kind="stable")
        root, kept = list(range(self.n)), []
        for at, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(at)
        self.i, self.j, self.apart = i[kept], j[kept], apart[kept]
        for level, label in enumerate(self.labels):
            near = self.apart <= level * LEVEL
            label[:] = np.arange(self.n)
            moved, to = spanning_star(self.n, iter([(self.i[near], self.j[near])]))
            label[moved] = to


def like_pairs(groups: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places) of the forest over rows of equal group within the radius; ``words`` has a column a carried word."""
    order = np.lexsort((gray_rank(words[:, 0]), groups))
    sorted_words, forest = words[order], Forest(len(order))
    for i, j in GrayIndex(groups[order], sorted_words[:, 0]).links(FIRST_RADIUS):
        apart = np.bitwise_count(sorted_words[i] ^ sorted_words[j]).sum(axis=1, dtype=np.int64)
        near = apart <= RADIUS
        if near.any():
            forest.add(i[near], j[near], apart[near])
    return order[forest.i], order[forest.j]


def _owner_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def edges(groups: np.ndarray, rows: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
        i, j = like_pairs(groups, words)
        a, b = np.minimum(rows[i], rows[j]), np.maximum(rows[i], rows[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held, size = [], 0
    for batch in batches:
        words = np.stack([batch.column(f"p{w}").to_numpy().view(np.uint64) for w in range(CARRIED)], axis=1)
        held.append((batch.column("group").to_numpy(), batch.column("row").to_numpy(), words))
        size += batch.num_rows
        if size >= TOGETHER:
            whole = [np.concatenate(part) for part in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))  # the last group may go on
            if cut:
                yield edges(*[part[:cut] for part in whole])
            held, size = [tuple(part[cut:] for part in whole)], size - cut
    if size:
        yield edges(*[np.concatenate(part) for part in zip(*held)])


def suggested(prints: DataFrame, rows: int) -> DataFrame:
    """(a, b) of ``row`` numbers: the edges of all owners' forests over the ``rows`` rows of ``prints``."""
    keys = [
        F.xxhash64(F.lit(n), *[F.col(f"p{w}").bitwiseAND(F.lit(mask)) for w, mask in enumerate(masks)])
        for n, masks in enumerate(_sampled_masks().tolist())
    ]
    carried = [f"p{w}" for w in range(CARRIED)]
    dealt = prints.select("row", *carried, F.explode(F.array(*keys)).alias("group"))
    owners = min(OWNERS, -(-rows * TABLES // (OWNED_NODES * 8)) or 1)
    owned = dealt.repartition(owners, "group").sortWithinPartitions("group")
    return materialise(owned.mapInArrow(_owner_edges, "a long, b long").distinct(), "like-edges")


def ends_of(edges: DataFrame) -> DataFrame:
    """(row, degree) of the ends of edges."""
    return edges.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("degree"))


def verified(edges: DataFrame, sets: DataFrame, ends: DataFrame) -> DataFrame:
    """The edges whose texts have a similarity of at least ``SIMILARITY``; ``sets`` are (row, hashes), ``ends`` those of ``edges``."""
    total = edges.count()
    held = sets.join(ends, "row")
    side = lambda end: held.select(F.col("row").alias(end), F.col("hashes").alias(f"of_{end}"), "degree")
    both = join_hubs(join_hubs(edges, side("a"), "a", total), side("b"), "b", total)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    # Whole numbers decide, so a similarity of exactly 0.8 counts.
    alike = shared * 100 >= (F.size("of_a") + F.size("of_b") - shared) * round(100 * SIMILARITY)
    return both.where(alike).select("a", "b")


def similar_links(rows: DataFrame, text_col: str = "text", lists: tuple[str, ...] = ()) -> DataFrame:
    """(a, b) of ``row`` numbers whose texts have a similarity of at least ``SIMILARITY``: edges that connect like texts.

    Only rows that every list of ``lists``, written by ``parts_of``, names take part.
    """
    spark = rows.sparkSession
    small_batches(spark)
    source = rows.select("row", text_bytes(text_col).alias("text"))
    prints = materialise(source.mapInArrow(_prints(lists), ", ".join(["row long", *[f"p{w} long" for w in range(WORDS)]])), "wide-prints")
    # An empty table of the driver's would be a Python one, with workers of its own.
    sets, links = None, spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    while active := prints.count():
        edges = suggested(prints, active)
        ends = materialise(ends_of(edges), "like-degrees")  # edges become their ends once, not in each of the steps below
        if sets is None:  # later edges have no other ends
            named = parts_of(ends.select("row"), "row", "like-ends")
            sets = materialise(source.mapInArrow(_sets((*lists, named)), "row long, hashes array<long>"), "like-sets")
        found = materialise(verified(edges, sets, ends), "like-links")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        members = components(found).withColumnRenamed("node", "row")
        hub = F.max_by("row", F.struct("degree", -F.col("row"))).alias("row")
        hubs = members.join(ends_of(found), "row").groupBy("root").agg(hub)
        gone = members.join(hubs, "row", "left_anti").select("row")
        left = ends.join(gone, "row", "left_anti")
        prints = materialise(prints.join(left, "row", "left_semi"), "wide-prints")
    return links


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that with the smallest id; all columns kept.

    Groups are the components of ``simhash.near_duplicates``, joined further where rows that stay of them are similar.
    """
    spark = docs.sparkSession
    rows, (doc_id, text), restore = numbered(docs, "near-rows", id_col, text_col)
    first, path = new_folder(spark, "near-first"), new_folder(spark, "near-kept")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    with workspace(spark):
        found = near_duplicates(rows, doc_id, text, row_col="row")
        stay = materialise(found.groupBy("root").agg(least).select("least.row", "least.doc_id"), "near-stay")
        parts_of(stay.select("row"), "row", "near-first", first)
        links = materialise(similar_links(rows, text, (first,)), "near-links")
        roots = components(links).withColumnRenamed("node", "row")
        groups = stay.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
        kept = listed(groups.groupBy("root").agg(least).select(F.col("least.row").alias("row")), "near-kept", path)
    return restore(rows.where(kept))
