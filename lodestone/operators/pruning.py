"""Exact best rows of many queries without scoring every pair.

An index numbers its chunks in blocks of ``BLOCK`` neighbours and keeps, beside the postings, the largest impact of every
term in every block.  The sum of a query's largest impacts bounds the score of every chunk of the block.  A
request takes the asked terms' rows of both tables (sorted by term, so few terms read few row groups) and goes
three ways over them:

1. bounds of (query, block), so one sum for each block, not for each chunk;
2. exact scores of the few blocks with the highest bounds, whose k-th best score is a floor;
3. exact scores of the blocks whose bounds reach the floor (and the threshold).  Their terms meet postings by (block,
   term), so the postings of all other blocks are skipped; no chunk of the result can lie in them.

Impacts are kept as raw counts and as shares of the chunk's length under the statistics of the whole index.  A
lifecycle filter changes document frequencies, and with them lengths; the largest ratio of old to new idf then
bounds what a share can have grown to, so bounds stay bounds and scores are exact under the filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone import storage
from lodestone.functions import text as t
from lodestone.operators.retrieval import BROADCAST_TERMS, KEY, blocks, frequent, parquet_table, small

BLOCK_BITS = 4
BLOCK = 1 << BLOCK_BITS
#: A bound is a sum in another order than the score, so it may fall short of it by rounding.
SLACK = 1 + 1e-9
#: Scores are ranked as rounded to four places.
ROUNDING = 1e-4


def with_blocks(chunks: DataFrame) -> DataFrame:
    """Chunks with the number of their block; to be written at once, as it depends on where a row lies."""
    return chunks.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))


#: What a byte of UTF-8 is in a token: letters in lower case, digits and ``_`` as they are, all else a blank.  Bytes of letters
#: beyond ASCII are blanks too, so no other letter turns into one of a token.
_IN_TOKENS = bytes(ord(chr(b).lower()) if re.fullmatch(t.TOKEN, chr(b)) else 32 for b in range(256))


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(offsets, places in it, words, counts): the distinct tokens of each text and how often it has them."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    lowered = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_IN_TOKENS))
    found = pa.compute.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, lowered], offset=texts.offset))
    row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(found).to_numpy())
    words = found.flatten().dictionary_encode()
    place, n = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    # Blanks at the ends of a text leave an empty word.
    said = place != pa.compute.index(words.dictionary, "").as_py()
    pairs, counts = np.unique(row[said] * n + place[said], return_counts=True)
    return np.searchsorted(pairs // n, np.arange(len(texts) + 1)), pairs % n, words.dictionary.cast(pa.string()), counts


def term_counts(chunks: DataFrame) -> DataFrame:
    """(block, keys, terms, tfs): a row for each chunk, its distinct tokens and how often it has them."""
    held = chunks.select("block", *KEY, "text")
    out = T.StructType([f for f in held.schema if f.name != "text"]).add("terms", T.ArrayType(T.StringType())).add("tfs", T.ArrayType(T.LongType()))
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, place, words, counts = _cut(batch.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (words.take(pa.array(place)), pa.array(counts))]
            columns = [*batch.drop_columns(["text"]).columns, *lists]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    return held.mapInArrow(run, out)


def exploded(counts: DataFrame) -> DataFrame:
    """(term, tf) of every row of ``counts`` beside its other columns."""
    rest = [c for c in counts.columns if c not in ("terms", "tfs")]
    return counts.select(*rest, F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(*rest, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


#: Chunks that a task sorts or groups the postings of; some hundred terms each.
TASK_CHUNKS = 4096


def dealt(rows: DataFrame, chunks: int) -> DataFrame:
    """``rows`` by block in tasks of about ``TASK_CHUNKS`` of ``chunks``, so a task's memory does not grow with the table."""
    return rows.repartition(max(1, -(-chunks // TASK_CHUNKS)), "block")


def flat_postings(counts: DataFrame, n: int) -> DataFrame:
    """(block, keys, term, tf) of all tokens, sorted; rows of chunks are dealt, so no posting is moved."""
    return exploded(dealt(counts, n)).sortWithinPartitions("term", "block")


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


#: Chunks whose terms are looked up at a time.
LOOKED_UP = 16384


def _squares(path: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = parquet_table(path)
        names, idfs = known["term"].combine_chunks(), np.append(known["idf"].to_numpy(), 0.0)
        for batch in blocks(batches, LOOKED_UP):
            lists, n = batch.column("terms"), batch.num_rows
            widths = np.diff(lists.offsets.to_numpy())
            terms, tfs = lists.flatten(), batch.column("tfs").flatten()
            place = pa.compute.index_in(terms, value_set=names).fill_null(-1).to_numpy()
            row, rest = np.repeat(np.arange(n), widths), np.flatnonzero(place < 0)
            squares = np.bincount(row, (tfs.to_numpy() * idfs[place]) ** 2, n)
            offsets = pa.array(np.searchsorted(row[rest], np.arange(n + 1)), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, x.take(pa.array(rest))) for x in (terms, tfs)]
            columns = [*(batch.column(k) for k in KEY), pa.array(squares), pa.array(widths), *left]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    return run


def lengths(counts: DataFrame, weights: DataFrame, path: str) -> DataFrame:
    """(keys, norm, distinct_terms) of the chunks of ``counts`` that have tokens, written at ``path``.

    ``weights`` are (term, df, idf).  A chunk looks its terms up where it lies; of a vocabulary too large for that the most
    frequent ones, and only the postings of the others, of few chunks each, are moved.
    """
    held = counts.where(F.size("terms") > 0).select(*KEY, "terms", "tfs")
    numbers = [T.StructField("squares", T.DoubleType()), T.StructField("distinct_terms", T.LongType())]
    out = T.StructType([*(held.schema[k] for k in KEY), *numbers, held.schema["terms"], held.schema["tfs"]])
    whole = small(weights)
    often = F.lit(True) if whole else F.col("df") >= frequent(weights)
    with storage.scratch(counts.sparkSession, "lengths") as work:
        storage.written(weights.where(often).select("term", "idf"), f"{work}/known")
        found = held.mapInArrow(_squares(f"{work}/known", to_arrow_schema(out)), out)
        total = F.col("squares")
        if not whole:
            found = storage.written(found, f"{work}/found")
            rest = exploded(found.where(F.size("terms") > 0).select(*KEY, "terms", "tfs"))
            rest = rest.join(weights.where(~often).select("term", "idf"), "term")
            found = found.join(rest.groupBy(*KEY).agg(F.sum((F.col("tf") * F.col("idf")) ** 2).alias("more")), KEY, "left")
            total = total + F.coalesce("more", F.lit(0.0))
        return storage.written(found.select(*KEY, F.sqrt(total).alias("norm"), "distinct_terms"), path)


def maxima(counts: DataFrame, lengths: DataFrame, n: int) -> DataFrame:
    """(block, term, top_tf, top_share): the largest impacts of every term in every block."""
    # Chunks meet their norms before they are dealt and cut into terms, so all terms of a block are in one task.
    held = exploded(dealt(counts.join(lengths.select(*KEY, "norm"), KEY), n))
    tops = held.groupBy("block", "term").agg(F.max("tf").alias("top_tf"), F.max(F.col("tf") / F.col("norm")).alias("top_share"))
    return tops.sortWithinPartitions("term", "block")


#: Asked terms up to which a scan is told their names, so that row groups without them are skipped.
NAMED_TERMS = 200


def of_terms(table: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``table`` whose term is one of ``terms`` (distinct)."""
    few = [r.term for r in terms.limit(NAMED_TERMS + 1).collect()]
    if len(few) <= NAMED_TERMS:
        return table.where(F.col("term").isin(few))
    return table.join(F.broadcast(terms) if small(terms) else terms, "term", "left_semi")


@dataclass(frozen=True)
class Statistics:
    """Of the chunks that stay: their number, (term, df, idf), (keys, norm), and the largest old idf / new idf."""

    n: int
    weights: DataFrame
    norms: DataFrame | None
    growth: float


def statistics(spark, path: str, counts: DataFrame, whole: Statistics, gone: DataFrame) -> Statistics:
    """Statistics without the chunks of ``gone`` (keys).

    They are written under ``path`` by the set of chunks that are gone, so requests under one state of the
    lifecycle share them; frequencies are the whole index's less those of what is gone.
    """
    count, xor, total = gone.agg(
        F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*KEY)), F.lit(0)), F.coalesce(F.sum(F.xxhash64(F.lit(1), *KEY).cast("decimal(38,0)")), F.lit(0))
    ).first()
    if not count:
        return whole
    n = whole.n - count
    folder = f"{path}/statistics-{count}-{xor & (1 << 64) - 1:x}-{abs(int(total)):x}"
    if not storage.exists(spark, f"{folder}/norms/_SUCCESS"):
        lost = exploded(counts.join(gone.select(*KEY), KEY, "left_semi")).groupBy("term").agg(F.count("*").alias("lost"))
        left = F.col("df") - F.coalesce("lost", F.lit(0))
        old = F.col("idf").alias("old")
        weights = whole.weights.select("term", "df", old).join(lost, "term", "left").withColumn("df", left).where("df > 0").drop("lost")
        weights = storage.written(weights.withColumn("idf", idf(F.lit(float(n)), F.col("df"))), f"{folder}/weights")
        stay = counts.join(gone.select(*KEY), KEY, "left_anti")
        lengths(stay, weights, f"{folder}/norms")
    weights = spark.read.parquet(f"{folder}/weights")
    growth = weights.agg(F.max(F.col("old") / F.col("idf"))).first()[0]
    return Statistics(n, weights, spark.read.parquet(f"{folder}/norms"), float(growth or 1.0))


class Scorer:
    """Scores before any factor.  ``asked`` has (query_id, asked, term) and what a term weighs in its query;
    ``postings`` and ``tops`` are the index's rows of the asked terms, or functions that open them when they are needed."""

    def __init__(self, asked: DataFrame, postings: DataFrame | Callable, tops: DataFrame | Callable):
        self.asked, self._postings, self._tops = asked, postings, tops

    @cached_property
    def few(self) -> bool:
        return small(self.asked)

    @cached_property
    def postings(self) -> DataFrame:
        return self._postings() if callable(self._postings) else self._postings

    @cached_property
    def tops(self) -> DataFrame:
        return self._tops() if callable(self._tops) else self._tops

    def impact(self) -> Column:
        """The most that a term of a block can add."""
        raise NotImplementedError

    def bound(self, total: Column) -> Column:
        """What the sum of a query's impacts bounds its score by."""
        raise NotImplementedError

    def bounds(self) -> DataFrame:
        """(query_id, block, bound) of every block that shares a term with the query."""
        hits = self.tops.join(F.broadcast(self.asked) if self.few else self.asked, "term")
        return hits.groupBy("query_id", "block").agg(self.bound(F.sum(self.impact())).alias("bound"))

    def hits(self, pairs: DataFrame | None) -> DataFrame:
        """The postings of the asked terms in the blocks of ``pairs`` (query_id, block), in all blocks without them."""
        if pairs is None:
            return self.postings.join(F.broadcast(self.asked) if self.few else self.asked, "term")
        wanted = self.asked.join(pairs, "query_id")
        return self.postings.join(F.broadcast(wanted) if small(wanted) else wanted, ["block", "term"])

    @property
    def scan_metric(self) -> str:
        """The metric of ``scan``."""
        raise NotImplementedError

    def scanned(self, counts: DataFrame) -> DataFrame:
        """``counts`` with what ``scan`` needs of a chunk."""
        return counts

    def exact(self, pairs: DataFrame | None) -> DataFrame:
        """(query_id, keys, base) of the chunks of ``pairs`` that share a term, of all that do without them."""
        raise NotImplementedError


class Lexical(Scorer):
    def __init__(self, asked: DataFrame, postings: DataFrame | Callable, tops: DataFrame | Callable, metric: str, lengths: Callable):
        super().__init__(asked, postings, tops)
        self.metric, self._lengths = metric, lengths

    @cached_property
    def lengths(self) -> DataFrame:
        return self._lengths()

    def impact(self):
        return F.lit(1) if self.metric in ("jaccard", "containment") else F.col("top_tf")

    def bound(self, total):
        # Shares of both sides' terms are at most those of a chunk with no other terms than the shared ones.
        return total / F.max("asked")

    @property
    def scan_metric(self):
        return self.metric if self.metric in ("jaccard", "containment") else "overlap"

    def exact(self, pairs):
        grouped = self.hits(pairs).groupBy("query_id", "asked", *KEY).agg(F.sum("tf").alias("occurrences"), F.count("*").alias("shared"))
        if self.metric == "jaccard":
            grouped = grouped.join(self.lengths.select(*KEY, "distinct_terms"), KEY)
            base = F.col("shared") / (F.col("asked") + F.col("distinct_terms") - F.col("shared"))
        elif self.metric == "containment":
            base = F.col("shared") / F.col("asked")
        else:
            base = F.col("occurrences") / F.col("asked")
        return grouped.select("query_id", *KEY, base.alias("base"))


class Tfidf(Scorer):
    """``asked`` has (query_id, asked, term, idf, q_norm)."""

    def __init__(self, asked: DataFrame, postings: DataFrame, tops: DataFrame, statistics: Statistics):
        super().__init__(asked, postings, tops)
        self.statistics = statistics

    @staticmethod
    def terms(asked: DataFrame, statistics: Statistics) -> DataFrame:
        """Terms with their idf; those that no chunk has weigh as if met nowhere."""
        unseen = idf(F.lit(float(statistics.n)), F.lit(0))
        weights = statistics.weights.select("term", "idf")
        found = weights.join(F.broadcast(asked.select("term").distinct()), "term") if small(asked) else weights
        known = asked.join(found, "term", "left").withColumn("idf", F.coalesce("idf", unseen))
        norms = known.groupBy("query_id").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("q_norm"))
        return known.join(norms, "query_id")

    def impact(self):
        return F.col("top_share") * F.col("idf") * F.col("idf") * self.statistics.growth

    def bound(self, total):
        return total / F.max("q_norm")

    @property
    def scan_metric(self):
        return "tfidf"

    def scanned(self, counts):
        return counts.join(self.statistics.norms.select(*KEY, "norm"), KEY)

    def exact(self, pairs):
        dots = self.hits(pairs).groupBy("query_id", "q_norm", *KEY).agg(F.sum(F.col("tf") * F.col("idf") * F.col("idf")).alias("dot"))
        return dots.join(self.statistics.norms.select(*KEY, "norm"), KEY).select(
            "query_id", *KEY, (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("base")
        )


#: Blocks that are scored first, besides one for each asked row, as the best rows may all lie in different ones.
FIRST_BLOCKS = 8
#: Pairs of a query and a term that any query asks, up to which every chunk is scored in one pass; also the postings of all
#: asked terms, for each core, up to which requests that boost tables are scored in one plan.
DIRECT_HITS = 8_000_000
#: Where the threshold alone leaves fewer blocks than so many times the first ones, no floor is looked for.
WORTH_A_FLOOR = 16


def best_blocks(bounds: DataFrame, depths: DataFrame) -> DataFrame:
    """The most promising blocks of each query, enough for (query_id, depth)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    numbered = bounds.withColumn("nth", F.row_number().over(order)).join(depths, "query_id")
    return numbered.where(F.col("nth") <= FIRST_BLOCKS + F.col("depth")).select("query_id", "block")


def floors(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """(query_id, floor): the score of the last row within the query's depth, less what rounding may add; none where
    rows are fewer."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    ranked = rows.select("query_id", *KEY, "score").withColumn("rank", F.row_number().over(order))
    return ranked.join(depths, "query_id").where("rank = depth").select("query_id", (F.col("score") - ROUNDING).alias("floor"))


def reaching(bounds: DataFrame, floors: DataFrame | None, least: float) -> DataFrame:
    """The (query_id, block) pairs whose bounds reach the threshold and their query's floor."""
    reach = F.col("bound") * SLACK >= least
    if floors is None:
        return bounds.where(reach).select("query_id", "block")
    held = F.broadcast(floors) if floors.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else floors
    found = bounds.where(reach).join(held, "query_id", "left")
    return found.where((F.col("bound") * SLACK) >= F.coalesce("floor", F.lit(least))).select("query_id", "block")
