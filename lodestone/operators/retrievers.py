"""Governed retrieval: filter by lifecycle, score, weigh, threshold, rank.

A request is a batch of queries against an index; an answer is a table of ranked chunks and one row of
diagnostics for each query.  The index is written once: chunks, their postings in blocks with largest
impacts, lengths, and the counts of texts that repeat.  ``pruning`` finds the best rows without scoring all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.config import Settings
from lodestone.functions import text as t
from lodestone.operators import chunking, lifecycle, pruning, retrieval, scan
from lodestone.operators.retrieval import KEY


@dataclass(frozen=True)
class Index:
    """Tables of a corpus; ``vectors`` is (doc_ord, chunk_index, vector) once it has been asked for."""

    path: str
    chunks: DataFrame
    counts: DataFrame
    frequencies: DataFrame
    repeats: DataFrame

    TABLES = ("chunks", "counts", "frequencies", "repeats")

    @classmethod
    def write(cls, chunks: DataFrame, path: str) -> Index:
        """The index of a chunk table, at ``path``."""
        spark = chunks.sparkSession
        if "boilerplate_key" not in chunks.columns:
            chunks = chunks.withColumn("boilerplate_key", t.boilerplate_key("text"))
        held = storage.written(pruning.with_blocks(chunks), f"{path}/chunks")
        n = held.count()
        counts = storage.written(pruning.term_counts(held), f"{path}/counts")
        df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        storage.written(df.withColumn("idf", pruning.idf(F.lit(float(n)), F.col("df"))), f"{path}/frequencies")
        with storage.scratch(spark, "repeats") as work:
            keys = held.select(*KEY, "boilerplate_key")
            repeats = storage.written(chunking.repeated_keys(keys), work)
            storage.written(chunking.repeat_counts(keys, repeats, n), f"{path}/repeats")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(path, *[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES])

    @property
    def lengths(self) -> DataFrame:
        """(keys, norm, distinct_terms) of the chunks that have tokens; written when it is first asked for, as ``postings``
        and ``maxima``: lexical requests that are scored in one pass, and requests under a filter, do without it."""
        return self._made("lengths", lambda path: pruning.lengths(self.counts, self.frequencies, path))

    @property
    def postings(self) -> DataFrame:
        """(block, keys, term, tf), sorted by term."""
        return self._made("postings", lambda path: storage.written(pruning.flat_postings(self.counts, self.chunks.count()), path))

    @property
    def maxima(self) -> DataFrame:
        """The largest impacts of every term in every block."""
        return self._made("maxima", lambda path: storage.written(pruning.maxima(self.counts, self.lengths, self.chunks.count()), path))

    def _made(self, name: str, write: Callable[[str], DataFrame]) -> DataFrame:
        spark, path = self.chunks.sparkSession, f"{self.path}/{name}"
        if not storage.exists(spark, f"{path}/_SUCCESS"):
            write(path)
        return spark.read.parquet(path)

    def counted(self) -> DataFrame:
        """Chunks with their boilerplate counts."""
        return chunking.with_boilerplate(self.chunks, self.repeats, KEY)

    def statistics(self, gone: DataFrame) -> pruning.Statistics:
        """Document frequencies and lengths without the chunks of ``gone`` (keys)."""
        spark = self.chunks.sparkSession
        whole = pruning.Statistics(self.chunks.count(), self.frequencies, None, 1.0)
        found = pruning.statistics(spark, self.path, self.counts, whole, gone)
        return replace(found, norms=self.lengths) if found is whole else found

    def vectors(self, settings: Settings) -> DataFrame:
        spark = self.chunks.sparkSession
        sizes = [settings.vector_char_ngram_min, settings.vector_char_ngram_max] if settings.vector_use_char_ngrams else []
        path = "-".join(map(str, [f"{self.path}/vectors", settings.vector_dimension, *sizes]))
        if not storage.exists(spark, f"{path}/_SUCCESS"):
            texts = storage.spread(self.chunks.select(F.struct(*KEY).alias("key"), "text"))
            made = retrieval.embed(texts, "key", settings).select("key.*", "vector")
            storage.written(made, path)
        return spark.read.parquet(path)


class VectorEmbedder(Protocol):
    """Makes vectors of texts: rows of (key, text) in, rows of (key, vector) out."""

    def embed(self, texts: DataFrame, key: str, settings: Settings) -> DataFrame: ...


class HashingEmbedder:
    def embed(self, texts: DataFrame, key: str, settings: Settings) -> DataFrame:
        return retrieval.embed(texts, key, settings)


@dataclass(frozen=True)
class Request:
    """Queries are (query_id, query); ``now`` is an instant for freshness."""

    queries: DataFrame
    index: Index
    settings: Settings = field(default_factory=Settings)
    thesaurus: dict | None = None
    records: DataFrame | None = None
    now: Column | None = None


@dataclass(frozen=True)
class Response:
    """``ranked``: query_id, rank, keys, score and its components; ``diagnostics``: one row for each query."""

    ranked: DataFrame
    diagnostics: DataFrame


class Retriever(Protocol):
    def retrieve(self, request: Request) -> Response: ...


RECORD = (
    "source_unit_id string, source string, content_fingerprint string, ingestion_iso_ts string, last_upsert_iso_ts string, "
    "deletion_mark_iso_ts string, status string"
)


def candidates(request: Request) -> DataFrame:
    """All chunks with the reason that keeps them out (null for those that stay) and what their factors need.

    Texts come along for table chunks alone.
    """
    chunks = request.index.chunks
    spark = chunks.sparkSession
    tabular = F.col("is_tabular") if "is_tabular" in chunks.columns else F.lit(False)
    header = F.col("tabular_chunk_metadata.header_text") if "tabular_chunk_metadata" in chunks.columns else F.lit(None).cast("string")
    rules = [c for c in request.settings.metadata_weight_rules if c in chunks.columns]
    own = [c for c in ("status", "deletion_mark_iso_ts", "last_upsert_iso_ts", "ingestion_iso_ts") if c in chunks.columns]
    unit = F.col("source_unit_id") if "source_unit_id" in chunks.columns else t.source_unit_id("source")
    rows = chunks.select(
        *KEY,
        "block",
        unit.alias("source_unit_id"),
        *[c for c in rules if c not in own],
        *own,
        F.coalesce(tabular, F.lit(False)).alias("is_tabular"),
        F.when(tabular, header).alias("header_text"),
        F.when(tabular, F.col("text")).alias("table_text"),
    )
    records = request.records if request.records is not None else spark.createDataFrame([], RECORD)
    now = request.now if request.now is not None else F.current_timestamp()
    settings = request.settings
    weights = settings.replace(metadata_weight_rules={k: v for k, v in settings.metadata_weight_rules.items() if k in rules})
    filtered = lifecycle.with_filter_reason(rows, records, settings, now)
    counted = chunking.with_boilerplate(filtered, request.index.repeats, KEY)
    return counted.select(
        *KEY,
        "block",
        "filter_reason",
        "is_tabular",
        "header_text",
        "table_text",
        retrieval.metadata_weight(weights).alias("metadata_weight"),
        retrieval.boilerplate_factor(settings).alias("boilerplate_penalty"),
    )


def asked_terms(request: Request) -> DataFrame:
    """(query_id, query, terms, tabular) of the queries that have any term."""
    found = retrieval.query_terms(request.queries.select("query_id", "query"), request.thesaurus)
    return found.withColumn("tabular", retrieval.tabular_intent("query", request.thesaurus))


def _boosted(settings: Settings, kept: DataFrame, asked: DataFrame) -> bool:
    return settings.table_aware_boost_enabled and not kept.where("is_tabular").isEmpty() and not asked.where("tabular").isEmpty()


def _weighed(scores: DataFrame, kept: DataFrame, asked: DataFrame, settings: Settings, least: float, boosted: bool) -> DataFrame:
    """Scores of kept chunks times their factors, from the threshold on.

    Scores that no factor can lift to the threshold go before the join; table texts meet queries only where a
    table can be boosted at all.
    """
    scores = scores.where(F.col("base") * _largest_factor(settings) >= least)
    rows = scores.join(kept.where("filter_reason is null").drop("filter_reason"), KEY)
    names = ["query_id", *KEY, "base", "metadata_weight", "boilerplate_penalty", "table_boost"]
    plain = F.lit(1.0).alias("table_boost")
    if boosted:
        tables = rows.where("is_tabular").join(asked.select("query_id", "terms", "tabular"), "query_id")
        boosted = tables.withColumn("text", F.col("table_text")).withColumn("table_boost", retrieval.table_boost(settings, F.col("tabular")))
        rows = rows.where("not is_tabular").select(*names[:-1], plain).unionByName(boosted.select(*names))
    else:
        rows = rows.select(*names[:-1], plain)
    final = F.col("base") * F.col("metadata_weight") * F.col("boilerplate_penalty") * F.col("table_boost")
    return retrieval.thresholded(rows, least, final)


def score_components() -> Column:
    """The factors of a ranked row at six places."""
    names = {"base": "base_similarity", "metadata_weight": None, "boilerplate_penalty": None, "table_boost": None, "final": "final_score"}
    return F.struct(*[F.round(F.col(c).cast("double"), 6).alias(n or c) for c, n in names.items()])


def _diagnostics(request: Request, backend: str, asked: DataFrame, kept: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row for each query: counters of the filter, zero without terms; by mode also backend, terms and explanations."""
    totals = lifecycle.filter_diagnostics(kept)
    rows = asked.crossJoin(F.broadcast(totals))  # a single row of totals
    named = [c for c in totals.columns]
    rows = rows.select("query_id", "terms", *[F.when(F.size("terms") > 0, F.col(c)).otherwise(0).alias(c) for c in named])
    mode = str(request.settings.retrieval_diagnostics_mode).strip().lower()
    if mode not in ("summary", "verbose"):
        return rows.drop("terms")
    rows = rows.withColumn("backend", F.lit(backend)).withColumnRenamed("terms", "query_terms")
    if mode == "summary":
        return rows
    top = ranked.where(F.col("rank") <= max(1, int(request.settings.retrieval_diagnostics_top_n)))
    top = top.join(request.index.chunks.select(*KEY, "chunk_id", "source"), KEY)
    said = top.groupBy("query_id").agg(  # a stated number of rows for each query
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source", "score", "score_components"))).alias("final_rank_explanations")
    )
    return rows.join(said, "query_id", "left")


def _largest_boost(settings: Settings) -> float:
    """A bound of the table boost."""
    gains = (settings.table_intent_base_boost, settings.table_header_match_boost, settings.table_row_match_boost)
    return 1 + sum(max(0.0, g) for g in gains) if settings.table_aware_boost_enabled else 1.0


def _largest_factor(settings: Settings) -> float:
    """A bound of the product of all factors of a chunk."""
    out = 1.0
    if settings.metadata_weighting_enabled:
        for weights in settings.metadata_weight_rules.values():
            out *= max([1.0, *[float(w) for w in weights.values() if isinstance(w, (int, float))]])
    return out * _largest_boost(settings)


@dataclass(frozen=True)
class Work:
    """What a request has at hand: its chunks with their factors, its terms, and a folder that is deleted after it."""

    request: Request
    kept: DataFrame
    asked: DataFrame
    folder: str

    @cached_property
    def boosted(self) -> bool:
        """Whether any table can be boosted for any query."""
        return _boosted(self.request.settings, self.kept, self.asked)

    @cached_property
    def scans(self) -> bool:
        """Whether so few terms of so few queries are asked that one pass scores them against all chunks."""
        if self.boosted:
            return False
        terms = self.asked.select("query_id", F.explode("terms").alias("term"))
        asked, queries = terms.agg(F.count_distinct("term"), F.count_distinct("query_id")).first()
        return asked * queries < pruning.DIRECT_HITS

    @cached_property
    def direct(self) -> bool:
        """Whether all asked terms together have so few postings, for the cores there are, that every pair is scored."""
        cores = self.asked.sparkSession.sparkContext.defaultParallelism
        terms = self.asked.select(F.explode("terms").alias("term"))
        hits = self.request.index.frequencies.join(F.broadcast(terms) if retrieval.small(terms) else terms, "term")
        return (hits.agg(F.sum("df")).first()[0] or 0) <= pruning.DIRECT_HITS * cores

    @cached_property
    def rows(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The asked (query_id, asked, term), and the index's postings and largest impacts of those terms."""
        asked = self.asked.select("query_id", F.size("terms").alias("asked"), F.explode("terms").alias("term"))
        if self.scans:
            return asked, lambda: self.request.index.postings, lambda: self.request.index.maxima
        if self.direct:
            return asked, self.request.index.postings, self.request.index.maxima
        terms = self.written(asked.select("term").distinct(), "terms")
        index = self.request.index
        held = [self.written(pruning.of_terms(x, terms), name) for x, name in ((index.postings, "postings"), (index.maxima, "maxima"))]
        return asked, *held

    def weighed(self, scores: DataFrame) -> DataFrame:
        settings = self.request.settings
        return _weighed(scores, self.kept, self.asked, settings, settings.min_retrieval_score, self.boosted)

    def written(self, table: DataFrame, name: str) -> DataFrame:
        return storage.written(table, f"{self.folder}/{name}")

    def bounds(self, scorer: pruning.Scorer, name: str) -> DataFrame:
        """(query_id, block, bound) of final scores."""
        settings = self.request.settings
        factor = F.max(F.col("metadata_weight") * F.col("boilerplate_penalty")).alias("factor")
        factors = self.kept.where("filter_reason is null").groupBy("block").agg(factor, F.max("is_tabular").alias("tables"))
        boost = F.when(F.col("tables"), _largest_boost(settings)).otherwise(1.0)
        found = scorer.bounds().join(factors, "block").withColumn("bound", F.col("bound") * F.col("factor") * boost)
        return self.written(found.select("query_id", "block", "bound"), f"{name}-bounds")

    def factors(self) -> DataFrame:
        """(keys, metadata_weight, boilerplate_penalty) of the chunks that stay."""
        return self.kept.where("filter_reason is null").select(*KEY, *FACTORS)

    def scanned(self, scorer: pruning.Scorer) -> tuple[DataFrame, scan.Asked]:
        """(chunks that stay with their factors and asked terms, the queries) as ``scan`` takes them."""
        asked, counts = scan.Asked.of(scorer.asked, scorer.scan_metric), self.request.index.counts.drop("block")
        if scorer.scan_metric != "jaccard":  # which needs the number of all terms
            counts = scan.narrowed(counts, asked.terms)
        return scorer.scanned(counts.join(self.factors(), KEY)), asked

    def scan(self, scorer: pruning.Scorer, depth: int | None, only: DataFrame | None = None) -> DataFrame:
        """Weighed rows of all chunks, or those of ``only`` (keys): at least the ``depth`` best of each query, all without it."""
        rows, asked = self.scanned(scorer)
        rows = rows if only is None else rows.join(only, KEY, "left_semi")
        found = scan.best_rows(rows, self.asked, asked, self.request.settings.min_retrieval_score, depth, KEY, FACTORS)
        return found.withColumn("table_boost", F.lit(1.0)).select("query_id", *KEY, *PARTS, "score")

    def ranks(self, scorer: pruning.Scorer, missing: DataFrame, name: str) -> DataFrame:
        """The rows of ``missing`` (query_id, keys) that the whole list has, with their rank in it: rows ahead are counted, not kept."""
        keys = ["query_id", *KEY]
        own = self.scan(scorer, None, missing.select(*KEY).distinct()).join(missing, keys, "left_semi")
        own = self.written(own, f"{name}-own")
        rows, asked = self.scanned(scorer)
        ahead = scan.rows_ahead(rows, own, asked, self.request.settings.min_retrieval_score, KEY, FACTORS)
        return own.join(ahead.groupBy(*keys).agg((F.sum("ahead") + 1).alias("rank")), keys)

    def best(self, scorer: pruning.Scorer, depth: int | DataFrame, name: str) -> DataFrame:
        """The ``depth`` best rows of each query, or as many as (query_id, depth) say, with rank and components, exactly."""
        least = self.request.settings.min_retrieval_score
        if self.scans:
            deepest = depth if isinstance(depth, int) else depth.agg(F.max("depth")).first()[0] or 0
            rows = self.scan(scorer, deepest)
            if least <= 0:
                rows = self.written(rows, f"{name}-hits")  # read twice where it is filled up
            rows = self.written(retrieval.ranked(self.filled(rows), deepest), name)
            return rows if isinstance(depth, int) else rows.join(F.broadcast(depth), "query_id").where("rank <= depth").drop("depth")
        depths = self.asked.select("query_id", F.lit(depth).alias("depth")) if isinstance(depth, int) else depth
        if self.direct and isinstance(depth, int):
            return retrieval.ranked(self.filled(self.weighed(scorer.exact(None))), depth)
        bounds = self.bounds(scorer, name)
        first = pruning.best_blocks(bounds, depths)
        pairs = pruning.reaching(bounds, None, least)
        if pairs.count() > pruning.WORTH_A_FLOOR * first.count():
            floors = self.written(pruning.floors(self.weighed(scorer.exact(first)), depths), f"{name}-floors")
            pairs = pruning.reaching(bounds, floors, least)
        pairs = self.written(pairs, f"{name}-pairs")
        top = retrieval.ranked(self.filled(self.weighed(scorer.exact(pairs))), None).join(F.broadcast(depths) if retrieval.small(depths) else depths, "query_id")
        return self.written(top.where("rank <= depth").drop("depth"), name)

    def down_to(self, scorer: pruning.Scorer, floors: DataFrame, name: str) -> DataFrame:
        """All rows from each query's floor on, ranked; queries without a floor have none."""
        bounds = self.request.index.chunks.sparkSession.read.parquet(f"{self.folder}/{name}-bounds")
        own = bounds.join(floors.select("query_id"), "query_id", "left_semi")
        pairs = pruning.reaching(own, floors, self.request.settings.min_retrieval_score)
        rows = self.weighed(scorer.exact(pairs)).join(floors, "query_id").where(F.col("final") >= F.col("floor")).drop("floor")
        return self.written(retrieval.ranked(rows, None), f"{name}-deep")

    def filled(self, rows: DataFrame) -> DataFrame:
        """A threshold of zero or less also admits chunks that share no term, in corpus order behind all hits.

        For the best ``top_k`` the first chunks of the corpus are enough, twice as many: fewer than ``top_k`` of
        them can be hits of a query that needs any.
        """
        if self.request.settings.min_retrieval_score > 0:
            return rows
        stay = self.kept.where("filter_reason is null")
        first = stay.join(self.request.index.counts.where(F.size("terms") > 0).select(*KEY), KEY, "left_semi")
        first = first.select(*KEY, "metadata_weight", "boilerplate_penalty").orderBy(*KEY).limit(2 * self.request.settings.top_k)
        queries = self.asked.where(F.size("terms") > 0).select("query_id")
        zero = {"base": F.lit(0.0), "table_boost": F.lit(1.0), "final": F.lit(0.0), "score": F.lit(0.0)}
        zeros = queries.crossJoin(F.broadcast(first)).withColumns(zero)  # a stated number of rows for each query
        hits = rows.select("query_id", *KEY)
        return rows.unionByName(zeros.join(hits, ["query_id", *KEY], "left_anti").select(rows.columns))


@dataclass(frozen=True)
class _Scored:
    """Shared course of the retrievers: candidates, terms, scores by the backend, rank."""

    def top(self, work: Work) -> DataFrame:
        """The best rows of each query: rank, keys, score and its parts."""
        raise NotImplementedError

    def retrieve(self, request: Request) -> Response:
        spark = request.index.chunks.sparkSession
        found = storage.new_folder(spark, "answers")
        with storage.scratch(spark, "request") as folder:
            kept = storage.written(candidates(request), f"{folder}/kept")
            asked = storage.written(asked_terms(request), f"{folder}/asked")
            rows = self.top(Work(request, kept, asked, folder)).withColumn("score_components", score_components())
            ranked = storage.written(rows.select("query_id", "rank", *KEY, "score", "score_components"), f"{found}/ranked")
            diagnostics = storage.written(_diagnostics(request, self.name, asked, kept, ranked), f"{found}/diagnostics")
        return Response(ranked, diagnostics)


@dataclass(frozen=True)
class LexicalRetriever(_Scored):
    name: str = "lexical"

    def scorer(self, work: Work) -> pruning.Scorer:
        return pruning.Lexical(*work.rows, work.request.settings.lexical_similarity_metric, lambda: work.request.index.lengths)

    def top(self, work):
        return work.best(self.scorer(work), work.request.settings.top_k, self.name)


@dataclass(frozen=True)
class TfidfRetriever(_Scored):
    name: str = "tfidf"

    def scorer(self, work: Work) -> pruning.Scorer:
        statistics = work.request.index.statistics(work.kept.where("filter_reason is not null").select(*KEY))
        asked, *rows = work.rows
        terms = pruning.Tfidf.terms(asked, statistics)
        terms = terms if work.scans or work.direct else work.written(terms, f"{self.name}-terms")
        return pruning.Tfidf(terms, *rows, statistics)

    def top(self, work):
        return work.best(self.scorer(work), work.request.settings.top_k, self.name)


@dataclass(frozen=True)
class HybridRrfRetriever(_Scored):
    """Reciprocal ranks of the whole lexical and tf-idf lists; components are those of the first list with the row.

    The lists are never made whole.  Both are read to a depth at which a row that neither shows cannot be
    among the best any more, even if it came next in both.  A row that one of them shows gets between nothing and one more
    rank of the other list; only if that decides, the other list is read down to the row's own score, which
    gives its rank.
    """

    name: str = "hybrid_rrf"

    def top(self, work):
        settings = work.request.settings
        k, offset = settings.top_k, max(1, settings.hybrid_rrf_k)
        depth = 2 * (offset + 2 * k)
        direct = not work.scans and work.direct
        if direct or 2 / (offset + depth + 1) + 1e-6 >= 1 / (offset + k):  # or ranks too many for six places
            depth = 1 << 30
        backends = LexicalRetriever(), TfidfRetriever()
        scorers = [b.scorer(work) for b in backends]
        if direct:
            rows = _side_by_side(*[work.best(s, depth, b.name) for s, b in zip(scorers, backends)])
            return self._fused(rows, offset, k)
        second = work.best(scorers[1], depth, backends[1].name)
        # Beside a list that is whole, rows of the other alone are decided by its own best k.
        deep = second.groupBy("query_id").count().where(F.col("count") >= depth).select("query_id", F.lit(depth).alias("depth"))
        depths = work.asked.select("query_id").join(deep, "query_id", "left").fillna(k, ["depth"])
        depths = work.written(depths.withColumnRenamed("depth", "a_depth").withColumn("b_depth", F.lit(depth)), "depths")
        first = work.best(scorers[0], depths.select("query_id", F.col("a_depth").alias("depth")), backends[0].name)
        both = work.written(_side_by_side(first, second).join(depths, "query_id"), "both")
        share = lambda c: F.coalesce(1 / (F.lit(offset) + F.col(c)), F.lit(0.0))
        open_ = lambda c: F.col(f"{c}_rank").isNull() & (F.col(f"{c}_rows") >= F.col(f"{c}_depth"))
        more = lambda c: F.when(open_(c), 1 / (offset + 1 + F.col(f"{c}_depth"))).otherwise(0.0)
        known = both.withColumns({"low": share("a_rank") + share("b_rank"), "a_open": open_("a"), "b_open": open_("b")})
        known = known.withColumn("high", F.col("low") + more("a") + more("b"))
        order = Window.partitionBy("query_id").orderBy(F.desc("low"), *KEY)
        kth = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query_id", F.col("low").alias("bar"))
        viable = known.join(kth, "query_id", "left").where(F.col("high") >= F.coalesce("bar", F.lit(0.0)) - 1e-6)
        viable = work.written(viable.drop("bar"), "viable")
        for c, scorer, backend in zip("ab", scorers, backends):
            viable = self._deeper(work, viable, c, scorer, backend.name)
        return self._fused(viable, offset, k)

    @staticmethod
    def _fused(rows: DataFrame, offset: int, k: int) -> DataFrame:
        """The ``k`` best rows by the sum of their reciprocal ranks."""
        share = lambda c: F.coalesce(1 / (F.lit(offset) + F.col(c)), F.lit(0.0))
        fused = rows.withColumn("score", F.round(share("a_rank") + share("b_rank"), 6)).withColumn("p", F.coalesce("a", "b"))
        return retrieval.ranked(fused.select("query_id", *KEY, "score", "p.*"), k)

    @staticmethod
    def _deeper(work: Work, viable: DataFrame, c: str, scorer: pruning.Scorer, name: str) -> DataFrame:
        """``viable`` with the ranks that list ``c`` does not show and that may decide."""
        keys = ["query_id", *KEY]
        missing = viable.where(f"{c}_open").select(*keys)
        if missing.isEmpty():
            return viable
        if work.scans:
            # Written, as the other list's turn starts from it several times.
            deep = work.written(work.ranks(scorer, missing, name), f"{name}-ranks")
            return _with_ranks(viable, deep, missing, c)
        places = work.kept.select(*KEY, "block")
        pairs = missing.join(places, KEY).select("query_id", "block").distinct()
        own = work.weighed(scorer.exact(pairs)).join(missing, keys, "left_semi")
        floors = own.groupBy("query_id").agg((F.min("score") - pruning.ROUNDING).alias("floor"))
        deep = work.down_to(scorer, work.written(floors, f"{name}-down"), name)
        return _with_ranks(viable, deep, missing, c)


FACTORS = ["metadata_weight", "boilerplate_penalty"]
PARTS = ["base", *FACTORS, "table_boost", "final"]


def _with_ranks(viable: DataFrame, deep: DataFrame, missing: DataFrame, c: str) -> DataFrame:
    """``viable`` with the ranks and parts of list ``c`` that ``deep`` has of its ``missing`` rows."""
    keys = ["query_id", *KEY]
    found = deep.join(missing, keys, "left_semi").select(*keys, F.col("rank").alias("r"), F.struct(*PARTS).alias("s"))
    return viable.join(found, keys, "left").withColumns({f"{c}_rank": F.coalesce(f"{c}_rank", "r"), c: F.coalesce(c, "s")}).drop("r", "s")


def _side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, keys, a_rank, a, a_rows, b_rank, b, b_rows): two lists joined once, with how many rows each has."""
    sides = []
    for c, rows in zip("ab", (first, second)):
        sides.append(rows.select("query_id", *KEY, F.col("rank").alias(f"{c}_rank"), F.struct(*PARTS).alias(c)))
        sides.append(rows.groupBy("query_id").agg(F.count("*").alias(f"{c}_rows")))
    a, a_rows, b, b_rows = sides
    found = a.join(b, ["query_id", *KEY], "full_outer").join(a_rows, "query_id", "left").join(b_rows, "query_id", "left")
    return found.fillna(0, ["a_rows", "b_rows"])


@dataclass(frozen=True)
class VectorRetriever(_Scored):
    """Nearest vectors.  A query without any ASCII token is embedded as it stands, so it is answered too."""

    embedder: VectorEmbedder = field(default_factory=HashingEmbedder)
    name: str = "vector"

    def top(self, work):
        request, asked, kept = work.request, work.asked, work.kept
        settings = request.settings
        said = F.when(F.size("terms") > 0, F.array_join(F.array_sort("terms"), " ")).otherwise(F.col("query"))
        texts = asked.select("query_id", said.alias("text")).where(t.strip("text") != "")
        queries = self.embedder.embed(texts, "query_id", settings).withColumnRenamed("vector", "query_vector")
        if isinstance(self.embedder, HashingEmbedder):
            vectors = request.index.vectors(settings)
        else:
            keyed = request.index.chunks.select(F.struct(*KEY).alias("key"), "text")
            vectors = self.embedder.embed(keyed, "key", settings).select("key.*", "vector")
        stay = kept.where("filter_reason is null").select(*KEY)
        if not work.boosted:
            held = vectors.join(work.factors(), KEY)
            found = retrieval.vector_scores(
                queries, held, settings.vector_similarity_metric, settings.min_retrieval_score, settings.top_k, tuple(FACTORS)
            )
            return retrieval.ranked(found.withColumn("table_boost", F.lit(1.0)), settings.top_k)
        # What cannot reach the threshold by any factor is not needed.
        least = settings.min_retrieval_score / max(1.0, _largest_factor(settings))
        scores = retrieval.vector_scores(queries, vectors.join(stay, KEY, "left_semi"), settings.vector_similarity_metric, least)
        return retrieval.ranked(work.weighed(scores), settings.top_k)


BACKENDS: dict[str, type] = {
    "lexical": LexicalRetriever,
    "tfidf": TfidfRetriever,
    "hybrid": HybridRrfRetriever,
    "hybrid_rrf": HybridRrfRetriever,
    "vector": VectorRetriever,
}


def retrieve(request: Request, retriever: Retriever | None = None) -> Response:
    """Ask ``retriever``, or the one that the settings name; an unknown name is the lexical one."""
    if retriever is None:
        retriever = BACKENDS.get(str(request.settings.retrieval_backend).strip().lower(), LexicalRetriever)()
    return retriever.retrieve(request)


def evidence(response: Response, index: Index) -> DataFrame:
    """Ranked rows with their chunks.  Counts meet the ranked rows alone, so no other chunk's text is moved for its count."""
    return chunking.with_boilerplate(response.ranked.join(index.chunks, KEY), index.repeats, KEY)
