"""Batch retrieval: all queries meet all chunks through an inverted index.

Queries are (query_id, query); their terms are expanded, exploded and joined with chunk tokens, so a
chunk is read once however many queries there are.  The query side is broadcast by Spark only while
its size is below the session's threshold.  Scores are kept with keys alone; texts are joined back after the
top rows are known.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone import storage
from lodestone.config import Settings
from lodestone.functions import text as t
from lodestone.operators import scan

KEY = ["doc_ord", "chunk_index"]


def expand_terms(query: str, thesaurus: dict | None = None) -> list[str]:
    """Tokens of a query and of their synonyms; then, entry by entry, the canonical terms of synonyms present.

    The order of entries matters, as a canonical term that was added can bring in a later one.
    """
    cut = _tokens
    found = set(cut(query))
    entries = {k.lower(): list(v) for k, v in ((thesaurus or {}).get("terms") or {}).items()}
    for token in cut(query):
        for synonym in entries.get(token, []):
            found.update(cut(synonym))
    for canonical, synonyms in entries.items():
        if any(parts and parts[0] in found for parts in map(cut, synonyms)):
            found.update(cut(canonical))
    return sorted(found)


def _tokens(text: str) -> list[str]:
    import re

    return [x.lower() for x in re.findall(t.TOKEN, str(text))]


def query_terms(queries: DataFrame, thesaurus: dict | None = None) -> DataFrame:
    """(query_id, query, terms): distinct expanded terms of every query."""
    plain = F.array_sort(F.array_distinct(t.tokens("query")))
    if not (thesaurus or {}).get("terms"):
        return queries.withColumn("terms", plain)
    expand = _expander(thesaurus)
    return queries.withColumn("terms", expand("query"))  # a fold in the order of entries, over the few queries


def _expander(thesaurus: dict):
    """Expansion is a fold over the entries in order, so it runs in Python, once for each distinct query of a batch."""

    @F.pandas_udf("array<string>")
    def expand(queries: pd.Series) -> pd.Series:
        found = {q: expand_terms(q or "", thesaurus) for q in queries.unique()}
        return queries.map(found.get)

    return expand


def tabular_intent(query: Column | str, thesaurus: dict | None) -> Column:
    """Whether a query token is a term of the intent group ``tabular``."""
    group = ((thesaurus or {}).get("intent_groups") or {}).get("tabular") or []
    terms = sorted({x for value in group for x in _tokens(value)})
    return F.arrays_overlap(t.tokens(query), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def postings(chunks: DataFrame) -> DataFrame:
    """(doc_ord, chunk_index, term, tf) of all tokens."""
    return chunks.select(*KEY, F.explode(t.tokens("text")).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))


def lexical_scores(queries: DataFrame, index: DataFrame, metric: str = "overlap") -> DataFrame:
    """(query_id, doc_ord, chunk_index, base): ``overlap`` counts occurrences per query term, ``containment`` is
    the share of query terms present, ``jaccard`` that of all terms of both."""
    asked = queries.select("query_id", F.size("terms").alias("asked"), F.explode("terms").alias("term"))
    hits = index.join(F.broadcast(asked) if small(asked) else asked, "term")
    grouped = hits.groupBy("query_id", "asked", *KEY).agg(F.sum("tf").alias("occurrences"), F.count("*").alias("shared"))
    if metric == "jaccard":
        sizes = index.groupBy(*KEY).agg(F.count("*").alias("distinct_terms"))
        grouped = grouped.join(sizes, KEY)
        base = F.col("shared") / (F.col("asked") + F.col("distinct_terms") - F.col("shared"))
    elif metric == "containment":
        base = F.col("shared") / F.col("asked")
    else:
        base = F.col("occurrences") / F.col("asked")
    return grouped.select("query_id", *KEY, base.alias("base"))


#: Terms of all queries that a broadcast may hold.
BROADCAST_TERMS = 1_000_000


def small(asked: DataFrame) -> bool:
    """Counted, not assumed: at most ``BROADCAST_TERMS`` rows, else a shuffle join is left to Spark."""
    return asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def frequent(weights: DataFrame) -> int:
    """The least power of two such that at most ``BROADCAST_TERMS`` terms of ``weights`` (term, df) are in so many chunks or more."""
    bits, held = F.length(F.bin("df")), 0
    for n, terms in sorted(map(tuple, weights.groupBy(bits).count().collect()), reverse=True):  # at most 63 rows
        if (held := held + terms) > BROADCAST_TERMS:
            return 1 << n
    return 1


def with_idf(index: DataFrame, weights: DataFrame) -> DataFrame:
    """Postings with the ``idf`` of their term, from ``weights`` (term, df, idf).

    A vocabulary that is counted to be small is broadcast.  Else its most frequent terms are, as many as a broadcast may hold.
    Nearly all postings are theirs and stay where they are; the others, of terms of few chunks each, are moved.
    """
    if small(weights):
        return index.join(F.broadcast(weights.select("term", "idf")), "term").select(*index.columns, "idf")
    least = frequent(weights)
    often = F.broadcast(weights.where(F.col("df") >= least).select("term", "idf"))
    seldom = weights.where(F.col("df") < least).select("term", "idf")
    known = index.join(often, "term").select(*index.columns, "idf")
    rest = index.join(often, "term", "left_anti").join(seldom, "term", "left")
    return known.unionByName(rest.select(*index.columns, "idf"))


def tfidf_scores(queries: DataFrame, index: DataFrame, candidates: int) -> DataFrame:
    """(query_id, doc_ord, chunk_index, base): cosine of idf-weighted queries and tf-idf chunks.

    Document frequencies are those of ``index``, the candidates left by the lifecycle filter; ``candidates``
    counts chunks without tokens too.  All postings enter the norms; dots need those of asked terms alone.
    """
    n = F.lit(float(candidates))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)
    norms = with_idf(index, weights).groupBy(*KEY).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    terms = queries.select("query_id", F.explode("terms").alias("term"))
    unseen = F.log(n + 1) + 1
    asked = terms.join(weights, "term", "left").select("query_id", "term", F.coalesce("idf", unseen).alias("idf"))
    lengths = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("q_norm"))
    dots = index.join(F.broadcast(asked) if small(terms) else asked, "term").groupBy("query_id", *KEY).agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("idf")).alias("dot")
    )
    return (
        dots.join(norms, KEY)
        .join(lengths, "query_id")
        .select("query_id", *KEY, (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("base"))
    )


#: Queries and vectors that a task multiplies at a time, and products that make one task.
QUERY_BLOCK, VECTOR_BLOCK, TASK_PRODUCTS = 1024, 4096, 1 << 28
#: Bytes of a table that Spark reads in one part.
PART_BYTES = 128 << 20


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows padded with zeros to one width, their own widths) of a column of number arrays."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) and (widths == widths[0]).all():
        return values.reshape(len(widths), -1), widths
    out = np.zeros((len(widths), int(widths.max(initial=0))))
    out[np.repeat(np.arange(len(widths)), widths), np.arange(len(values)) - np.repeat(np.cumsum(widths) - widths, widths)] = values
    return out, widths


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one shorter, however many came at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= size:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            full = whole.num_rows // size * size
            yield from (whole.slice(at, size) for at in range(0, full, size))
            held = [whole.slice(full)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def parquet_files(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    """The files of a written table, and where they are."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    return fs, [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".parquet")]


def parquet_table(path: str) -> pa.Table:
    """A written table that a task holds whole."""
    fs, files = parquet_files(path)
    found = []
    for file in files:
        with fs.open_input_file(file) as source:
            found.append(pyarrow.parquet.ParquetFile(source).read())
    return pa.concat_tables(found)


def _products(path: str, metric: str, least: float, depth: int | None, keys: list[str], factors: list[str], out: pa.Schema):
    def similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        found = a @ b.T
        if metric in ("euclidean", "l2"):
            squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * found
            found = 1 / (1 + np.sqrt(np.maximum(squares, 0)))
        return found

    def askedblocks(fs, files: list[str]) -> Iterator[pa.RecordBatch]:
        for file in files:
            with fs.open_input_file(file) as source:
                yield from pyarrow.parquet.ParquetFile(source).iter_batches(QUERY_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        fs, files = parquet_files(path)
        for batch in blocks(batches, VECTOR_BLOCK):
            if batch.num_rows:
                if depth is not None:
                    batch = batch.take(pa.array(np.lexsort([batch.column(k).to_numpy() for k in reversed(keys)])))
                vectors, widths = _matrix(batch.column("vector"))
                weight = [batch.column(f).to_numpy()[None, :] for f in factors]
                for n, asked in enumerate(askedblocks(fs, files)):
                    queries, query_widths = _matrix(asked.column("query_vector"))
                    found = similarities(queries, vectors)
                    found[query_widths[:, None] != widths[None, :]] = 0.0
                    final = found
                    for w in weight:
                        final = final * w
                    if depth is None:
                        i, j = np.nonzero(found >= least)
                    else:
                        score = np.where(final >= least, scan.rounded(final), -np.inf)
                        i, j = scan.best(score, depth, floors.setdefault(n, np.full(len(score), -np.inf)))
                    if len(i):
                        picked, rows = pa.array(i), pa.array(j)
                        held = [batch.column(c).take(rows) for c in (*keys, *factors)]
                        numbers = [found[i, j]] if depth is None else [found[i, j], final[i, j], score[i, j] / scan.PLACES]
                        arrays = [asked.column("query_id").take(picked), *held, *map(pa.array, numbers)]
                        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, out)], schema=out)

    return run


def vector_scores(
    queries: DataFrame, vectors: DataFrame, metric: str = "cosine", least: float = 0.0, depth: int | None = None, factors: tuple[str, ...] = ()
) -> DataFrame:
    """(query_id, keys of vectors, base) of the pairs from ``least`` on: the stated queries (query_id, query_vector)
    against all vectors; vectors of different lengths score zero.

    With a ``depth``, (query_id, keys, factors, base, final, score): final is the base times the ``factors``, columns of
    ``vectors``, and of each query at least its ``depth`` best rows by score, then keys, come that reach ``least``.

    Queries are written once, and every task multiplies its vectors with them block by block: none is
    broadcast, no pair below ``least`` or beyond the ``depth`` leaves its task, and the work is cut by products, not by rows,
    unless the vectors come in as many parts by their size: then they are not moved.
    """
    spark = vectors.sparkSession
    keys = [c for c in vectors.columns if c not in ("vector", *factors)]
    as_numbers = lambda c: F.col(c).cast("array<double>").alias(c)
    path = storage.new_folder(spark, "query-vectors")
    held = storage.written(queries.where("query_vector is not null").select("query_id", as_numbers("query_vector")), path)
    rows = vectors.where("vector is not null").select(*keys, *factors, as_numbers("vector"))
    tasks = min(100_000, -(-held.count() * vectors.count() // TASK_PRODUCTS))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if tasks > max(1, size // PART_BYTES):
        rows = rows.repartition(tasks)
    numbers = [T.StructField(c, T.DoubleType()) for c in (("base",) if depth is None else ("base", "final", "score"))]
    out = T.StructType([held.schema["query_id"], *[rows.schema[k] for k in (*keys, *factors)], *numbers])
    return rows.mapInArrow(_products(path, metric, least, depth, keys, list(factors), to_arrow_schema(out)), out)


def hashed_features(texts: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """(key, idx, weight): hashed words at 1.0 and character n-grams at 0.35, not yet normalised."""
    dim = max(16, settings.vector_dimension)
    body = texts.select(key, F.lower(t.strip("text")).alias("body"))
    word = body.select(key, F.explode(t.words("body")).alias("w")).select(
        key, F.concat(F.lit("tok:"), F.col("w")).alias("f"), F.lit(1.0).alias("w")
    )
    features = word
    if settings.vector_use_char_ngrams:
        sizes = F.array(*map(F.lit, range(settings.vector_char_ngram_min, settings.vector_char_ngram_max + 1)))
        joined = body.select(key, F.regexp_replace("body", " ", "_").alias("joined"), F.explode(sizes).alias("n"))
        # Exploded places, not a lambda over them: a lambda would clean the text again for every n-gram.
        grams = joined.where(F.length("joined") >= F.col("n")).select(
            key, "joined", "n", F.explode(F.sequence(F.lit(1), F.length("joined") - F.col("n") + 1)).alias("i")
        )
        gram = F.concat(F.lit("ch"), F.col("n"), F.lit(":"), F.col("joined").substr(F.col("i"), F.col("n")))
        features = word.unionByName(grams.select(key, gram.alias("f"), F.lit(0.35).alias("w")))
    # A feature is hashed once for each text it occurs in.
    summed = features.groupBy(key, "f").agg(F.sum("w").alias("w"))
    return summed.groupBy(key, t.hash_index("f", dim).alias("idx")).agg(F.sum("w").alias("weight"))


#: Buckets of features that a worker remembers, texts that it counts at a time, and bits of a character's number.
KNOWN_FEATURES, TEXT_SLICE, LETTER_BITS = 1_000_000, 256, 12


class FeatureBuckets:
    """Buckets of words and n-grams, looked up by arrays of n-grams; a feature is hashed once while it is remembered.

    An n-gram is one number, made of the numbers that its characters got as they were met, and lies in an open table at the
    first free place from that of its hash on.
    """

    #: The longest n-gram that a number holds; its length takes the bits above.
    LONGEST = 60 // LETTER_BITS

    def __init__(self, dim: int):
        self.dim, self.words = dim, {}
        self.bits = (2 * KNOWN_FEATURES).bit_length()
        self.clear()

    def clear(self) -> None:
        self.letters, self.met = np.zeros(0x110000, np.uint16), 0
        self.keys, self.buckets, self.held = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def bucket(self, feature: str) -> int:
        return int.from_bytes(hashlib.sha1(feature.encode()).digest()[:8]) % self.dim

    def of_words(self, words: list[str]) -> list[int]:
        if len(self.words) > KNOWN_FEATURES:
            self.words.clear()
        known = self.words
        for w in set(words) - known.keys():
            known[w] = self.bucket(f"tok:{w}")
        return [known[w] for w in words]

    def numbers(self, codes: np.ndarray) -> np.ndarray | None:
        """Numbers of characters from 1, none if the texts have more than there are numbers."""
        for _ in range(2):
            new = np.flatnonzero(np.bincount(codes[self.letters[codes] == 0]))
            if self.met + len(new) < 1 << LETTER_BITS:
                self.letters[new] = self.met + 1 + np.arange(len(new))
                self.met += len(new)
                return self.letters[codes].astype(np.uint64)
            self.clear()
        return None

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_grams(self, keys: np.ndarray, at: np.ndarray, n: int, text: str) -> np.ndarray:
        """Buckets of the n-grams ``keys``, which stand ``at`` their places of ``text``."""
        place, open_ = self._places(keys), np.arange(len(keys))
        while len(open_):
            found = self.keys[place[open_]]
            open_ = open_[(found != keys[open_]) & (found != 0)]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        out = self.buckets[place]
        missing = np.flatnonzero(self.keys[place] == 0)
        if len(missing):
            new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            starts = at[missing[first]].tolist()
            buckets = np.array([self.bucket(f"ch{n}:{text[i : i + n]}") for i in starts], np.int32)
            out[missing] = buckets[which]
            if self.held + len(new) <= KNOWN_FEATURES:
                self._hold(new, buckets)
            elif len(new) <= KNOWN_FEATURES:
                self.keys[:], self.held = 0, 0
                self._hold(new, buckets)
        return out

    def _hold(self, keys: np.ndarray, buckets: np.ndarray) -> None:
        place, open_ = self._places(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[place[open_]] == 0]
            self.keys[place[free]] = keys[free]  # of several at one place one stays
            open_ = open_[self.keys[place[open_]] != keys[open_]]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        self.buckets[place] = buckets
        self.held += len(keys)


@functools.cache
def feature_buckets(dim: int) -> FeatureBuckets:
    """One for each worker and dimension."""
    return FeatureBuckets(dim)


def feature_weights(bodies: list[str], dim: int, sizes: range | tuple) -> np.ndarray:
    """Texts by buckets: words at 1.0 and n-grams of ``sizes`` at 0.35, not yet normalised."""
    known, total = feature_buckets(dim), len(bodies) * dim
    sums = lambda owners, buckets: np.bincount(owners * dim + buckets, minlength=total)[:total].reshape(-1, dim)
    cut = [body.split() for body in bodies]
    owners = np.repeat(np.arange(len(bodies)), [len(x) for x in cut])
    out = sums(owners, np.array(known.of_words([w for x in cut for w in x]), np.int64)).astype(float)
    joined = [body.replace(" ", "_") for body in bodies]
    text, lengths = "".join(joined), np.array([len(x) for x in joined], np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owners = np.repeat(np.arange(len(bodies)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    letters = known.numbers(codes) if max(sizes, default=0) <= known.LONGEST else None
    grams, keys = np.zeros_like(out, np.int64), letters
    for n in range(1, max(sizes, default=0) + 1):
        if n > 1 and keys is not None:
            keys = (keys[: max(0, len(codes) - n + 1)] << np.uint64(LETTER_BITS)) | letters[n - 1 :]
        if n not in sizes:
            continue
        at = np.flatnonzero(left >= n)
        if keys is not None:
            buckets = known.of_grams(keys[at] | np.uint64(n << 60), at, n, text)
        else:
            buckets = np.array([known.bucket(f"ch{n}:{text[i : i + n]}") for i in at.tolist()], np.int64)
        grams += sums(owners[at], buckets)
    return out + 0.35 * grams


def embed(texts: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """(key, vector): unit vectors of hashed features, as ``hashed_features`` has them; texts without features get zeros.

    A text has thousands of features and most are shared, so they are counted and looked up in Python batches, as
    arrays, rather than sent through a shuffle each.
    """
    dim = max(16, settings.vector_dimension)
    sizes = range(settings.vector_char_ngram_min, settings.vector_char_ngram_max + 1) if settings.vector_use_char_ngrams else ()

    @F.arrow_udf("array<double>")
    def vectors(bodies: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(bodies), TEXT_SLICE):
            found = feature_weights(bodies.slice(at, TEXT_SLICE).to_pylist(), dim, sizes)
            norm = np.sqrt((found * found).sum(1, keepdims=True))
            out.append(found / np.where(norm > 0, norm, 1))
        values = np.concatenate(out).ravel() if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bodies) + 1) * dim, pa.int32()), pa.array(values))

    return texts.select(key, vectors(F.coalesce(F.lower(t.strip("text")), F.lit(""))).alias("vector"))


def metadata_weight(settings: Settings) -> Column:
    """Product of the weights of a chunk's values; 1 where there is no rule."""
    out = F.lit(1.0)
    if settings.metadata_weighting_enabled:
        for name, weights in settings.metadata_weight_rules.items():
            rules = [x for k, v in weights.items() if isinstance(v, (int, float)) and v > 0 for x in (F.lit(str(k)), F.lit(float(v)))]
            if rules:
                value = F.coalesce(F.lower(t.strip(F.col(name).cast("string"))), F.lit("__missing__"))
                out = out * F.coalesce(F.try_element_at(F.create_map(*rules), value), F.lit(1.0))
    return out


def boilerplate_factor(settings: Settings, count: str = "repeat_count") -> Column:
    """Chunks that recur n times are damped by 1 / (1 + strength (n - 1)), not below a floor."""
    if not settings.boilerplate_penalty_enabled:
        return F.lit(1.0)
    strength = max(0.0, settings.boilerplate_penalty_strength)
    floor = max(0.05, min(1.0, settings.boilerplate_penalty_min_factor))
    return F.when(F.col(count) <= 1, 1.0).otherwise(F.greatest(F.lit(floor), 1 / (1 + strength * (F.col(count) - 1))))


def table_boost(settings: Settings, intent: Column, terms: str = "terms", header: str = "header_text") -> Column:
    """Table chunks gain for tabular queries: a base, more for a header that shares a term, more for a row."""
    if not settings.table_aware_boost_enabled:
        return F.lit(1.0)
    head = F.coalesce(F.col(header), F.lit(""))
    rows = F.when(head != "", F.slice(t.lines("text"), 2, 1 << 30)).otherwise(t.lines("text"))
    shares = lambda x: F.arrays_overlap(t.tokens(x), F.col(terms))
    gain = (
        1.0
        + max(0.0, settings.table_intent_base_boost)
        + F.when(shares(head), max(0.0, settings.table_header_match_boost)).otherwise(0.0)
        + F.when(F.exists(rows, shares), max(0.0, settings.table_row_match_boost)).otherwise(0.0)
    )
    return F.when(intent & F.col("is_tabular"), gain).otherwise(1.0)


def ranked(scores: DataFrame, k: int | None, score: str = "score", ties: list[str] | None = None) -> DataFrame:
    """Rows by rounded score, ties in corpus order; the first k of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *(ties or KEY))
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def thresholded(scores: DataFrame, least: float, value: Column | None = None) -> DataFrame:
    """Scores that reach the threshold before rounding to four places."""
    value = F.col("base") if value is None else value
    return scores.withColumn("final", value).where(F.col("final") >= least).withColumn("score", F.round("final", 4))


def rrf(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two complete rankings: (query_id, keys, score) at six places."""
    keys = ["query_id", *KEY]
    a, b = (r.select(*keys, (1 / (F.lit(max(1, k)) + F.col("rank"))).alias(n)) for r, n in ((first, "a"), (second, "b")))
    return a.join(b, keys, "full_outer").select(
        *keys, F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 6).alias("score")
    )


#: Pairs of a query and a word that any query asks, up to which the ranker scores every chunk in one pass.
SCANNED = 8_000_000


def rank_by_counts(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The plain ranker: occurrences of the distinct blank-separated words of the query, no threshold or governance.

    A query with fewer than ``k`` hits is filled up with chunks that score zero, in corpus order; for that
    the first ``k`` chunks and those behind its hits are enough, so nothing is crossed with the corpus.
    """
    words = F.array_distinct(t.words(F.lower("query")))
    asked = queries.select("query_id", F.size(words).alias("asked"), F.explode(words).alias("term"))
    terms, ids = asked.agg(F.count_distinct("term"), F.count_distinct("query_id")).first()
    if terms * ids <= SCANNED:
        held = chunks.select(*KEY, t.words(F.lower("text")).alias("terms"))
        hits = scan.best_rows(held, queries, scan.Asked.of(asked, "count"), 0.0, k, KEY, [])
        hits = hits.select("query_id", *KEY, F.col("final").cast("long").alias("score"))
    else:
        held = chunks.select(*KEY, F.explode(t.words(F.lower("text"))).alias("term")).groupBy(*KEY, "term").count()
        hits = held.join(asked, "term").groupBy("query_id", *KEY).agg(F.sum("count").alias("score"))
    # Written, as it is read twice below.
    best = storage.written(ranked(hits, k).drop("rank"), storage.new_folder(chunks.sparkSession, "ranker"))
    # Of the first 2k chunks fewer than k can be hits of a query that needs filling up.
    first = chunks.select(*KEY).orderBy(*KEY).limit(2 * k)
    zeros = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0).cast("long"))
    rest = zeros.join(best.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    return ranked(best.unionByName(rest.select(*best.columns)), k)
