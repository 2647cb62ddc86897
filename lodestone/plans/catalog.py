"""Names, plans and oracle SQL of every registered evidence query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import service, storage
from lodestone.functions import text as t
from lodestone.operators import answers, builder, chunking, evaluation, lifecycle, provenance, retrieval, retrievers
from lodestone.plans import inputs
from lodestone.sources import parsers
from lodestone.streaming import audit

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "tfidf_topk"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda x: lower(x))"
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_COLLAPSE = _STRIP.format(r"regexp_replace({0}, '\s+', ' ', 'g')")
_DOCS = rf"""
d AS (SELECT doc_id AS doc_ord, 'data/' || source || '/' || doc_id || '.txt' AS source,
  {_STRIP.format("coalesce(text, '')")} AS text FROM documents),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_ord) AS rn FROM d WHERE text <> '')
  WHERE rn = 1)"""
def _windows_sql(size: int, step: int, least: int) -> str:
    """CTEs up to ``chunks``: windows of all documents."""
    return rf"""{_DOCS},
w AS (SELECT doc_ord, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM k),
n AS (SELECT *, len(ws) AS n, CAST(ceil(len(ws) / {step}.0) AS BIGINT) AS cnt FROM w),
h AS (SELECT *, least(cnt, greatest(1, CAST(floor((n - {least}) / {step}.0) AS BIGINT) + 1)) AS heads FROM n),
x AS (SELECT *, unnest(range(heads)) AS win FROM h),
c AS (SELECT doc_ord, source, win, win * {step} + 1 AS start_word,
  CASE WHEN win = heads - 1 THEN n ELSE least(n, win * {step} + {size}) END AS end_word,
  CASE WHEN win = heads - 1 THEN flatten(list_transform(range(win, cnt), lambda j: ws[j * {step} + 1 : j * {step} + {size}]))
    ELSE ws[win * {step} + 1 : win * {step} + {size}] END AS body FROM x),
chunks AS (SELECT doc_ord, source, win AS chunk_index, regexp_extract(source, '[^/]*$') || ':' || win AS chunk_id,
  array_to_string(body, ' ') AS text, start_word, end_word, len(body) AS word_count FROM c)"""


_CHUNKS = _windows_sql(120, 100, 40)
_INDEX = rf"""{_CHUNKS},
tok AS (SELECT doc_ord, chunk_index, unnest({_TOKENS.format("text")}) AS term FROM chunks),
post AS (SELECT doc_ord, chunk_index, term, count(*) AS tf FROM tok GROUP BY ALL),
q AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("text")}) AS terms FROM benchmark),
qt AS (SELECT query_id, len(terms) AS asked, unnest(terms) AS term FROM q)"""
_RANK = """row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, chunk_index) AS rank"""


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            storage.steady(spark)
            found = f(spark, sf_dir)
            return found.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in found.dtypes])

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


# --- text, documents, chunks -------------------------------------------------------------------


@query(
    "tokenize_counts",
    f"""WITH x AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS ts FROM documents)
    SELECT doc_id, len(ts) AS tokens, len(list_distinct(ts)) AS distinct_tokens FROM x""",
)
def tokenize_counts(spark, sf_dir):
    found = t.tokens("text")
    return inputs.documents(spark, sf_dir).select(
        F.col("doc_ord").alias("doc_id"), F.size(found).alias("tokens"), F.size(F.array_distinct(found)).alias("distinct_tokens")
    )


@query("fingerprint_dedupe", f"WITH {_DOCS} SELECT doc_ord, source, sha1(text) AS content_fingerprint FROM k")
def fingerprint_dedupe(spark, sf_dir):
    return chunking.first_by_content(inputs.documents(spark, sf_dir)).select("doc_ord", "source", "content_fingerprint")


@query(
    "prose_windows",
    f"""WITH {_CHUNKS} SELECT doc_ord, chunk_index, chunk_id, start_word, end_word, word_count, sha1(text) AS fingerprint
    FROM chunks""",
)
def prose_windows(spark, sf_dir):
    return inputs.chunks(spark, sf_dir).select(
        "doc_ord", "chunk_index", "chunk_id", "start_word", "end_word", "word_count", t.fingerprint("text").alias("fingerprint")
    )


@query(
    "prose_windows_tail_merge",
    f"""WITH {_windows_sql(50, 40, 30)} SELECT doc_ord, chunk_index, start_word, end_word, word_count, sha1(text) AS fingerprint
    FROM chunks""",
)
def prose_windows_tail_merge(spark, sf_dir):
    docs = chunking.first_by_content(inputs.documents(spark, sf_dir))
    found = chunking.prose_chunks(docs, inputs.SETTINGS.replace(chunk_size=50, overlap=10, min_chunk_words=30))
    return found.select("doc_ord", "chunk_index", "start_word", "end_word", "word_count", t.fingerprint("text").alias("fingerprint"))


@query(
    "boilerplate_chunks",
    f"""WITH {_CHUNKS}, b AS (SELECT chunk_id, sha1(lower(text)) AS boilerplate_key FROM chunks)
    SELECT chunk_id, boilerplate_key, count(*) OVER (PARTITION BY boilerplate_key) AS repeat_count FROM b""",
)
def boilerplate_chunks(spark, sf_dir):
    return inputs.index(spark, sf_dir).counted().select("chunk_id", "boilerplate_key", "repeat_count")


@query(
    "corpus_duplicate_groups",
    rf"""WITH x AS (SELECT doc_id, {_COLLAPSE.format("coalesce(text, '')")} AS text FROM documents)
    SELECT sha1(text) AS fingerprint, count(*) AS occurrences, min(doc_id) AS first_ord FROM x WHERE text <> ''
    GROUP BY 1 HAVING count(*) > 1""",
)
def corpus_duplicate_groups(spark, sf_dir):
    return evaluation.duplicate_groups(inputs.documents(spark, sf_dir))


@query(
    "corpus_line_boilerplate",
    rf"""WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    x AS (SELECT {_COLLAPSE.format("line")} AS line FROM l)
    SELECT sha1(line) AS fingerprint, count(*) AS occurrences FROM x WHERE len(string_split(line, ' ')) >= 4
    GROUP BY 1 HAVING count(*) > 2""",
)
def corpus_line_boilerplate(spark, sf_dir):
    return evaluation.repeated_lines(inputs.documents(spark, sf_dir))


@query(
    "conversation_source_units",
    rf"""WITH t AS (SELECT conv_id, turn, {_STRIP.format("text")} AS p,
      len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations),
    u AS (SELECT *, row_number() OVER w - 1 AS unit_index, CAST(sum(n) OVER w AS BIGINT) AS unit_end FROM t WHERE p <> ''
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id AS doc_ord, unit_index, unit_end - n + 1 AS unit_start, unit_end, sha1(p) AS fingerprint FROM u""",
)
def conversation_source_units(spark, sf_dir):
    return chunking.prose_units(inputs.conversations(spark, sf_dir)).select(
        "doc_ord", "unit_index", "unit_start", "unit_end", t.fingerprint("unit_text").alias("fingerprint")
    )


@query(
    "cohesion_units",
    rf"""WITH RECURSIVE d AS (SELECT conv_id AS doc_ord, array_to_string(list(text ORDER BY turn, text), chr(10) || chr(10)) AS text FROM conversations GROUP BY 1),
    pr AS (SELECT doc_ord, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS ps FROM d),
    pp AS (SELECT doc_ord, generate_subscripts(ps, 1) AS para, unnest(ps) AS whole FROM pr),
    sr AS (SELECT doc_ord, para, list_filter(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM pp),
    s AS (SELECT doc_ord, para, len(ss) AS total, generate_subscripts(ss, 1) AS nth, unnest(ss) AS sentence FROM sr),
    k AS (SELECT *, list_distinct({_TOKENS.format("sentence")}) AS own, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) AS n FROM s),
    f AS (SELECT doc_ord, para, nth, 0 AS unit, own AS seen, n, total FROM k WHERE nth = 1
      UNION ALL
      SELECT doc_ord, para, nth, CASE WHEN near THEN unit ELSE unit + 1 END, CASE WHEN near THEN list_distinct(list_concat(seen, own)) ELSE own END, n, total
      FROM (SELECT k.doc_ord, k.para, k.nth, f.unit, f.seen, k.own, k.n, k.total,
        CASE WHEN len(seen) = 0 OR len(own) = 0 THEN false ELSE CAST(len(list_intersect(seen, own)) AS DOUBLE) / len(list_distinct(list_concat(seen, own))) >= 0.1 END AS near
        FROM f JOIN k ON k.doc_ord = f.doc_ord AND k.para = f.para AND k.nth = f.nth + 1)),
    u AS (SELECT doc_ord, para, unit, sum(n) AS n, max(total) > 1 AS cohesion_split_applied FROM f GROUP BY 1, 2, 3)
    SELECT doc_ord, row_number() OVER w - 1 AS unit_index, CAST(sum(n) OVER w - n + 1 AS BIGINT) AS unit_start, CAST(sum(n) OVER w AS BIGINT) AS unit_end, cohesion_split_applied
    FROM u WINDOW w AS (PARTITION BY doc_ord ORDER BY para, unit)""",
)
def cohesion_units(spark, sf_dir):
    units = chunking.prose_units(inputs.conversations(spark, sf_dir), cohesion=0.1)
    return units.select("doc_ord", "unit_index", "unit_start", "unit_end", "cohesion_split_applied")


_PATTERN_SQL = "\n".join(
    f"WHEN {' OR '.join(f"contains(lower(source), '{p}') OR contains(lower(text), '{p}')" for p in patterns)} THEN '{name}'"
    for name, patterns in (chunking.DOC_TYPE_PATTERNS | {"legal": ["license"]}).items()
)


@query(
    "doc_type_infer",
    f"""WITH {_DOCS} SELECT doc_ord, CASE WHEN contains(lower(source), 'src1/') THEN 'manual' {_PATTERN_SQL} ELSE 'note' END
    AS doc_type FROM k""",
)
def doc_type_infer(spark, sf_dir):
    docs = chunking.first_by_content(inputs.documents(spark, sf_dir))
    kind = chunking.resolved_doc_type(
        F.lit("unknown"), F.col("source"), F.col("text"), F.lit("text_parser"), inputs.TAXONOMY
    )
    return docs.select("doc_ord", kind.alias("doc_type"))


@query(
    "source_units",
    """SELECT doc_id AS doc_ord, 'su_' || substr(sha1('data/' || source || '/' || doc_id || '.txt'), 1, 16) AS source_unit_id,
    CASE doc_id % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'document' ELSE 'plain' END AS tier FROM documents""",
)
def source_units(spark, sf_dir):
    method = F.get(F.array(*map(F.lit, ["csv_parser", "html_parser", "xls_parser", "text_parser"])), F.col("doc_ord") % 4)
    return inputs.documents(spark, sf_dir).select(
        "doc_ord", t.source_unit_id("source").alias("source_unit_id"), t.extraction_tier(method).alias("tier")
    )


# --- retrieval ---------------------------------------------------------------------------------


_KIND = f"CASE WHEN contains(lower(source), 'src1/') THEN 'manual' {_PATTERN_SQL} ELSE 'note' END"
_WEIGHT = f"CASE doc_type {' '.join(f"WHEN '{k}' THEN {w}" for k, w in inputs.WEIGHTS.items())} ELSE 1.0 END"
_STAYS = "doc_ord NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def _kept_sql(stays: str = _STAYS, weight: str = _WEIGHT, strength: float = 0.25) -> str:
    """CTEs ``kept`` (chunks that stay, with their factors) and ``kpost`` (their postings), on top of ``_INDEX``."""
    return f"""{_INDEX},
kinds AS (SELECT doc_ord, {_KIND} AS doc_type FROM k),
counted AS (SELECT doc_ord, chunk_index, count(*) OVER (PARTITION BY sha1(lower(text))) AS n FROM chunks),
kept AS (SELECT doc_ord, chunk_index, CAST({weight} AS DOUBLE) AS weight,
  CAST(CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.4, 1 / (1 + {strength} * (n - 1))) END AS DOUBLE) AS penalty
  FROM counted JOIN kinds USING (doc_ord) WHERE {stays}),
kpost AS (SELECT post.* FROM post JOIN kept USING (doc_ord, chunk_index))"""


def _lexical_cte(base: str) -> str:
    """CTE ``lex``: final scores of the lexical list from the threshold on."""
    return f"""sizes AS (SELECT doc_ord, chunk_index, count(*) AS size FROM post GROUP BY ALL),
s AS (SELECT query_id, doc_ord, chunk_index, asked, sum(tf) AS occ, count(*) AS shared FROM kpost JOIN qt USING (term) GROUP BY ALL),
lb AS (SELECT query_id, doc_ord, chunk_index, {base} AS base, weight, penalty FROM s JOIN sizes USING (doc_ord, chunk_index) JOIN kept USING (doc_ord, chunk_index)),
lex AS (SELECT *, round(base * weight * penalty, 4) AS score FROM lb WHERE base * weight * penalty >= 0.25)"""


_OVERLAP, _CONTAINMENT, _JACCARD = "CAST(occ AS DOUBLE) / asked", "CAST(shared AS DOUBLE) / asked", "CAST(shared AS DOUBLE) / (asked + size - shared)"


def _top_sql(ctes: str, source: str) -> str:
    return f"WITH {ctes}, o AS (SELECT query_id, {_RANK}, doc_ord, chunk_index, score FROM {source}) SELECT * FROM o WHERE rank <= 5"


def _ranked(**changes) -> Query:
    """The benchmark texts asked under some settings: filtered, scored, weighed and ranked."""

    def run(spark, sf_dir):
        found = retrievers.retrieve(inputs.request(spark, sf_dir, **changes))
        return found.ranked.select("query_id", "rank", "doc_ord", "chunk_index", "score")

    return run


for _metric, _base in {"overlap": _OVERLAP, "containment": _CONTAINMENT, "jaccard": _JACCARD}.items():
    query(f"lex_{_metric}_topk", _top_sql(f"{_kept_sql()}, {_lexical_cte(_base)}", "lex"))(_ranked(lexical_similarity_metric=_metric))

query("metadata_weighted_topk", _top_sql(f"{_kept_sql(strength=0)}, {_lexical_cte(_OVERLAP)}", "lex"))(
    _ranked(boilerplate_penalty_enabled=False)
)
query("boilerplate_penalised_topk", _top_sql(f"{_kept_sql(weight='1.0', strength=0.5)}, {_lexical_cte(_CONTAINMENT)}", "lex"))(
    _ranked(metadata_weighting_enabled=False, boilerplate_penalty_strength=0.5, lexical_similarity_metric="containment")
)
#: Settings under which most chunks are filtered, and the documents that stay.
_STRICT = {"status_deny_list": ("retired",), "freshness_max_age_days": 180, "lifecycle_require_persisted_record": True}
_STRICT_STAYS = """doc_ord IN (SELECT doc_id FROM labels WHERE toxic <> 1 AND quality <> 0
  AND date_diff('day', TIMESTAMP '2023-01-01' + to_days(CAST(doc_id * 37 % 500 AS INTEGER)), TIMESTAMP '2024-02-01') <= 180)"""
query("lifecycle_retained_topk", _top_sql(f"{_kept_sql(_STRICT_STAYS)}, {_lexical_cte(_OVERLAP)}", "lex"))(_ranked(**_STRICT))

_TFIDF = f"""{_kept_sql()},
total AS (SELECT count(*) AS n FROM kept),
df AS (SELECT term, count(*) AS df FROM kpost GROUP BY term),
wt AS (SELECT kpost.*, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM kpost JOIN df USING (term), total),
norms AS (SELECT doc_ord, chunk_index, sqrt(sum((tf * idf) ** 2)) AS norm FROM wt GROUP BY ALL),
qi AS (SELECT query_id, term, ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1 AS qidf FROM qt LEFT JOIN df USING (term), total),
qn AS (SELECT query_id, sqrt(sum(qidf ** 2)) AS qnorm FROM qi GROUP BY ALL),
dots AS (SELECT query_id, doc_ord, chunk_index, sum(tf * idf * qidf) AS dot FROM wt JOIN qi USING (term) GROUP BY ALL),
tb AS (SELECT query_id, doc_ord, chunk_index, dot / (norm * qnorm) AS base, weight, penalty FROM dots JOIN norms USING (doc_ord, chunk_index)
  JOIN qn USING (query_id) JOIN kept USING (doc_ord, chunk_index)),
tfidf AS (SELECT *, round(base * weight * penalty, 4) AS score FROM tb WHERE base * weight * penalty >= 0.25)"""

tfidf_topk = query("tfidf_topk", _top_sql(_TFIDF, "tfidf"))(_ranked(retrieval_backend="tfidf"))
query(
    "hybrid_rrf_topk",
    _top_sql(
        f"""{_TFIDF}, {_lexical_cte(_OVERLAP)},
    lr AS (SELECT *, {_RANK} FROM lex), tr AS (SELECT *, {_RANK} FROM tfidf),
    f AS (SELECT query_id, doc_ord, chunk_index,
      round(coalesce(1.0::DOUBLE / (60 + lr.rank), 0) + coalesce(1.0::DOUBLE / (60 + tr.rank), 0), 6) AS score
      FROM lr FULL JOIN tr USING (query_id, doc_ord, chunk_index))""",
        "f",
    ),
)(_ranked(retrieval_backend="hybrid"))


def _first_words(spark, sf_dir, **changes):
    """The first word of every benchmark text and one word that no text has, asked without a threshold."""
    asked = inputs.request(spark, sf_dir, min_retrieval_score=0.0, **changes)
    words = asked.queries.select("query_id", F.get(F.split("query", " "), 0).alias("query"))
    nowhere = asked.queries.select((-1 - F.col("query_id")).alias("query_id"), F.concat(F.lit("q0z_"), "query_id").alias("query"))
    return retrievers.retrieve(replace(asked, queries=words.unionByName(nowhere))).ranked.select("query_id", "rank", *retrieval.KEY, "score")


def _first_words_sql(ctes: str, source: str) -> str:
    """Chunks with tokens that share no term follow all hits with a score of zero."""
    own = ctes.replace(
        "q AS (SELECT item_id AS query_id, list_distinct(", "q AS (SELECT query_id, list_distinct("
    ).replace("AS terms FROM benchmark)", "AS terms FROM asked)", 1).replace(">= 0.25", ">= 0.0")
    return f"""WITH asked AS (SELECT item_id AS query_id, string_split(text, ' ')[1] AS text FROM benchmark UNION ALL SELECT -1 - item_id, 'q0z_' || item_id FROM benchmark),
    {own}, every AS (SELECT query_id, doc_ord, chunk_index, coalesce(x.score, 0) AS score FROM q CROSS JOIN (SELECT DISTINCT doc_ord, chunk_index FROM kpost) c
      LEFT JOIN {source} x USING (query_id, doc_ord, chunk_index) WHERE len(terms) > 0),
    o AS (SELECT query_id, {_RANK}, doc_ord, chunk_index, score FROM every) SELECT * FROM o WHERE rank <= 5"""


query("lex_zero_threshold_topk", _first_words_sql(f"{_kept_sql()}, {_lexical_cte(_OVERLAP)}", "lex"))(_first_words)
query("tfidf_zero_threshold_topk", _first_words_sql(_TFIDF, "tfidf"))(lambda spark, sf_dir: _first_words(spark, sf_dir, retrieval_backend="tfidf"))


@query(
    "ranker_topk",
    rf"""WITH {_CHUNKS}, tok AS (SELECT doc_ord, chunk_index, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM chunks),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark),
    s AS (SELECT query_id, doc_ord, chunk_index, count(*) AS n FROM tok JOIN qt USING (term) GROUP BY ALL),
    a AS (SELECT item_id AS query_id, chunks.doc_ord, chunks.chunk_index, coalesce(n, 0) AS score FROM benchmark CROSS JOIN chunks
      LEFT JOIN s ON s.query_id = item_id AND s.doc_ord = chunks.doc_ord AND s.chunk_index = chunks.chunk_index),
    o AS (SELECT query_id, {_RANK}, doc_ord, chunk_index, score FROM a) SELECT * FROM o WHERE rank <= 5""",
)
def ranker_topk(spark, sf_dir):
    top = retrieval.rank_by_counts(inputs.queries(spark, sf_dir), inputs.index(spark, sf_dir).chunks, inputs.SETTINGS.top_k)
    return top.select("query_id", "rank", "doc_ord", "chunk_index", "score")


@query(
    "score_components",
    f"""WITH {_kept_sql()}, {_lexical_cte(_CONTAINMENT)}, o AS (SELECT *, {_RANK} FROM lex)
    SELECT query_id, rank, doc_ord, chunk_index, score, round(base, 6) AS base_similarity, round(weight, 6) AS metadata_weight,
      round(penalty, 6) AS boilerplate_penalty, 1.0::DOUBLE AS table_boost, round(base * weight * penalty, 6) AS final_score
    FROM o WHERE rank <= 5""",
)
def score_components(spark, sf_dir):
    found = retrievers.retrieve(inputs.request(spark, sf_dir, lexical_similarity_metric="containment"))
    return found.ranked.select("query_id", "rank", *retrieval.KEY, "score", "score_components.*")


@query(
    "retrieval_diagnostics",
    f"""WITH {_TFIDF}, o AS (SELECT *, {_RANK} FROM tfidf),
    top AS (SELECT query_id, array_to_string(list(chunk_id ORDER BY rank), ' ') AS explained FROM o JOIN chunks USING (doc_ord, chunk_index) WHERE rank <= 2 GROUP BY 1)
    SELECT query_id, 'tfidf' AS backend, array_to_string(list_sort(terms), ' ') AS query_terms, (SELECT count(*) FROM chunks) AS candidates,
      (SELECT count(*) FROM chunks) - (SELECT n FROM total) AS filtered_soft_deleted, (SELECT n FROM total) AS retained, coalesce(explained, '') AS explained
    FROM q LEFT JOIN top USING (query_id)""",
)
def retrieval_diagnostics(spark, sf_dir):
    verbose = {"retrieval_diagnostics_mode": "verbose", "retrieval_diagnostics_top_n": 2}
    found = retrievers.retrieve(inputs.request(spark, sf_dir, retrieval_backend="tfidf", **verbose)).diagnostics
    return found.select(
        "query_id",
        "backend",
        F.array_join("query_terms", " ").alias("query_terms"),
        "candidates",
        "filtered_soft_deleted",
        "retained",
        F.coalesce(F.array_join("final_rank_explanations.chunk_id", " "), F.lit("")).alias("explained"),
    )


@query(
    "query_expansion",
    f"""WITH q AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format("text")}) AS terms FROM benchmark),
    a AS (SELECT query_id, CASE WHEN list_contains(terms, 'the') THEN list_concat(terms, ['la', 'der']) ELSE terms END AS terms FROM q),
    b AS (SELECT query_id, CASE WHEN list_contains(terms, 'la') OR list_contains(terms, 'der') THEN list_concat(terms, ['the']) ELSE terms END AS terms FROM a)
    SELECT query_id, array_to_string(list_sort(list_distinct(terms)), ' ') AS terms FROM b""",
)
def query_expansion(spark, sf_dir):
    found = retrieval.query_terms(inputs.queries(spark, sf_dir), inputs.THESAURUS)
    return found.select("query_id", F.array_join("terms", " ").alias("terms"))


def _vectors(metric: str) -> Query:
    """Every row whose id is divisible by 20 against all rows."""

    def run(spark, sf_dir):
        rows = inputs.table(spark, sf_dir, "embeddings")
        asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
        scores = retrieval.vector_scores(asked, rows.select("vec_id", F.col("embedding").alias("vector")), metric, 0.25, 5)
        top = retrieval.ranked(scores, 5, ties=["vec_id"])
        return top.select("query_id", "rank", "vec_id", "score")

    return run


def _vector_sql(value: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {value} AS base FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
    r AS (SELECT query_id, vec_id, round(base, 4) AS score FROM s WHERE base >= 0.25),
    o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM r)
    SELECT * FROM o WHERE rank <= 5"""


_DOT = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
query("vec_cosine_topk", _vector_sql(_DOT))(_vectors("cosine"))
query("vec_dot_topk", _vector_sql(_DOT))(_vectors("dot"))
query("vec_l2_topk", _vector_sql("1 / (1 + list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]))"))(_vectors("euclidean"))


@query(
    "hash_embed_buckets",
    r"""WITH p AS (SELECT item_id AS query_id, lower(text) AS body FROM benchmark),
    f AS (
      SELECT query_id, 'tok:' || unnest(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) AS f, 1.0 AS w FROM p
      UNION ALL
      SELECT query_id, 'ch' || n || ':' || substr(j, i, n) AS f, 0.35 AS w FROM (
        SELECT query_id, j, n, unnest(range(1, len(j) - n + 2)) AS i FROM (
          SELECT query_id, replace(body, ' ', '_') AS j, unnest([3, 4, 5]) AS n FROM p)))
    SELECT query_id, CAST(('0x' || substr(sha1(f), 1, 16))::UBIGINT % 256 AS BIGINT) AS idx, round(CAST(sum(w) AS DOUBLE), 4) AS weight
    FROM f GROUP BY 1, 2""",
)
def hash_embed_buckets(spark, sf_dir):
    texts = inputs.queries(spark, sf_dir).select("query_id", F.col("query").alias("text"))
    return retrieval.hashed_features(texts, "query_id").select("query_id", "idx", F.round("weight", 4).alias("weight"))


def _features_sql(texts: str, keys: str) -> str:
    """Buckets of hashed words and character n-grams of ``texts`` (keys, body)."""
    return rf"""(SELECT {keys}, ('0x' || substr(sha1(f), 1, 16))::UBIGINT % 256 AS idx, CAST(sum(w) AS DOUBLE) AS w FROM (
      SELECT {keys}, 'tok:' || unnest(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) AS f, 1.0::DOUBLE AS w FROM {texts}
      UNION ALL SELECT {keys}, 'ch' || n || ':' || substr(j, i, n) AS f, 0.35::DOUBLE AS w FROM (
        SELECT {keys}, j, n, unnest(range(1, len(j) - n + 2)) AS i FROM (SELECT {keys}, replace(body, ' ', '_') AS j, unnest([3, 4, 5]) AS n FROM {texts})))
      GROUP BY ALL)"""


query(
    "hash_vector_topk",
    _top_sql(
        f"""{_kept_sql()}, ct AS (SELECT doc_ord, chunk_index, lower(text) AS body FROM chunks JOIN kept USING (doc_ord, chunk_index)),
    qb AS (SELECT query_id, array_to_string(list_sort(terms), ' ') AS body FROM q),
    cf AS {_features_sql("ct", "doc_ord, chunk_index")}, qf AS {_features_sql("qb", "query_id")},
    cn AS (SELECT doc_ord, chunk_index, sqrt(sum(w * w)) AS norm FROM cf GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qf GROUP BY ALL),
    dots AS (SELECT query_id, doc_ord, chunk_index, sum(cf.w * qf.w) AS dot FROM cf JOIN qf USING (idx) GROUP BY ALL),
    vb AS (SELECT query_id, doc_ord, chunk_index, dot / (norm * qnorm) * weight * penalty AS final FROM dots JOIN cn USING (doc_ord, chunk_index)
      JOIN qn USING (query_id) JOIN kept USING (doc_ord, chunk_index)),
    vec AS (SELECT *, round(final, 4) AS score FROM vb WHERE final >= 0.25)""",
        "vec",
    ),
)(_ranked(retrieval_backend="vector"))


# --- lifecycle ---------------------------------------------------------------------------------

_RECORDS = """r AS (SELECT doc_id, strftime(TIMESTAMP '2023-01-01' + to_days(CAST(doc_id * 37 % 500 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS ts,
  doc_id * 37 % 500 AS days, CASE WHEN toxic = 1 THEN 'soft_deleted' WHEN quality = 0 THEN 'retired' ELSE 'active' END AS status FROM labels)"""
_REASONS = f"""{_RECORDS}, j AS (SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing_persisted_record'
  WHEN status = 'soft_deleted' THEN 'soft_deleted' WHEN status = 'retired' THEN 'status_denied'
  WHEN date_diff('day', TIMESTAMP '2023-01-01' + to_days(CAST(days AS INTEGER)), TIMESTAMP '2024-02-01') > 180 THEN 'freshness_stale' END AS filter_reason
  FROM documents d LEFT JOIN r USING (doc_id))"""
_GOVERNED = inputs.SETTINGS.replace(**_STRICT)


def _now():
    return F.to_timestamp(F.lit(inputs.NOW))


def _filtered(spark, sf_dir):
    return lifecycle.with_filter_reason(inputs.units(spark, sf_dir), inputs.records(spark, sf_dir), _GOVERNED, _now())


@query("lifecycle_filter_reasons", f"WITH {_REASONS} SELECT doc_id, filter_reason FROM j")
def lifecycle_filter_reasons(spark, sf_dir):
    return _filtered(spark, sf_dir).select("doc_id", "filter_reason")


@query(
    "lifecycle_diagnostics",
    f"""WITH {_REASONS} SELECT count(*) AS candidates,
    {", ".join(f"count(*) FILTER (WHERE filter_reason = '{r}') AS filtered_{r}" for r in lifecycle.REASONS)},
    count(*) FILTER (WHERE filter_reason IS NULL) AS retained FROM j""",
)
def lifecycle_diagnostics(spark, sf_dir):
    return lifecycle.filter_diagnostics(_filtered(spark, sf_dir))


@query(
    "lifecycle_upsert_actions",
    f"""WITH {_RECORDS}, j AS (SELECT doc_id, r.doc_id IS NOT NULL AS known, doc_id % 2 = 0 AS same, ts, status FROM documents LEFT JOIN r USING (doc_id))
    SELECT 'unit-' || doc_id AS source_unit_id,
      CASE WHEN NOT known THEN 'created' WHEN same THEN 'unchanged_skipped' ELSE 'updated' END AS action,
      CASE WHEN known AND same THEN status ELSE 'active' END AS status,
      CASE WHEN known THEN ts ELSE '2024-02-01T00:00:00Z' END AS ingestion_iso_ts,
      CASE WHEN known AND same THEN ts ELSE '2024-02-01T00:00:00Z' END AS last_upsert_iso_ts,
      CASE WHEN known AND same AND status = 'soft_deleted' THEN ts END AS deletion_mark_iso_ts FROM j""",
)
def lifecycle_upsert_actions(spark, sf_dir):
    batch = inputs.units(spark, sf_dir).select(
        "source_unit_id",
        F.col("source_unit_id").alias("source"),
        F.when(F.col("doc_id") % 2 == 0, F.sha1(F.col("doc_id").cast("string").cast("binary"))).otherwise("new").alias("content_fingerprint"),
        F.col("doc_id").alias("seq"),
    )
    found = lifecycle.upsert(inputs.records(spark, sf_dir), batch, inputs.NOW, skip_unchanged=True)
    return found.select("source_unit_id", "action", "status", "ingestion_iso_ts", "last_upsert_iso_ts", "deletion_mark_iso_ts")


@query(
    "soft_delete_purge",
    f"""WITH {_RECORDS} SELECT 'unit-' || doc_id AS source_unit_id, CASE WHEN doc_id % 5 = 0 THEN 'soft_deleted' ELSE status END AS status,
    CASE WHEN doc_id % 5 = 0 THEN 'keep' WHEN status <> 'soft_deleted' THEN 'keep'
    WHEN date_diff('day', TIMESTAMP '2023-01-01' + to_days(CAST(days AS INTEGER)), TIMESTAMP '2024-02-01') < 90 THEN 'keep' ELSE 'purge' END AS purge FROM r""",
)
def soft_delete_purge(spark, sf_dir):
    """Every fifth unit is deleted a month before the purge of what has been deleted for ninety days."""
    commands = inputs.units(spark, sf_dir).where("doc_id % 5 = 0").select("source_unit_id")
    deleted = lifecycle.soft_delete(inputs.records(spark, sf_dir), commands, "2024-01-01T00:00:00Z")
    return lifecycle.purge_plan(deleted, _now(), 90).select("source_unit_id", "status", "purge")


@query(
    "purge_report",
    f"""WITH {_RECORDS}, p AS (SELECT status = 'soft_deleted' AND date_diff('day', TIMESTAMP '2023-01-01' + to_days(CAST(days AS INTEGER)), TIMESTAMP '2024-02-01') >= 90 AS gone FROM r)
    SELECT count(*) AS inspected_records, count(*) FILTER (WHERE gone) AS purged_count, 0 AS skipped_missing_deletion_mark_iso_ts,
      0 AS skipped_invalid_deletion_mark_iso_ts, count(*) FILTER (WHERE NOT gone) AS remaining_records FROM p""",
)
def purge_report(spark, sf_dir):
    return lifecycle.purge_report(inputs.records(spark, sf_dir), _now(), 90)


@query(
    "freshness_policy",
    f"""WITH {_RECORDS}, x AS (SELECT doc_id, days, doc_id % 5 AS kind FROM r)
    SELECT 'unit-' || doc_id AS source_unit_id, CASE WHEN kind = 0 THEN 'freshness_missing_timestamp' WHEN kind = 1 THEN 'freshness_invalid_timestamp'
      WHEN date_diff('day', TIMESTAMP '2023-01-01' + to_days(CAST(days AS INTEGER)), TIMESTAMP '2024-02-01') > 200 THEN 'freshness_stale' END AS filter_reason FROM x""",
)
def freshness_policy(spark, sf_dir):
    """Every fifth record has no time, every other fifth an unreadable one."""
    kind = F.regexp_extract("source_unit_id", r"\d+", 0).cast("long") % 5
    spoil = lambda c: F.when(kind == 0, " ").when(kind == 1, "soon").otherwise(F.col(c)).alias(c)
    records = inputs.records(spark, sf_dir)
    records = records.select(*[spoil(c) if c.endswith("ion_iso_ts") or c.endswith("upsert_iso_ts") else F.col(c) for c in records.columns])
    settings = inputs.SETTINGS.replace(
        exclude_soft_deleted=False, freshness_max_age_days=200, freshness_missing_ts_policy="exclude", freshness_invalid_ts_policy="exclude"
    )
    found = lifecycle.with_filter_reason(records.select("source_unit_id"), records, settings, _now())
    return found.select("source_unit_id", "filter_reason")


@query(
    "audit_report",
    f"""WITH {_RECORDS} SELECT 'status' AS section, status AS name, count(*) AS n FROM r GROUP BY 2
    UNION ALL SELECT 'timestamps', unnest(['missing_ingestion_iso_ts', 'invalid_ingestion_iso_ts', 'missing_last_upsert_iso_ts', 'invalid_last_upsert_iso_ts']), 0
    UNION ALL SELECT 'state', unnest(['total_records', 'active_count', 'soft_deleted_count']), unnest([count(*), count(*) FILTER (WHERE status = 'active'), count(*) FILTER (WHERE status = 'soft_deleted')]) FROM r
    UNION ALL SELECT 'reingestion', unnest(['created', 'updated', 'unchanged_skipped']), 0
    UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2""",
)
def audit_report(spark, sf_dir):
    return lifecycle.audit_report(inputs.records(spark, sf_dir), inputs.audit_events(spark, sf_dir))


# --- tables ------------------------------------------------------------------------------------

_TABLES = """t AS (SELECT s_nationkey AS doc_ord, list(s_suppkey || ' | ' || s_name ORDER BY s_suppkey) AS rows FROM supplier GROUP BY 1)"""


def _profile_sql(mark: str, least: int, extra: str) -> str:
    """Whether the lines of ``ls`` that hold the mark have the profile of a table."""
    cells = f"list_filter(list_transform(string_split(x, '{mark}'), lambda c: trim(c)), lambda c: c <> '')"
    rows = f"list_filter(list_transform(list_filter(ls, lambda x: contains(x, '{mark}')), lambda x: {{'line': x, 'cells': {cells}}}), lambda r: len(r.cells) >= 2)"
    return f"""SELECT source FROM (SELECT *, list_transform(rows, lambda r: len(r.cells)) AS widths, CAST(len(rows) AS DOUBLE) AS n FROM (SELECT source, {rows} AS rows FROM l))
      WHERE n >= {least} AND list_max(list_transform(widths, lambda v: len(list_filter(widths, lambda y: y = v)))) / n >= 0.6
      AND len(list_filter(rows, lambda r: list_max(list_transform(r.cells, lambda c: len(regexp_split_to_array(c, '\\s+')))) <= 8)) / n >= 0.6
      AND len(list_filter(rows, lambda r: regexp_matches(r.line, '[.!?]$'))) / n <= 0.4 {extra}"""


_WIDE = """AND (list_max(list_filter(widths, lambda v: len(list_filter(widths, lambda y: y = v)) / n >= 0.6)) >= 3
  OR (len(list_filter(rows, lambda r: regexp_matches(r.cells[2], '^-?[0-9]+([.][0-9]+)?$'))) / n >= 0.5
  AND len(list_filter(rows, lambda r: len(regexp_split_to_array(r.cells[1], '\\s+')) <= 3)) / n >= 0.5))"""


@query(
    "table_classify",
    f"""WITH {_TABLES}, b AS (SELECT 'tables/' || doc_ord || '.txt' AS source, 'key | name' || chr(10) || array_to_string(rows, chr(10)) AS text FROM t
      UNION ALL SELECT 'data/' || source || '/' || doc_id || '.txt', coalesce(text, '') FROM documents),
    l AS (SELECT source, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: {_STRIP.format("x")}), lambda x: x <> '')[1:30] AS ls FROM b),
    yes AS ({_profile_sql("|", 2, "")} UNION {_profile_sql(",", 3, _WIDE)})
    SELECT b.source, yes.source IS NOT NULL AS is_tabular FROM b LEFT JOIN yes USING (source)""",
)
def table_classify(spark, sf_dir):
    both = inputs.table_documents(spark, sf_dir).unionByName(inputs.documents(spark, sf_dir))
    return both.select("source", chunking.looks_tabular("text").alias("is_tabular"))


@query(
    "table_windows",
    f"""WITH {_TABLES}, x AS (SELECT *, unnest(range(0, len(rows), 2)) AS start FROM t),
    y AS (SELECT doc_ord, start, rows[start + 1 : start + 3] AS part FROM x)
    SELECT CAST(doc_ord AS BIGINT) AS doc_ord, start + 1 AS row_start, start + len(part) AS row_end, start + 2 AS absolute_row_start,
      start + len(part) + 1 AS absolute_row_end, len(part) AS window_row_count,
      sha1('key | name' || chr(10) || array_to_string(part, chr(10))) AS fingerprint FROM y WHERE start = 0 OR len(part) > 1""",
)
def table_windows(spark, sf_dir):
    docs = inputs.table_documents(spark, sf_dir).withColumn("known_headers", F.array(F.lit("Key | Name")))
    found = chunking.table_windows(chunking.table_sections(docs), 3, 1)
    return found.select(
        "doc_ord",
        "row_start",
        "row_end",
        "absolute_row_start",
        "absolute_row_end",
        "window_row_count",
        t.fingerprint("text_window").alias("fingerprint"),
    )


@query(
    "table_header_sections",
    """WITH t AS (SELECT s_nationkey AS doc_ord, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 4 AS section_index,
      s_suppkey || ' | ' || s_name AS line, s_suppkey FROM supplier),
    g AS (SELECT doc_ord, section_index, list(line ORDER BY s_suppkey) AS rows FROM t GROUP BY ALL),
    c AS (SELECT *, count(*) OVER (PARTITION BY doc_ord) AS n FROM g)
    SELECT CAST(doc_ord AS BIGINT) AS doc_ord, section_index, 'Key | Name' AS header, section_index + 1 AS header_repeat_index,
      n AS header_repeat_count, len(rows) AS section_row_count, 'table_metadata' AS header_source, sha1(array_to_string(rows, chr(10))) AS fingerprint FROM c""",
)
def table_header_sections(spark, sf_dir):
    found = chunking.table_sections(inputs.headed_documents(spark, sf_dir))
    return found.select(
        "doc_ord", "section_index", "header", "header_repeat_index", "header_repeat_count", "section_row_count", "header_source",
        t.fingerprint(F.array_join("rows", "\n")).alias("fingerprint"),
    )


_BOOSTED = {"table_chunk_rows": 3, "table_overlap_rows": 1, "lexical_similarity_metric": "containment"}


def _table_index(spark, sf_dir) -> retrievers.Index:
    chunks, _ = builder.build_chunks(inputs.table_documents(spark, sf_dir), inputs.SETTINGS.replace(**_BOOSTED), now=inputs.NOW)
    return retrievers.Index.write(chunks, storage.new_folder(spark, "table-index"))


@query(
    "tabular_boost",
    f"""WITH {_TABLES}, x AS (SELECT *, unnest(range(0, len(rows), 2)) AS start FROM t),
    y AS (SELECT doc_ord, start, rows[start + 1 : start + 3] AS part FROM x),
    w AS (SELECT doc_ord, row_number() OVER (PARTITION BY doc_ord ORDER BY start) - 1 AS chunk_index, part FROM y WHERE start = 0 OR len(part) > 1),
    v AS (SELECT doc_ord, chunk_index, part, list_distinct({_TOKENS.format("'key name ' || array_to_string(part, ' ')")}) AS ts,
      list_distinct({_TOKENS.format("array_to_string(part, ' ')")}) AS rs FROM w),
    qq AS (SELECT s_nationkey AS query_id, list_distinct({_TOKENS.format("(CASE WHEN s_nationkey % 2 = 0 THEN 'the table name ' ELSE 'which of all ' END) || min(s_name)")}) AS terms FROM supplier GROUP BY 1),
    b AS (SELECT query_id, doc_ord, chunk_index, CAST(len(list_intersect(ts, terms)) AS DOUBLE) / len(terms) AS base,
      CASE WHEN list_contains(terms, 'table') THEN 1.0 + 0.2 + CASE WHEN len(list_intersect(['key', 'name'], terms)) > 0 THEN 0.2 ELSE 0.0 END
        + CASE WHEN len(list_intersect(rs, terms)) > 0 THEN 0.15 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS boost FROM v, qq),
    r AS (SELECT *, round(base * boost, 4) AS score FROM b WHERE base > 0 AND base * boost >= 0.25), o AS (SELECT *, {_RANK} FROM r)
    SELECT CAST(query_id AS BIGINT) AS query_id, rank, CAST(doc_ord AS BIGINT) AS doc_ord, chunk_index, score, round(boost, 6) AS table_boost FROM o WHERE rank <= 5""",
)
def tabular_boost(spark, sf_dir):
    names = inputs.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("query_id")).agg(F.min("s_name").alias("n"))
    head = F.when(F.col("query_id") % 2 == 0, "the table name ").otherwise("which of all ")
    queries = names.select("query_id", F.concat(head, F.col("n")).alias("query"))
    thesaurus = {"intent_groups": inputs.THESAURUS["intent_groups"]}
    request = retrievers.Request(queries, _table_index(spark, sf_dir), inputs.SETTINGS.replace(**_BOOSTED), thesaurus, None, _now())
    found = retrievers.retrieve(request).ranked
    return found.select("query_id", "rank", "doc_ord", "chunk_index", "score", F.col("score_components.table_boost").alias("table_boost"))


@query(
    "chunk_table",
    f"""WITH {_CHUNKS}, kinds AS (SELECT doc_ord, {_KIND} AS doc_type FROM k), u AS (SELECT *, 'su_' || substr(sha1(source), 1, 16) AS unit FROM chunks)
    SELECT chunk_id, unit AS source_unit_id, unit || ':prose:0' AS local_id, doc_type, sha1(text) AS content_fingerprint, 'prose' AS kind, start_word, end_word,
      'active' AS status, 'plain_text_parse' AS tier FROM u JOIN kinds USING (doc_ord)""",
)
def chunk_table(spark, sf_dir):
    found = inputs.index(spark, sf_dir).chunks
    return found.select(
        "chunk_id", "source_unit_id", F.col("source_unit_local_id").alias("local_id"), "doc_type", "content_fingerprint",
        F.col("source_unit_kind").alias("kind"), F.col("prose_chunk_metadata.chunk_start_word_index").alias("start_word"),
        F.col("prose_chunk_metadata.chunk_end_word_index").alias("end_word"), "status", F.col("confidence_inputs.base_extraction_tier").alias("tier"),
    )


@query(
    "source_statistics",
    f"""WITH {_CHUNKS}, kinds AS (SELECT doc_ord, {_KIND} AS doc_type FROM k)
    SELECT source, count(*) AS chunk_count, 0::BIGINT AS tabular_chunk_count, count(*) AS prose_chunk_count, any_value(doc_type) AS inferred_doc_types
    FROM chunks JOIN kinds USING (doc_ord) GROUP BY 1""",
)
def source_statistics(spark, sf_dir):
    found = builder.source_statistics(inputs.index(spark, sf_dir).chunks)
    return found.withColumn("inferred_doc_types", F.array_join("inferred_doc_types", " "))


@query(
    "tabular_grounding_rows",
    f"""WITH {_TABLES}, x AS (SELECT doc_ord, unnest(rows) AS row_text FROM t),
    y AS (SELECT doc_ord, row_text, list_distinct({_TOKENS.format("row_text || ' key name'")}) AS ts FROM x),
    z AS (SELECT doc_ord, row_text, list_sort(list_intersect(ts, ['supplier', '000000007', 'name', '12', '17'])) AS m FROM y)
    SELECT CAST(doc_ord AS BIGINT) AS doc_ord, row_text, array_to_string(m, ' ') AS matched_terms FROM z WHERE len(m) >= 2""",
)
def tabular_grounding_rows(spark, sf_dir):
    asked = inputs.table_documents(spark, sf_dir).withColumn("query", F.lit("Supplier 000000007 with name of 12 or 17"))
    found = answers.ground_rows(asked, 2).select("doc_ord", F.explode("matched_rows").alias("r"))
    return found.select("doc_ord", F.col("r.row_text").alias("row_text"), F.array_join("r.matched_terms", " ").alias("matched_terms"))


# --- answers -----------------------------------------------------------------------------------

_TOP = f"""{_kept_sql()}, {_lexical_cte(_OVERLAP)},
o AS (SELECT query_id, {_RANK}, doc_ord, chunk_index, score FROM lex),
e AS (SELECT query_id, rank, score, chunks.* FROM o JOIN chunks USING (doc_ord, chunk_index) WHERE rank <= 5)"""


def _evidence(spark, sf_dir) -> DataFrame:
    """The chunks that the default backend ranks, under the filter, the factors and the configured threshold;
    a table of ``top_k`` rows a query, as several plans start from it."""
    asked = inputs.request(spark, sf_dir)
    found = retrievers.evidence(retrievers.retrieve(asked), asked.index)
    return storage.written(found, storage.new_folder(spark, "evidence"))


@query(
    "answers_extractive",
    f"""WITH {_TOP}, a AS (SELECT query_id, array_to_string(list(text ORDER BY rank), chr(10)) AS answer, count(*) AS n,
      array_to_string(list(chunk_id ORDER BY rank), ' ') AS ids FROM e WHERE rank <= 3 GROUP BY 1)
    SELECT item_id AS query_id, sha1(coalesce(answer, 'I cannot answer confidently because no supporting evidence was retrieved.')) AS answer,
      n IS NULL AS abstained, CASE WHEN n IS NULL THEN 'no_supporting_evidence' END AS reason_code, coalesce(ids, '') AS cited,
      coalesce(n, 0) AS used_context_count FROM benchmark LEFT JOIN a ON query_id = item_id""",
)
def answers_extractive(spark, sf_dir):
    found = answers.extractive_answers(inputs.queries(spark, sf_dir), _evidence(spark, sf_dir))
    return found.select(
        "query_id",
        t.fingerprint("answer").alias("answer"),
        "abstained",
        "reason_code",
        F.array_join("cited_chunk_ids", " ").alias("cited"),
        "used_context_count",
    )


@query(
    "citations_quality",
    f"""WITH {_TOP} SELECT query_id, rank, chunk_id AS id, regexp_extract(source, '[^/]*$') AS title, source AS document,
    substr(text, 1, 280) AS snippet, score, rank <= 3 AND (max(rank) OVER (PARTITION BY query_id) > 3 OR score >= 0.5) AS visible,
    CASE WHEN length(text) < 10 THEN 'snippet_adequacy' ELSE '' END AS failures FROM e""",
)
def citations_quality(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    sources = inputs.index(spark, sf_dir).chunks.select("chunk_id", "source")
    judged = answers.quality_failures(answers.citations(evidence), sources)
    return answers.split_citations(judged).select(
        "query_id", "rank", "id", "title", "document", "snippet", "score", "visible", F.array_join("failures", " ").alias("failures")
    )


@query(
    "provenance_report",
    f"""WITH {_TOP}, j AS (SELECT query_id, length(text) < 10 AS weak FROM e)
    SELECT query_id, count(*) AS total, count(*) FILTER (WHERE NOT weak) AS complete, 0::BIGINT AS missing_fields,
    count(*) FILTER (WHERE weak) AS snippet_adequacy, 0::BIGINT AS source_traceability, 0::BIGINT AS duplicate_policy,
    round(avg(CASE WHEN weak THEN 0.0 ELSE 1.0 END), 4) AS completeness FROM j GROUP BY 1""",
)
def provenance_report(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    sources = inputs.index(spark, sf_dir).chunks.select("chunk_id", "source")
    return answers.provenance(answers.quality_failures(answers.citations(evidence), sources))


@query(
    "confidence_labels",
    f"""WITH {_TOP}, {_RECORDS}, xx AS (SELECT query_id, rank, least(1.0, score) AS score,
      CASE WHEN status = 'soft_deleted' THEN 0.0 WHEN status = 'retired' THEN 0.5 ELSE 1.0 END AS alive,
      CASE WHEN r.doc_id IS NULL THEN 1.0 ELSE greatest(0.35, 0.5 ** ((396 - days) / 365.0)) END AS decay
      FROM e LEFT JOIN r ON doc_id = doc_ord),
    gg AS (SELECT query_id, avg(score) FILTER (WHERE rank <= 3) AS st, avg(alive) AS al, avg(least(1.0, decay)) AS de, count(*) AS n FROM xx GROUP BY 1),
    cc AS (SELECT query_id, least(1.0, (st * 0.45 + 0.65 * 0.25 + al * 0.2 + least(1.0, n / 3.0) * 0.1) * de) AS score FROM gg)
    SELECT query_id, round(score, 4) AS score, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.45 THEN 'low' ELSE 'abstain' END AS label FROM cc""",
)
def confidence_labels(spark, sf_dir):
    records = inputs.records(spark, sf_dir).select(
        F.regexp_extract("source_unit_id", r"\d+", 0).cast("long").alias("doc_ord"), "status", "last_upsert_iso_ts", "deletion_mark_iso_ts"
    )
    found = _evidence(spark, sf_dir).drop("status", "last_upsert_iso_ts", "deletion_mark_iso_ts", "is_tabular")
    evidence = found.join(records, "doc_ord", "left")
    rows = evidence.withColumns(
        {
            "tier": t.extraction_tier(F.lit("text_parser")),
            "deleted": F.col("deletion_mark_iso_ts").isNotNull(),
            "ts": t.parse_ts("last_upsert_iso_ts"),
            "is_tabular": F.lit(False),
        }
    )
    found = answers.confidence(rows, inputs.SETTINGS, _now())
    return found.select("query_id", F.round("score", 4).alias("score"), "label")


def _cited(spark, sf_dir) -> DataFrame:
    """Citations of the evidence, spoiled in a few places so that reports have something to find."""
    bad = F.col("query_id") % 4
    found = answers.citations(_evidence(spark, sf_dir))
    return found.withColumn("title", F.when(bad == 0, " ").otherwise(F.col("title"))).withColumn(
        "document", F.when(bad == 1, "elsewhere").otherwise(F.col("document"))
    )


@query(
    "citation_fields",
    f"""WITH {_TOP} SELECT query_id, count(*) AS total, count(*) FILTER (WHERE query_id % 4 <> 0) AS valid, count(*) FILTER (WHERE query_id % 4 = 0) AS invalid,
    0::BIGINT AS missing_id, count(*) FILTER (WHERE query_id % 4 = 0) AS missing_title, 0::BIGINT AS missing_document, 0::BIGINT AS missing_snippet,
    0::BIGINT AS missing_score, 0::BIGINT AS missing_chunk_id, 0::BIGINT AS missing_doc_type,
    round(avg(CASE WHEN query_id % 4 = 0 THEN 0.0 ELSE 1.0 END), 4) AS completeness_rate FROM e GROUP BY 1""",
)
def citation_fields(spark, sf_dir):
    return provenance.validate_citations(_cited(spark, sf_dir), "query_id")


@query(
    "complete_citations",
    f"""WITH {_TOP} SELECT query_id, rank, chunk_id FROM e WHERE query_id % 4 > 1 AND length(text) >= 10 AND len({_TOKENS.format("substr(text, 1, 280)")}) >= 2""",
)
def complete_citations(spark, sf_dir):
    sources = inputs.index(spark, sf_dir).chunks.select("chunk_id", "source")
    return provenance.complete_citations(_cited(spark, sf_dir), sources).select("query_id", "rank", "chunk_id")


# --- evaluation --------------------------------------------------------------------------------

_SAMPLES = """(SELECT item_id AS query_id, list(doc_id) AS relevant FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"""


def _samples(spark, sf_dir) -> DataFrame:
    """Documents that hold each benchmark text; the benchmark is the stated query set."""
    phrases = inputs.queries(spark, sf_dir).withColumnRenamed("query", "phrase")
    pairs = evaluation.containing(inputs.documents(spark, sf_dir), phrases, "doc_ord", "query_id")
    held = pairs.groupBy("query_id").agg(F.collect_set("doc_ord").alias("relevant"))
    return inputs.queries(spark, sf_dir).select("query_id").join(held, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<bigint>")))


@query(
    "eval_metrics",
    f"""WITH {_TFIDF}, o AS (SELECT query_id, {_RANK}, doc_ord FROM tfidf), l AS {_SAMPLES},
    p AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE list_contains(relevant, doc_ord)) AS hits,
      min(rank) FILTER (WHERE list_contains(relevant, doc_ord)) AS first FROM o JOIN l USING (query_id) WHERE rank <= 5 GROUP BY 1),
    a AS (SELECT query_id, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, first FROM l LEFT JOIN p USING (query_id))
    SELECT count(*) AS sample_count, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate_at_k,
      round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr_at_k, round(avg(CAST(hits AS DOUBLE) / greatest(1, n)), 4) AS context_precision_at_k,
      round(avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS abstention_rate FROM a""",
)
def eval_metrics(spark, sf_dir):
    return evaluation.retrieval_metrics(_samples(spark, sf_dir), tfidf_topk(spark, sf_dir))


_FINE = f"length(text) >= 10 AND len({_TOKENS.format('substr(text, 1, 280)')}) >= 2"
_PROXY = "list_distinct(list_filter({0}, lambda x: length(x) >= 3 AND NOT list_contains({1}, x)))"


@query(
    "eval_report",
    f"""WITH {_TOP}, {_RECORDS}, l AS {_SAMPLES},
    sm AS (SELECT query_id, relevant, CASE query_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE '' END AS hope,
      lower(substr(text, 1, 12)) AS phrase FROM l JOIN benchmark ON item_id = query_id),
    p AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE list_contains(relevant, doc_ord)) AS hits,
      min(rank) FILTER (WHERE list_contains(relevant, doc_ord)) AS first, bool_or(contains(source, 'src3/')) AS bad, bool_and({_FINE}) AS fine,
      array_to_string(list(text ORDER BY rank) FILTER (WHERE rank <= 3 AND {_FINE.replace('substr(text, 1, 280)', 'text')}), chr(10)) AS answer,
      array_to_string(list(text), ' ') AS context FROM e JOIN l USING (query_id) GROUP BY 1),
    xx AS (SELECT query_id, rank, least(1.0, score) AS score, CASE WHEN status = 'retired' THEN 0.5 ELSE 1.0 END AS alive,
      CASE WHEN r.doc_id IS NULL THEN 1.0 ELSE greatest(0.35, 0.5 ** ((396 - days) / 365.0)) END AS decay FROM e LEFT JOIN r ON doc_id = doc_ord),
    gg AS (SELECT query_id, avg(score) FILTER (WHERE rank <= 3) AS st, avg(alive) AS al, avg(least(1.0, decay)) AS de, count(*) AS n FROM xx GROUP BY 1),
    cc AS (SELECT query_id, least(1.0, (st * 0.45 + 0.65 * 0.25 + al * 0.2 + least(1.0, n / 3.0) * 0.1) * de) AS score FROM gg),
    a AS (SELECT sm.*, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, first, bad, fine, coalesce(answer, 'cannot') AS answer, coalesce(context, '') AS context,
      CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.45 THEN 'low' ELSE 'abstain' END AS label FROM sm LEFT JOIN p USING (query_id) LEFT JOIN cc USING (query_id)),
    f AS (SELECT *, contains(lower(answer), 'cannot') OR contains(lower(answer), 'abstain') AS gone,
      {_PROXY.format(_TOKENS.format("answer"), list(t.PROXY_STOPWORDS))} AS said, {_PROXY.format(_TOKENS.format("context"), list(t.PROXY_STOPWORDS))} AS held FROM a)
    SELECT count(*) AS sample_count, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate_at_k,
      round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr_at_k, round(avg(CAST(hits AS DOUBLE) / greatest(1, n)), 4) AS context_precision_at_k,
      round(avg(CASE WHEN coalesce(fine, true) THEN 1.0::DOUBLE ELSE 0 END), 4) AS provenance_completeness,
      round(avg(CASE WHEN gone OR label = 'abstain' THEN 1.0::DOUBLE ELSE 0 END), 4) AS abstention_rate, 0.0::DOUBLE AS tabular_grounding_compliance,
      round(coalesce(avg(CASE WHEN hope = label THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE hope <> ''), 0), 4) AS confidence_alignment_rate,
      round(avg(CASE WHEN coalesce(bad, false) THEN 0.0::DOUBLE ELSE 1 END), 4) AS lifecycle_exclusion_compliance, 0.0::DOUBLE AS tabular_row_term_match_rate,
      0.0::DOUBLE AS tabular_answer_success_rate, 0.0::DOUBLE AS tabular_abstention_correctness,
      round(coalesce(avg(CAST(len(list_intersect(said, held)) AS DOUBLE) / len(said)) FILTER (WHERE NOT gone AND len(said) > 0 AND len(held) > 0), 0), 4) AS faithfulness_proxy,
      round(avg((CASE WHEN list_contains(said, 'license') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(answer), trim(phrase)) THEN 1 ELSE 0 END) / 2), 4) AS correctness_proxy
    FROM f""",
)
def eval_report(spark, sf_dir):
    asked = inputs.request(spark, sf_dir)
    samples = _samples(spark, sf_dir).join(inputs.queries(spark, sf_dir), "query_id").select(
        "query_id",
        F.transform("relevant", lambda i: F.concat(F.lit("/"), i.cast("string"), F.lit(".txt"))).alias("expected_sources"),
        F.array(F.lit("src3/")).alias("excluded_sources"),
        F.element_at(F.array(F.lit("high"), F.lit("low"), F.lit("")), (F.col("query_id") % 3 + 1).cast("int")).alias("expected_confidence"),
        F.array(F.lit("license")).alias("expected_answer_terms"),
        F.array(F.substring("query", 1, 12)).alias("expected_answer_contains"),
    )
    queries = asked.queries.withColumn("tabular", F.lit(False))
    found = _evidence(spark, sf_dir)
    records = inputs.document_records(spark, sf_dir).select("source_unit_id", *[F.col(c).alias(f"r_{c}") for c in ("status", "last_upsert_iso_ts")])
    governed = found.drop("status", "last_upsert_iso_ts").join(records, "source_unit_id", "left")
    governed = governed.withColumnsRenamed({"r_status": "status", "r_last_upsert_iso_ts": "last_upsert_iso_ts"})
    context, _ = answers.ground(queries, governed)
    cited = answers.citations(context)
    sound = provenance.validate_provenance(queries, context, cited, context.select("chunk_id", "source"))
    trust = service.trusted(queries, context, asked.settings, _now(), None)
    judged = evaluation.judge(samples, found, context, service.answered(queries, context, "extractive"), trust, sound)
    return evaluation.summarise(judged)


@query(
    "faithfulness_proxy",
    f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    x AS (SELECT conv_id, turn, list_distinct(list_filter({_TOKENS.format("text")}, lambda x: length(x) >= 3 AND NOT list_contains({list(t.PROXY_STOPWORDS)}, x))) AS a,
      list_distinct(list_filter({_TOKENS.format("before")}, lambda x: length(x) >= 3 AND NOT list_contains({list(t.PROXY_STOPWORDS)}, x))) AS b FROM p WHERE before IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a), 4) END AS faithfulness FROM x""",
)
def faithfulness_proxy(spark, sf_dir):
    """Every turn as an answer, the turn before it as its context."""
    turns = inputs.table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("before", before).where("before is not null")
    return rows.select("conv_id", "turn", F.round(evaluation.faithfulness("text", "before"), 4).alias("faithfulness"))


@query("fallback_match")
def fallback_match(spark, sf_dir):
    entries = [
        {"id": "first", "question_examples": ["the of and in"], "confidence_threshold": None},
        {"id": "generic_fallback", "question_examples": []},
    ]
    return evaluation.fallback_matches(inputs.queries(spark, sf_dir), entries)


# --- sources and streams -----------------------------------------------------------------------


@query("html_text")
def html_text(spark, sf_dir):
    files = inputs.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content")
    )
    return parsers.parse_files(files).select("source", "status", "text")


@query(
    "json_flatten",
    """WITH x AS (SELECT event_id, unnest(json_keys(props)) AS k, props, generate_subscripts(json_keys(props), 1) AS n FROM events)
    SELECT 'events/' || event_id || '.json' AS source, 'loaded' AS status, string_agg(k || ': ' || json_extract(props, '$."' || k || '"'), chr(10) ORDER BY n) AS text
    FROM x GROUP BY event_id""",
)
def json_flatten(spark, sf_dir):
    files = inputs.table(spark, sf_dir, "events").select(
        F.concat(F.lit("events/"), F.col("event_id"), F.lit(".json")).alias("path"), F.col("props").cast("binary").alias("content")
    )
    return parsers.parse_files(files).select("source", "status", "text")


@query(
    "ingestion_diagnostics",
    """SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 10 <> 0) AS loaded, count(*) FILTER (WHERE doc_id % 10 = 0) AS skipped,
    count(*) FILTER (WHERE doc_id % 10 = 0) AS unsupported, 0::BIGINT AS internal FROM documents""",
)
def ingestion_diagnostics(spark, sf_dir):
    suffix = F.when(F.col("doc_id") % 10 == 0, ".bin").otherwise(".txt")
    files = inputs.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("data/"), F.col("doc_id"), suffix).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )
    return parsers.diagnostics(parsers.parse_files(files)).select("total", "loaded", "skipped", "unsupported", "internal")


@query(
    "events_tumbling",
    """SELECT date_trunc('hour', ts) AS window_start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2""",
)
def events_tumbling(spark, sf_dir):
    return audit.tumbling(inputs.audit_events(spark, sf_dir))


@query(
    "events_sliding",
    """WITH x AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start, event_type FROM events)
    SELECT window_start, event_type AS action, count(*) AS n FROM x GROUP BY 1, 2""",
)
def events_sliding(spark, sf_dir):
    return audit.sliding(inputs.audit_events(spark, sf_dir))


@query(
    "events_sessions",
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    y AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
    SELECT 'unit-' || user_id AS source_unit_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, s""",
)
def events_sessions(spark, sf_dir):
    return audit.sessions(inputs.audit_events(spark, sf_dir))
