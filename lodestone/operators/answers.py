"""Ranked evidence to answers: row grounding, extractive text, provenance, confidence.

All operators work on a table of many queries at once.  Evidence rows carry query_id and rank; an answer
looks at a fixed number of its query's rows, so what is gathered for a query is bounded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import text as t

#: Answers without evidence, by reason.
ABSTENTIONS = {
    "tabular_row_evidence_missing": (
        "I cannot provide a row-grounded tabular answer because no matching table rows were retrieved."
    ),
    "no_supporting_evidence": "I cannot answer confidently because no supporting evidence was retrieved.",
    "usable_evidence_missing": "I cannot answer confidently because retrieved evidence had no usable content.",
}
#: Fields that a citation must have.
CITATION_FIELDS = ["id", "title", "document", "snippet", "score", "chunk_id", "doc_type"]


def ground_rows(evidence: DataFrame, least: int = 1) -> DataFrame:
    """Table rows that share ``least`` terms with the query, header terms counted for every row.

    ``evidence`` has query and text; adds matched_rows (array of row_text and matched_terms), matched_row_count,
    matched_terms and tabular_grounded.
    """
    own = lambda found: F.struct(t.tokens(F.get(found, F.lit(0))).alias("header"), t.grounding_terms("query").alias("terms"))

    def matched(found, known):
        def match(row):
            here = F.array_union(t.tokens(row), known["header"])
            return F.struct(row.alias("row_text"), F.array_sort(F.array_intersect(here, known["terms"])).alias("matched_terms"))

        return F.filter(F.transform(F.slice(found, 2, 1 << 30), match), lambda r: F.size(r["matched_terms"]) >= max(1, least))

    # Lines, header and terms are bound once for all rows of a text, else every row would cut the whole text again.
    rows = t.bound(t.lines("text"), lambda found: t.bound(own(found), lambda known: matched(found, known)))
    out = evidence.withColumn("matched_rows", F.coalesce(rows, F.array().cast(_ROWS)))
    return out.withColumns(
        {
            "matched_row_count": F.size("matched_rows"),
            "matched_terms": F.array_sort(F.array_distinct(F.flatten(F.transform("matched_rows", lambda r: r["matched_terms"])))),
            "tabular_grounded": F.size("matched_rows") > 0,
        }
    )


_ROWS = "array<struct<row_text:string,matched_terms:array<string>>>"


def ground(queries: DataFrame, evidence: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(context, trace): evidence that answers may rest on, and one row of trace for each query.

    ``queries`` is (query_id, query, tabular), ``evidence`` has is_tabular.  A query without tabular intent keeps
    all of its evidence; one with it keeps the table chunks that a row of theirs grounds.
    """
    rows = evidence.join(queries.select("query_id", "query", "tabular"), "query_id")
    judged = ground_rows(rows, least).withColumn(
        "tabular_grounded", F.col("tabular") & F.coalesce("is_tabular", F.lit(False)) & F.col("tabular_grounded")
    )
    found = judged.groupBy("query_id").agg(
        F.count("*").alias("candidates"),
        F.count_if("tabular_grounded").alias("matched_chunks"),
        F.sum(F.when(F.col("tabular_grounded"), F.col("matched_row_count")).otherwise(0)).alias("matched_rows"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    no_terms = F.size(t.grounding_terms("query")) == 0
    trace = queries.join(found, "query_id", "left").select(
        "query_id",
        F.col("tabular").alias("tabular_intent"),
        zero("candidates"),
        zero("matched_chunks"),
        zero("matched_rows"),
        F.when(F.col("tabular") & no_terms, "no_query_terms")
        .when(F.col("tabular") & (F.coalesce("matched_chunks", F.lit(0)) == 0), "no_matched_rows")
        .alias("reason"),
    )
    return judged.where(~F.col("tabular") | F.col("tabular_grounded")).drop("query", "tabular"), trace


def citable(text: Column | str) -> Column:
    body = t.strip(text)
    return (F.length(body) >= 10) & (F.size(t.tokens(body)) >= 2)


def extractive_answers(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per query: answer, abstained, reason_code, cited_chunk_ids, used_context_count."""
    usable = evidence.where(citable("text")).withColumn(
        "nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    )
    used = (
        usable.where("nth <= 3")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "text", "chunk_id"))).alias("used"))
    )
    held = evidence.groupBy("query_id").agg(F.count("*").alias("held"))
    out = queries.select("query_id").join(held, "query_id", "left").join(used, "query_id", "left")
    reason = F.when(F.col("held").isNull(), "no_supporting_evidence").when(F.col("used").isNull(), "usable_evidence_missing")
    text = F.array_join(F.transform("used", lambda u: t.strip(u["text"])), "\n")
    return _answer(out, reason, text)


def tabular_answers(queries: DataFrame, grounded: DataFrame) -> DataFrame:
    """As ``extractive_answers``, from the first three matched rows; cites the first three chunks with any."""
    with_rows = grounded.where(F.col("is_tabular") & F.col("tabular_grounded")).withColumn(
        "nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    )
    used = (
        with_rows.where("nth <= 3")
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("nth", F.slice(F.transform("matched_rows", lambda r: r["row_text"]), 1, 3).alias("rows"), "chunk_id"))
            ).alias("used")
        )
    )
    out = queries.select("query_id").join(used, "query_id", "left")
    reason = F.when(F.col("used").isNull(), "tabular_row_evidence_missing")
    rows = F.slice(F.flatten(F.transform("used", lambda u: u["rows"])), 1, 3)
    return _answer(out, reason, F.array_join(rows, "\n"))


def _answer(out: DataFrame, reason: Column, text: Column) -> DataFrame:
    said = F.create_map(*[F.lit(x) for pair in ABSTENTIONS.items() for x in pair])
    ids = F.array_distinct(F.filter(F.transform("used", lambda u: u["chunk_id"]), lambda i: t.strip(i) != ""))
    return out.withColumn("reason_code", reason).select(
        "query_id",
        F.coalesce(F.try_element_at(said, F.col("reason_code")), text).alias("answer"),
        F.col("reason_code").isNotNull().alias("abstained"),
        "reason_code",
        F.coalesce(ids, F.array().cast("array<string>")).alias("cited_chunk_ids"),
        F.when(F.col("reason_code").isNull(), F.size("used")).otherwise(0).alias("used_context_count"),
    )


def citations(evidence: DataFrame) -> DataFrame:
    """Citation rows of evidence: id, title, document, snippet, score, chunk_id, doc_type beside query_id and rank,
    and what a grounded table chunk matched where the evidence has it."""
    given = t.strip(F.coalesce("chunk_id", F.lit("")))
    grounded = [c for c in ("tabular_grounded", "matched_row_count", "matched_terms") if c in evidence.columns]
    return evidence.select(
        *grounded,
        "query_id",
        "rank",
        F.when(given != "", given).otherwise(F.concat(F.lit("chunk-"), F.col("rank"))).alias("id"),
        t.basename("source").alias("title"),
        F.col("source").alias("document"),
        F.substring("text", 1, 280).alias("snippet"),
        "score",
        "chunk_id",
        "doc_type",
    )


def quality_failures(cited: DataFrame, sources: DataFrame | None = None, fields_first: bool = True) -> DataFrame:
    """Adds ``failures``: missing_fields, snippet_adequacy, source_traceability, duplicate_policy.

    ``fields_first`` judges citations that lack a field by that alone; otherwise fields are no matter.

    ``sources`` (chunk_id, source) makes citations traceable.  A repeat of (chunk, document) fails whether or not
    the first one passed.
    """
    blank = lambda c: F.coalesce(t.strip(F.col(c).cast("string")), F.lit("")) == ""
    missing = F.lit(False)
    for c in CITATION_FIELDS if fields_first else ():
        missing = missing | blank(c)
    document = F.lower(t.collapse(F.coalesce("document", F.lit(""))))
    out = cited.withColumns({"__missing": missing, "__doc": document})
    order = Window.partitionBy("query_id", "chunk_id", "__doc", "__missing").orderBy("rank")
    out = out.withColumn("__nth", F.row_number().over(order))
    snippet = t.strip(F.coalesce("snippet", F.lit("")))
    weak = (F.length(snippet) < 10) | (F.size(t.tokens(snippet)) < 2)
    untraced = F.lit(False)
    if sources is not None:
        first = sources.groupBy(F.col("chunk_id").alias("__id")).agg(F.min("source").alias("__source"))
        out = out.join(first, out["chunk_id"] == first["__id"], "left")
        untraced = F.col("__source").isNull() | (t.strip("__source") != t.strip("document"))
    named = [
        ("missing_fields", F.col("__missing")),
        ("snippet_adequacy", ~F.col("__missing") & weak),
        ("source_traceability", ~F.col("__missing") & untraced),
        ("duplicate_policy", ~F.col("__missing") & ~blank("chunk_id") & (F.col("__doc") != "") & (F.col("__nth") > 1)),
    ]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))
    return out.withColumn("failures", failed).select(*cited.columns, "failures")


def provenance(judged: DataFrame) -> DataFrame:
    """Per query: citations, complete ones, failures by kind, completeness at four places."""
    kinds = ["missing_fields", "snippet_adequacy", "source_traceability", "duplicate_policy"]
    return judged.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.size("failures") == 0).alias("complete"),
        *[F.count_if(F.array_contains("failures", k)).alias(k) for k in kinds],
        F.round(F.avg(F.when(F.size("failures") == 0, 1.0).otherwise(0.0)), 4).alias("completeness"),
    )


def split_citations(cited: DataFrame) -> DataFrame:
    """Adds ``visible``: the first three; if there are no others, those of them that score below 0.5 collapse."""
    more = F.max("rank").over(Window.partitionBy("query_id")) > 3
    return cited.withColumn("visible", (F.col("rank") <= 3) & (more | (F.col("score") >= 0.5)))


def query_intents(queries: DataFrame, thesaurus: dict | None = None) -> DataFrame:
    """(query_id, intents): names of the intent groups that share a token with the query."""
    found = F.array().cast("array<string>")
    for name, values in ((thesaurus or {}).get("intent_groups") or {}).items():
        label = str(name).strip().lower()
        terms = sorted({x.lower() for v in (values if isinstance(values, list) else []) for x in re.findall(t.TOKEN, str(v))})
        if label and terms:
            hit = F.arrays_overlap(t.tokens("query"), F.array(*map(F.lit, terms)))
            found = F.when(hit, F.array_union(found, F.array(F.lit(label)))).otherwise(found)
    return queries.select("query_id", found.alias("intents"))


#: Weights of retrieval, extraction, lifecycle and coverage in the confidence, and its thresholds.
SHARES, HIGH, LOW = (0.45, 0.25, 0.20, 0.10), 0.72, 0.45


#: Weights of extraction tiers and of lifecycle statuses, each with that of all others.
TIER_WEIGHTS, OTHER_TIER = {"structured": 1.0, "document": 0.8, "plain": 0.65}, 0.6
STATUS_WEIGHTS, OTHER_STATUS = {"": 1.0, "active": 1.0, "pending_review": 0.5, "retired": 0.5}, 0.7


def _weight(value: Column, weights: dict[str, float], other: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(other))


def normalised_label(label: Column | str) -> Column:
    """``high``, ``low`` or ``abstain``; whatever else there is abstains."""
    found = F.lower(t.strip(F.col(label) if isinstance(label, str) else label))
    return F.when(found.isin("high", "low"), found).otherwise("abstain")


def confidence(
    evidence: DataFrame, settings: Settings, now: Column, intents: DataFrame | None = None, queries: DataFrame | None = None
) -> DataFrame:
    """(query_id, score, label, reason) from the first rows of each query's evidence.

    ``evidence`` has rank, score, tier, status, deleted, ts, is_tabular, doc_type; ``intents`` is (query_id, intents),
    an array in which ``tabular`` stands for the intent that needs table evidence.  Queries without evidence
    abstain; they have a row if ``queries`` names them.
    """
    tier = _weight(F.col("tier"), TIER_WEIGHTS, OTHER_TIER)
    state = F.lower(t.strip(F.coalesce("status", F.lit(""))))
    gone = F.col("deleted") | (state == "soft_deleted")
    alive = F.when(gone, 0.0).otherwise(_weight(state, STATUS_WEIGHTS, OTHER_STATUS))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 86400)
    floor = max(0.0, min(1.0, settings.confidence_decay_floor))
    half = max(1.0, settings.confidence_half_life_days)
    decay = F.when(F.col("ts").isNull(), 1.0).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half)))
    top = F.col("rank") <= 5
    out = evidence.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("rank") <= 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))).alias("strength"),
        F.avg(F.when(top, tier)).alias("extraction"),
        F.avg(F.when(top, alive)).alias("lifecycle"),
        F.avg(F.when(top, decay)).alias("decay"),
        F.max("is_tabular").alias("any_table"),
        F.max(top & F.col("is_tabular")).alias("top_table"),
        F.collect_set(F.when(top, F.lower("doc_type"))).alias("types"),  # of five rows at most
    )
    out = out.withColumn("intents", F.array().cast("array<string>")) if intents is None else out.join(
        intents, "query_id", "left"
    ).withColumn("intents", F.coalesce("intents", F.array().cast("array<string>")))
    score = (
        F.col("strength") * SHARES[0]
        + F.col("extraction") * SHARES[1]
        + F.col("lifecycle") * SHARES[2]
        + F.least(F.lit(1.0), F.col("n") / 3) * SHARES[3]
    )
    if settings.confidence_temporal_decay_enabled:
        score = score * F.col("decay")
    wanted = F.size("intents")
    if settings.confidence_intent_adjustment_enabled:
        met = F.size(
            F.filter("intents", lambda i: F.when(i == "tabular", F.col("top_table")).otherwise(F.array_contains("types", i)))
        )
        low = max(0.0, min(1.0, settings.confidence_intent_floor))
        lost = F.greatest(F.lit(low), 1 - max(0.0, settings.confidence_intent_mismatch_penalty) * (wanted - met) / wanted)
        factor = (1 + max(0.0, settings.confidence_intent_match_boost) * met / wanted) * F.when(met < wanted, lost).otherwise(1.0)
        score = score * F.when(wanted > 0, F.greatest(F.lit(low), F.least(F.lit(1.5), factor))).otherwise(1.0)
    no_table = F.array_contains("intents", "tabular") & ~F.col("any_table")
    score = F.when(no_table, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    judged = out.withColumn("score", score).select(
        "query_id",
        "score",
        F.when(no_table, "abstain").when(F.col("score") >= HIGH, "high").when(F.col("score") >= LOW, "low").otherwise("abstain").alias("label"),
        F.when(no_table, "tabular_evidence_missing")
        .when(F.col("score") >= HIGH, "strong_grounded_evidence")
        .when(F.col("score") >= LOW, "limited_or_mixed_evidence")
        .otherwise("insufficient_evidence_quality")
        .alias("reason"),
    )
    if queries is None:
        return judged
    return queries.select("query_id").join(judged, "query_id", "left").select(
        "query_id",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("label", F.lit("abstain")).alias("label"),
        F.coalesce("reason", F.lit("no_evidence")).alias("reason"),
    )


def fixed_answers(queries: DataFrame, evidence: DataFrame, mode: str) -> DataFrame:
    """Answers of the modes ``mock`` (echoes the query, cites the first three) and ``live`` (no provider connected)."""
    used = evidence.where("rank <= 3").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("used")
    )
    out = queries.select("query_id", "query").join(used, "query_id", "left")
    none = F.array().cast("array<string>")
    ids = F.array_distinct(F.transform("used", lambda u: u["chunk_id"]))
    if mode == "live":
        said, reason, cited, n = F.lit(LIVE_UNCONFIGURED), F.lit("live_adapter_unconfigured"), none, F.lit(0)
    else:
        said = F.concat(F.lit("[mock] received query: "), F.col("query"))
        reason, cited, n = F.lit(None).cast("string"), F.coalesce(ids, none), F.coalesce(F.size("used"), F.lit(0))
    return out.select(
        "query_id",
        said.alias("answer"),
        F.lit(False).alias("abstained"),
        reason.alias("reason_code"),
        cited.alias("cited_chunk_ids"),
        F.greatest(n, F.lit(0)).alias("used_context_count"),
    )


#: The answer while no provider is connected.
LIVE_UNCONFIGURED = (
    "Live generation mode is enabled, but no provider adapter is configured yet. "
    "Connect a provider-specific implementation for production inference."
)


def used_citations(evidence: DataFrame, answered: DataFrame) -> DataFrame:
    """Evidence that an answer cites, the first row of each chunk, in rank order."""
    cited = answered.select("query_id", F.explode("cited_chunk_ids").alias("chunk_id"))
    order = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    first = evidence.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return first.join(cited, ["query_id", "chunk_id"], "left_semi")


def envelopes(queries: DataFrame, answered: DataFrame, cited: DataFrame, trust: DataFrame) -> DataFrame:
    """One JSON object per query: contract_version, message, answer, abstained, confidence, citations,
    collapsed_citations."""
    shown = split_citations(cited)
    fields = F.struct("rank", *CITATION_FIELDS)
    listed = shown.groupBy("query_id").agg(  # at most top_k rows of a query
        F.array_sort(F.collect_list(F.when(F.col("visible"), fields))).alias("citations"),
        F.array_sort(F.collect_list(F.when(~F.col("visible"), fields))).alias("collapsed_citations"),
    )
    rows = (
        queries.select("query_id", "query")
        .join(answered, "query_id")
        .join(listed, "query_id", "left")
        .join(trust.select("query_id", F.col("label").alias("confidence"), F.col("score").alias("confidence_score")), "query_id", "left")
    )
    shown_n = F.when(F.col("citations").isNotNull(), F.size("citations"))
    hidden_n = F.when(F.col("collapsed_citations").isNotNull(), F.size("collapsed_citations"))
    return rows.select(
        "query_id",
        F.to_json(
            F.struct(
                F.lit("1.0").alias("contract_version"),
                F.struct(
                    F.col("answer").alias("text"),
                    F.struct(
                        F.coalesce(shown_n, F.lit(0)).alias("count"),
                        (F.coalesce(shown_n, F.lit(0)) + F.coalesce(hidden_n, F.lit(0))).alias("total_count"),
                        F.coalesce(hidden_n, F.lit(0)).alias("hidden_count"),
                        F.when(F.coalesce(shown_n, F.lit(0)) + F.coalesce(hidden_n, F.lit(0)) > 0, "citations available")
                        .otherwise("no citations")
                        .alias("label"),
                    ).alias("citations_summary"),
                    F.struct("abstained", "reason_code", "used_context_count", "cited_chunk_ids").alias("generation"),
                ).alias("message"),
                "query",
                "answer",
                "abstained",
                "reason_code",
                F.when(F.col("abstained"), "abstain").otherwise(F.coalesce("confidence", F.lit("abstain"))).alias("confidence"),
                F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
                "citations",
                "collapsed_citations",
            )
        ).alias("envelope"),
    )
