"""Offline evaluation of retrieval and answers, corpus duplicates, and fallbacks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import text as t
from lodestone.operators.retrieval import small


#: Blank-separated words from which on a phrase has two whole words in its inside.
ANCHORED_WORDS = 4


def _pairs(words: str) -> Column:
    """Neighbouring words of an array column."""
    n = F.size(words) - 1
    zipped = F.arrays_zip(F.slice(words, 1, F.greatest(n, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(n, F.lit(0))).alias("b"))
    return F.explode(zipped)


def containing(texts: DataFrame, phrases: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(key, id) of every phrase (key, phrase) and every text (id, text) that holds it as a substring.

    A text that holds a phrase holds the words inside the phrase as whole words.  So each phrase is anchored
    on its pair of inner words that the fewest texts have; pairs are looked up by equality while the texts
    are read, and only texts with a phrase's anchor are searched for it.  Phrases of fewer than
    ``ANCHORED_WORDS`` words have no such pair and go to the texts in a nested loop of their own.
    Null texts and phrases hold nothing; an empty phrase is in every text.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col(id_col).alias("id"), "text").where("text is not null")
    asked = phrases.select(F.col(key_col).alias("key"), "phrase").where("phrase is not null").withColumn("words", F.split("phrase", r"\s+"))
    long = F.size("words") >= ANCHORED_WORDS
    unit = F.concat_ws(" ", "pair.a", "pair.b").alias("unit")
    inner = asked.where(long).select("key", F.slice("words", F.lit(2), F.size("words") - 2).alias("words"))
    units = inner.select("key", _pairs("words").alias("pair")).select("key", unit).distinct()
    wanted = units.select("unit").distinct()
    held = lambda df: F.broadcast(df) if small(df) else df
    out = storage.new_folder(spark, "phrases")
    with storage.scratch(spark, "anchors") as folder:
        words = texts.select("id", F.split("text", r"\s+").alias("words"))
        hits = words.select("id", _pairs("words").alias("pair")).select("id", unit).join(held(wanted), "unit", "left_semi").distinct()
        hits = storage.written(hits, f"{folder}/hits")
        often = hits.groupBy("unit").agg(F.count("*").alias("n"))
        # A phrase with a pair that no text has is nowhere.
        known = units.join(often, "unit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        anchors = known.groupBy("key").agg(F.min(F.struct("n", "unit")).alias("least")).where("least.n > 0").select("key", "least.unit")
        anchors = storage.written(anchors, f"{folder}/anchors")
        likely = storage.written(hits.join(held(anchors), "unit").select("id", "key"), f"{folder}/likely")
        asked = asked.select("key", "phrase", long.alias("long"))
        found = texts.join(held(likely), "id").join(held(asked.where("long")), "key").where(F.contains("text", "phrase"))
        short = asked.where("not long")
        looped = texts.join(F.broadcast(short) if small(short) else short.hint("shuffle_replicate_nl"), F.contains("text", "phrase"))
        pairs = found.select("key", "id")
        if not short.isEmpty():
            pairs = pairs.unionByName(looped.select("key", "id"))
        return storage.written(pairs, out).toDF(key_col, id_col)


def retrieval_metrics(samples: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: sample_count, hit_rate_at_k, mrr_at_k, context_precision_at_k, abstention_rate.

    ``samples`` is (query_id, relevant), an array of doc_ord; ``ranked`` has query_id, rank, doc_ord.
    """
    judged = ranked.join(samples, "query_id").withColumn("hit", F.array_contains("relevant", F.col("doc_ord")))
    per = judged.groupBy("query_id").agg(
        F.count("*").alias("retrieved"),
        F.count_if("hit").alias("hits"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
    )
    rows = samples.select("query_id").join(per, "query_id", "left").fillna(0, ["retrieved", "hits"])
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(n)
    return rows.agg(
        F.count("*").alias("sample_count"),
        mean(F.when(F.col("hits") > 0, 1.0).otherwise(0.0), "hit_rate_at_k"),
        mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr_at_k"),
        mean(F.col("hits") / F.greatest(F.lit(1), "retrieved"), "context_precision_at_k"),
        mean(F.when(F.col("retrieved") == 0, 1.0).otherwise(0.0), "abstention_rate"),
    )


def abstains(answer: Column | str) -> Column:
    """Whether an answer's words abstain, as the metrics read it."""
    said = F.lower(F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit("")))
    return F.contains(said, F.lit("cannot")) | F.contains(said, F.lit("abstain"))


def relevant(source: Column, chunk_id: Column, sources: Column, chunk_ids: Column) -> Column:
    """Whether a chunk is one that was expected: an expected source is part of its source, or its id is listed."""
    none = F.array().cast("array<string>")
    named = F.exists(F.coalesce(sources, none), lambda s: F.contains(source, s))
    return F.coalesce(named | F.array_contains(F.coalesce(chunk_ids, none), chunk_id), F.lit(False))


#: Columns of an evaluation sample beside query_id and query, with their types; any may be absent.
EXPECTATIONS = {
    "expected_sources": "array<string>",
    "excluded_sources": "array<string>",
    "relevant_chunk_ids": "array<string>",
    "expected_tabular_terms": "array<string>",
    "expected_answer_terms": "array<string>",
    "expected_answer_contains": "array<string>",
    "expected_confidence": "string",
    "expected_tabular_outcome": "string",
    "is_tabular_intent": "boolean",
}


def judge(samples: DataFrame, retrieved: DataFrame, context: DataFrame, answered: DataFrame, trust: DataFrame, sound: DataFrame) -> DataFrame:
    """One row per sample with everything the metrics are made of; what does not apply to a sample is null.

    ``samples`` has query_id and any of ``EXPECTATIONS``; ``retrieved`` the ranked chunks, ``context`` those that
    answers rest on (with tabular_grounded and matched_terms), ``answered`` the answers, ``trust`` the
    confidence labels, ``sound`` whether provenance is complete.
    """
    absent = {n: F.lit(None).cast(k) for n, k in EXPECTATIONS.items() if n not in samples.columns}
    samples = samples.withColumns(absent) if absent else samples
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), t.strip), lambda x: x != "")
    lowered = lambda c: F.array_distinct(F.transform(clean(F.col(c)), F.lower))
    expected = samples.select("query_id", "expected_sources", "relevant_chunk_ids", clean(F.col("excluded_sources")).alias("excluded"))
    hit = relevant(F.col("source"), F.col("chunk_id"), F.col("expected_sources"), F.col("relevant_chunk_ids"))
    found = retrieved.select("query_id", "rank", "source", "chunk_id").join(expected, "query_id").withColumn("hit", hit)
    found = found.groupBy("query_id").agg(
        F.count("*").alias("retrieved"),
        F.count_if("hit").alias("hits"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.max(F.exists("excluded", lambda s: F.contains(F.col("source"), s))).alias("violated"),
    )
    grounded = F.coalesce("tabular_grounded", F.lit(False)) if "tabular_grounded" in context.columns else F.lit(False)
    matched = F.when(grounded, F.col("matched_terms")) if "matched_terms" in context.columns else F.lit(None).cast("array<string>")
    held = context.groupBy("query_id").agg(  # a query's context is bounded by top_k
        F.max(grounded).alias("grounded"),
        F.array_distinct(F.flatten(F.collect_list(matched))).alias("observed"),
        F.array_distinct(F.flatten(F.collect_list(t.proxy_terms("text")))).alias("context_terms"),
    )
    rows = samples
    for part in (found, held, answered.select("query_id", "answer"), trust.select("query_id", "label"), sound.select("query_id", "complete")):
        rows = rows.join(part, "query_id", "left")
    gone = abstains("answer")
    terms = t.proxy_terms("answer")
    outcome = F.lower(t.strip(F.coalesce("expected_tabular_outcome", F.lit(""))))
    label = F.lower(t.strip(F.coalesce("expected_confidence", F.lit(""))))
    truth = lambda c: c.cast("double")
    n = F.coalesce("retrieved", F.lit(0))
    is_grounded = F.coalesce("grounded", F.lit(False))
    return rows.select(
        "query_id",
        truth(F.coalesce("hits", F.lit(0)) > 0).alias("hit_rate_at_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_at_k"),
        (F.coalesce("hits", F.lit(0)) / F.greatest(F.lit(1), n)).alias("context_precision_at_k"),
        truth(F.coalesce("complete", F.lit(True))).alias("provenance_completeness"),
        truth((F.coalesce("label", F.lit("abstain")) == "abstain") | gone).alias("abstention_rate"),
        F.when(F.col("is_tabular_intent"), truth(is_grounded | gone)).alias("tabular_grounding_compliance"),
        F.when(label != "", truth(label == F.lower(t.strip("label")))).alias("confidence_alignment_rate"),
        F.when(F.size(clean(F.col("excluded_sources"))) > 0, truth(~F.coalesce("violated", F.lit(False)))).alias("lifecycle_exclusion_compliance"),
        F.when(
            F.size(lowered("expected_tabular_terms")) > 0,
            truth(F.coalesce(F.arrays_overlap(lowered("expected_tabular_terms"), F.coalesce("observed", F.array().cast("array<string>"))), F.lit(False))),
        ).alias("tabular_row_term_match_rate"),
        F.when(outcome == "answer", truth(is_grounded & ~gone)).alias("tabular_answer_success_rate"),
        F.when(outcome == "abstain", truth(gone)).alias("tabular_abstention_correctness"),
        F.when(
            ~gone & (F.size("context_terms") > 0), F.try_divide(F.size(F.array_intersect(terms, F.col("context_terms"))), F.size(terms))
        ).alias("faithfulness_proxy"),
        correctness("answer", lowered("expected_answer_terms"), clean(F.col("expected_answer_contains"))).alias("correctness_proxy"),
    )


METRICS = (
    "hit_rate_at_k", "mrr_at_k", "context_precision_at_k", "provenance_completeness", "abstention_rate",
    "tabular_grounding_compliance", "confidence_alignment_rate", "lifecycle_exclusion_compliance", "tabular_row_term_match_rate",
    "tabular_answer_success_rate", "tabular_abstention_correctness", "faithfulness_proxy", "correctness_proxy",
)


def summarise(judged: DataFrame) -> DataFrame:
    """One row: sample_count and every metric, the mean over the samples that it applies to, 0 without any."""
    return judged.agg(
        F.count("*").alias("sample_count"),
        *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in METRICS],
    )


def faithfulness(answer: Column | str, context: Column | str) -> Column:
    """Share of an answer's terms that its context holds; null for answers without terms."""
    terms = t.proxy_terms(answer)
    return F.try_divide(F.size(F.array_intersect(terms, t.proxy_terms(context))), F.size(terms))


def correctness(answer: Column | str, terms: Column, phrases: Column) -> Column:
    """Share of expected terms and phrases found in an answer; null without expectations."""
    held = t.proxy_terms(answer)
    low = F.lower(F.col(answer) if isinstance(answer, str) else answer)
    found = F.size(F.array_intersect(terms, held)) + F.size(F.filter(phrases, lambda p: F.contains(low, F.lower(p))))
    return F.try_divide(found, F.size(terms) + F.size(phrases))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(fingerprint, occurrences, first_ord) of contents that occur more than once, blanks aside."""
    rows = docs.select("doc_ord", t.collapse("text").alias("text")).where("text <> ''")
    found = rows.groupBy(t.fingerprint("text").alias("fingerprint"))
    return found.agg(F.count("*").alias("occurrences"), F.min("doc_ord").alias("first_ord")).where("occurrences > 1")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(fingerprint, occurrences) of lines of four words or more that occur more than twice."""
    rows = docs.select(F.explode(t.lines("text")).alias("line")).select(t.collapse("line").alias("line"))
    rows = rows.where(F.size(t.words("line")) >= 4)
    found = rows.groupBy(t.fingerprint("line").alias("fingerprint")).agg(F.count("*").alias("occurrences"))
    return found.where("occurrences > 2")


def most_frequent(found: DataFrame, n: int = 20) -> DataFrame:
    """The first groups by occurrences, for a report."""
    return found.orderBy(F.desc("occurrences"), "fingerprint").limit(n)


#: Fields of a sample that are lists of strings, and those that are one string.
_LISTS = [n for n, k in EXPECTATIONS.items() if k == "array<string>"]
_STRINGS = [n for n, k in EXPECTATIONS.items() if k == "string"]
_YES, _NO = {"true", "1", "yes", "y"}, {"false", "0", "no", "n"}


def read_sample(line: str) -> tuple[dict | None, list[tuple[str, str]]]:
    """(sample, issues as (code, detail)) of one line of an evaluation set; no sample without a usable query."""
    if not line.strip():
        return None, []
    try:
        row = json.loads(line)
    except ValueError as error:
        return None, [("invalid_json", str(error))]
    if not isinstance(row, dict):
        return None, [("invalid_row_shape", "a JSON object is expected")]
    issues, out = [], {"id": None if row.get("id") is None else str(row["id"])}
    query = row.get("query")
    usable = isinstance(query, str) and bool(query.strip())
    if not usable:
        issues.append(("missing_query", "query must be a string that is not blank"))
    for name in _LISTS:
        value = row.get(name)
        value = [value] if isinstance(value, str) else [] if value is None else value
        if not isinstance(value, list):
            issues.append(("invalid_field_type", f"{name} must be a string or a list of strings"))
            value = []
        issues += [("invalid_field_item_type", f"{name}[{i}] must be a string") for i, x in enumerate(value) if not isinstance(x, str)]
        out[name] = [x for x in value if isinstance(x, str) and x.strip()]
    for name in _STRINGS:
        value = row.get(name)
        if value is not None and not isinstance(value, str):
            issues.append(("invalid_field_type", f"{name} must be a string"))
        out[name] = value if isinstance(value, str) else None
    flag = row.get("is_tabular_intent")
    word = flag.strip().lower() if isinstance(flag, str) else None
    if not (flag is None or isinstance(flag, bool) or word in _YES | _NO):
        issues.append(("invalid_field_type", "is_tabular_intent must be true or false"))
    out["is_tabular_intent"] = flag is True or word in _YES
    return ({"query": query.strip()} | out if usable else None), issues


def validate_sample(line: str) -> list[str]:
    """Issue codes of one line of an evaluation set."""
    return [code for code, _ in read_sample(line)[1]]


_READ = (
    "dataset string, line long, query string, id string, "
    + ", ".join(f"{n} {k}" for n, k in EXPECTATIONS.items())
    + ", issues array<struct<code:string,detail:string>>"
)


def read_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line that is not blank of some JSONL files with its place; ``query`` is null for lines without a
    sample.  A file that is not there is one row with the issue ``missing_dataset``."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _READ.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                for number, line in enumerate(bytes(content).decode("utf-8", "replace").splitlines(), 1):
                    if line.strip():
                        sample, issues = read_sample(line)
                        rows.append({"dataset": path, "line": number, "issues": [{"code": c, "detail": d} for c, d in issues]} | (sample or {}))
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    there = [p for p in paths if storage.exists(spark, p)]
    absent = [(p, 0, [{"code": "missing_dataset", "detail": "no such file"}]) for p in paths if p not in there]
    out = spark.createDataFrame(absent, "dataset string, line long, issues array<struct<code:string,detail:string>>")
    found = [spark.read.format("binaryFile").load(p).select(F.lit(p).alias("path"), "content") for p in there]
    if found:
        files = reduce(DataFrame.unionByName, found)
        out = files.mapInPandas(lines, _READ).unionByName(out, allowMissingColumns=True)
    else:
        out = spark.createDataFrame([], _READ).unionByName(out, allowMissingColumns=True)
    return out.withColumn("query_id", F.concat_ws(":", "dataset", F.col("line").cast("string")))


def dataset_sanity(lines: DataFrame) -> DataFrame:
    """Per dataset, and for all together (dataset null): lines that are not blank, valid and invalid ones, parse errors."""
    codes = lines.withColumn("codes", F.transform("issues", lambda x: x["code"]))
    broken = F.arrays_overlap("codes", F.array(F.lit("invalid_json"), F.lit("invalid_row_shape")))
    here = F.col("line") > 0
    counted = codes.groupBy("dataset").agg(
        F.count_if(here).alias("nonempty_lines"),
        F.count_if(F.col("query").isNotNull()).alias("valid_rows"),
        F.count_if(here & F.col("query").isNull()).alias("invalid_rows"),
        F.count_if(broken).alias("parse_errors"),
    )
    names = [c for c in counted.columns if c != "dataset"]
    whole = counted.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return counted.unionByName(whole.select(F.lit(None).cast("string").alias("dataset"), *names))


def issue_preview(lines: DataFrame, n: int = 20) -> DataFrame:
    """The first issues: dataset, line, code, detail."""
    return lines.select("dataset", "line", F.posexplode("issues").alias("nth", "i")).orderBy("dataset", "line", "nth").limit(n).select(
        "dataset", "line", "i.code", "i.detail"
    )


def choose_fallback(
    text: str, entries: list[dict], confidence: float | None = None, faq: dict[str, str] | None = None, least: float = 0.6
) -> dict | None:
    """An explicit answer, else the entry with the likest example if it is like enough and the retrieval
    confidence does not exceed its threshold, else the entry ``generic_fallback``, else nothing."""
    asked = text.lower().strip()
    by_id = {e.get("id"): e for e in reversed(entries)}
    if (named := by_id.get((faq or {}).get(asked))) is not None:
        return named
    best, score = None, 0.0
    for entry in entries:
        for example in entry.get("question_examples", []):
            likeness = SequenceMatcher(None, asked, str(example).lower())
            # Lengths, then counts of letters, bound the ratio; most examples need no more.
            if likeness.real_quick_ratio() <= score or likeness.quick_ratio() <= score:
                continue
            ratio = likeness.ratio()
            if ratio > score:
                best, score = entry, ratio
    limit = best.get("confidence_threshold") if best else None
    if best is not None and score >= least and (limit is None or confidence is None or confidence <= limit):
        return best
    return by_id.get("generic_fallback")


#: The answer where no entry fits.
NO_FALLBACK = (
    "I don't have a confident answer right now; would you like me to try a broader search or show related resources?"
)


def select_fallback(text: str, entries: list[dict], confidence: float | None = None, faq: dict[str, str] | None = None) -> str:
    """The response of the chosen entry."""
    chosen = choose_fallback(text, entries, confidence, faq)
    return NO_FALLBACK if chosen is None else str(chosen.get("response") or "")


def load_fallbacks(path: str | None = None, default: str = "config/fallbacks.json") -> list[dict]:
    """Entries of a JSON array: from ``path``, else from the file that FALLBACK_PATH names, else the default."""
    found = json.loads(Path(path or os.environ.get("FALLBACK_PATH") or default).read_text(encoding="utf-8"))
    return [{"type": "suggest"} | entry for entry in found if isinstance(entry, dict)]


def fallback_matches(texts: DataFrame, entries: list[dict], key: str = "query_id", text: str = "query") -> DataFrame:
    """(key, entry_id) for every row, in one pass; ``entries`` is a small configuration list.

    The likeness has no built-in form, so it runs in Python, once for each distinct text of a batch.
    """

    @F.pandas_udf("string")
    def match(found: pd.Series) -> pd.Series:
        chosen = {x: (choose_fallback(x or "", entries) or {}).get("id") for x in found.unique()}
        return found.map(chosen)

    return texts.select(key, match(text).alias("entry_id"))
