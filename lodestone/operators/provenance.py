"""Completeness and quality of sources and citations: filters, reports, rollups.

Reports are over a whole table, or over each query if ``by`` names its column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import answers

#: Fields that a source chunk must have.
SOURCE_FIELDS = ["source", "chunk_id"]
#: Kinds of citation failures beyond missing fields.
QUALITY = ["snippet_adequacy", "source_traceability", "duplicate_policy"]


def missing_fields(table: DataFrame, required: list[str]) -> Column:
    """Names of the required fields that are null or blank in a row, or that the table lacks; zero is there."""
    blank = lambda c: F.coalesce(t.strip(F.col(c).cast("string")), F.lit("")) == "" if c in table.columns else F.lit(True)
    return F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))


def field_report(table: DataFrame, required: list[str], by: str | None = None) -> DataFrame:
    """total, valid, invalid, missing_<field>, completeness_rate (1 for an empty table)."""
    rows = table.withColumn("__missing", missing_fields(table, required))
    valid = F.count_if(F.size("__missing") == 0)
    return rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("total"),
        valid.alias("valid"),
        F.count_if(F.size("__missing") > 0).alias("invalid"),
        *[F.count_if(F.array_contains("__missing", c)).alias(f"missing_{c}") for c in required],
        F.round(F.coalesce(F.try_divide(valid.cast("double"), F.count("*")), F.lit(1.0)), 4).alias("completeness_rate"),
    )


def validate_sources(chunks: DataFrame, by: str | None = None) -> DataFrame:
    return field_report(chunks, SOURCE_FIELDS, by)


def validate_citations(cited: DataFrame, by: str | None = None) -> DataFrame:
    return field_report(cited, answers.CITATION_FIELDS, by)


def complete_sources(chunks: DataFrame) -> DataFrame:
    """Chunks with all source fields."""
    return chunks.where(F.size(missing_fields(chunks, SOURCE_FIELDS)) == 0)


def complete_citations(cited: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Citations without missing fields and without any failure."""
    judged = answers.quality_failures(cited, sources)
    return judged.where(F.size("failures") == 0).drop("failures")


def validate_quality(cited: DataFrame, sources: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """total, valid, invalid, dropped_<kind>, duplicate_groups, quality_rate; missing fields are no matter here."""
    judged = answers.quality_failures(cited, sources, fields_first=False)
    valid = F.count_if(F.size("failures") == 0)
    return judged.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("total"),
        valid.alias("valid"),
        F.count_if(F.size("failures") > 0).alias("invalid"),
        *[F.count_if(F.array_contains("failures", k)).alias(f"dropped_{k}") for k in QUALITY],
        F.count_if(F.array_contains("failures", "duplicate_policy")).alias("duplicate_groups"),
        F.round(F.coalesce(F.try_divide(valid.cast("double"), F.count("*")), F.lit(1.0)), 4).alias("quality_rate"),
    )


def validate_provenance(queries: DataFrame, chunks: DataFrame, cited: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(query_id, complete) of every query: no invalid source, citation field or citation; complete without evidence."""
    parts = {
        "bad_sources": validate_sources(chunks, "query_id").select("query_id", F.col("invalid").alias("bad_sources")),
        "bad_fields": validate_citations(cited, "query_id").select("query_id", F.col("invalid").alias("bad_fields")),
        "bad_quality": validate_quality(cited, sources, "query_id").select("query_id", F.col("invalid").alias("bad_quality")),
    }
    out = queries.select("query_id")
    for part in parts.values():
        out = out.join(part, "query_id", "left")
    return out.select("query_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in parts]).withColumn(
        "complete", (F.col("bad_sources") + F.col("bad_fields") + F.col("bad_quality")) == 0
    )
