"""The engine's inputs, derived from the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.config import Settings
from lodestone.functions import text as t
from lodestone.operators import builder, chunking
from lodestone.operators.retrievers import Index, Request

NOW = "2024-02-01T00:00:00Z"
#: An example configuration: the taxonomy and thesaurus that the registered queries use.
TAXONOMY = {
    "source_overrides": [{"contains": ["src1/"], "doc_type": "manual"}],
    "doc_types": {"legal": {"patterns": ["license"]}},
    "default_doc_type": "note",
}
THESAURUS = {
    "terms": {"table": ["tabular", "matrix", "spreadsheet"], "score": ["rating", "metric", "value"], "the": ["la", "der"]},
    "intent_groups": {"tabular": ["table", "row", "column", "matrix", "matrice"]},
}
#: Weights of document types, and all else by default.
WEIGHTS = {"policy": 1.1, "procedure": 1.1, "report": 1.1, "faq": 1.1, "manual": 1.2, "legal": 1.5}
SETTINGS = Settings(taxonomy=TAXONOMY, metadata_weight_rules={"doc_type": WEIGHTS})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("doc_ord"),
        F.concat(F.lit("data/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.prose_chunks(chunking.first_by_content(documents(spark, sf_dir)), SETTINGS)


_INDEXES: dict[tuple, Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of all documents: written once for a session and a state of the table, then read by every query."""
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, storage.version(spark, path))
    if key not in _INDEXES or not storage.exists(spark, _INDEXES[key].path):
        folder = storage.new_folder(spark, "index")
        chunks, _ = builder.build_chunks(documents(spark, sf_dir), SETTINGS, now=NOW, folder=f"{folder}/documents")
        _INDEXES[key] = Index.write(chunks, folder)
    found = _INDEXES[key]
    return Index.open(spark, found.path)


def request(spark: SparkSession, sf_dir: str, **changes) -> Request:
    """Every benchmark text against the index, governed by the records."""
    settings = SETTINGS.replace(**changes)
    now = F.to_timestamp(F.lit(NOW))
    return Request(queries(spark, sf_dir), index(spark, sf_dir), settings, None, document_records(spark, sf_dir), now)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of one paragraph a turn.  Their sizes are those of a dialogue, so they fit a row."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns")
    )
    return turns.select(
        F.col("conv_id").alias("doc_ord"),
        F.concat(F.lit("conv/"), F.col("conv_id"), F.lit(".md")).alias("source"),
        F.array_join("turns.text", "\n\n").alias("text"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle records of labelled documents: toxic ones deleted, poor ones retired."""
    stamp = F.date_format(F.expr("timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(cast(doc_id * 37 % 500 as int))"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("unit-"), F.col("doc_id")).alias("source_unit_id"),
        F.concat(F.lit("data/"), F.col("doc_id"), F.lit(".txt")).alias("source"),
        F.sha1(F.col("doc_id").cast("string").cast("binary")).alias("content_fingerprint"),
        stamp.alias("ingestion_iso_ts"),
        stamp.alias("last_upsert_iso_ts"),
        F.when(F.col("toxic") == 1, stamp).alias("deletion_mark_iso_ts"),
        F.when(F.col("toxic") == 1, "soft_deleted").when(F.col("quality") == 0, "retired").otherwise("active").alias("status"),
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of labelled documents under the identity of their path."""
    path = documents(spark, sf_dir).select(
        F.concat(F.lit("unit-"), F.col("doc_ord")).alias("named"), "doc_ord", t.source_unit_id("source").alias("unit"), "source"
    )
    found = records(spark, sf_dir).withColumnRenamed("source_unit_id", "named").drop("source").join(path, "named")
    return found.drop("named").withColumnRenamed("unit", "source_unit_id")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("unit-"), F.col("doc_id")).alias("source_unit_id"))


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation as a table text under a header line."""
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat_ws(" | ", F.col("s_suppkey").cast("string"), "s_name").alias("line")))).alias("r")
    )
    return rows.select(
        F.col("s_nationkey").cast("long").alias("doc_ord"),
        F.concat(F.lit("tables/"), F.col("s_nationkey"), F.lit(".txt")).alias("source"),
        F.concat(F.lit("key | name\n"), F.array_join("r.line", "\n")).alias("text"),
    )


def headed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation under a header line that recurs before every fourth of them, after a line of prose."""
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat_ws(" | ", F.col("s_suppkey").cast("string"), "s_name").alias("line")))).alias("r")
    )
    lines = F.flatten(F.transform("r.line", lambda x, i: F.when(i % 4 == 0, F.array(F.lit("Key | Name"), x)).otherwise(F.array(x))))
    meta = F.struct(
        F.lit("t").alias("table_id"), F.lit(None).cast("int").alias("row_count"), F.lit(2).alias("column_count"),
        F.array(F.lit("Key"), F.lit("Name")).alias("header_fields"), F.lit(True).alias("has_header"), F.lit(None).cast("string").alias("sheet_name"),
        *[F.lit(None).cast("int").alias(c) for c in ("page_index", "slide_index", "line_start_index", "line_end_index", "data_row_start_index", "data_row_end_index")],
    )
    return rows.select(
        F.col("s_nationkey").cast("long").alias("doc_ord"),
        F.concat(F.lit("tables/"), F.col("s_nationkey"), F.lit(".docx")).alias("source"),
        F.concat(F.lit("a line of prose\n"), F.array_join(lines, "\n")).alias("text"),
        F.array(meta).alias("table_metadata"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts"), F.concat(F.lit("unit-"), F.col("user_id")).alias("source_unit_id"), F.col("event_type").alias("action")
    )
