"""Documents to the chunk table: one plan from first-wins dedupe to boilerplate counts, prose and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import storage
from lodestone.config import Settings
from lodestone.functions import text as t
from lodestone.operators import chunking, lifecycle

MARKER = "struct<marker_id:string,location:string,content_type:string,target:string,bbox:array<double>>"
#: Columns that a document may lack: strings, and arrays of structs.
OPTIONAL = {"doc_type": None, "extraction_method": None, "extraction_ts": None, "table_metadata": chunking.TABLE, "image_markers": MARKER}
#: Fields that every chunk must have.
CANONICAL = (
    "chunk_id", "source", "source_unit_id", "text", "doc_type", "domain_area", "is_tabular", "content_fingerprint",
    "extraction_method", "extraction_ts", "ingestion_iso_ts", "last_upsert_iso_ts", "deletion_mark_iso_ts", "status",
    "confidence_inputs",
)
#: Names of the extraction tiers.
TIERS = {"structured": "structured_parse", "document": "document_parse", "plain": "plain_text_parse"}


def missing_canonical_fields(chunks: DataFrame) -> list[str]:
    """Canonical fields that a table of chunks does not have."""
    return [name for name in CANONICAL if name not in chunks.columns]


def confidence_inputs(method: Column | str, status: Column | str, mark: Column | str, tabular: Column | str) -> Column:
    """What the confidence of a chunk is judged by."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    tier = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), t.extraction_tier(method))
    return F.struct(
        tier.alias("base_extraction_tier"),
        as_column(status).alias("lifecycle_status"),
        (F.coalesce(as_column(mark), F.lit("")) != "").alias("has_deletion_mark"),
        as_column(tabular).alias("tabular_evidence"),
    )


def document_metadata(details: bool = False) -> Column:
    """Counts and ids of a document's tables and images, null without any; with ``details`` the descriptions too."""
    tables = F.coalesce("table_metadata", F.array().cast(f"array<{chunking.TABLE}>"))
    markers = F.coalesce("image_markers", F.array().cast(f"array<{MARKER}>"))
    ids = lambda rows, key: F.filter(F.transform(rows, lambda x: t.strip(x[key])), lambda x: F.coalesce(x, F.lit("")) != "")
    fields = [
        F.size(tables).alias("table_count"),
        F.size(markers).alias("image_marker_count"),
        ids(tables, "table_id").alias("table_ids"),
        ids(markers, "marker_id").alias("image_marker_ids"),
    ]
    if details:
        fields += [tables.alias("tables"), markers.alias("image_markers")]
    return F.when((F.size(tables) > 0) | (F.size(markers) > 0), F.struct(*fields))


def _complete(documents: DataFrame) -> DataFrame:
    text = lambda n: (F.col(n) if n in documents.columns else F.lit(None)).cast("string")
    added = {n: text(n) if kind is None else chunking.structs(documents, n, kind) for n, kind in OPTIONAL.items()}
    return documents.withColumns(added).select("doc_ord", "source", "text", *OPTIONAL)


def build_chunks(
    documents: DataFrame,
    settings: Settings = Settings(),
    records: DataFrame | None = None,
    now: str = "",
    keep_skipped: bool = False,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(chunks, state): the chunk table of ``documents`` (doc_ord, source, text and any of ``OPTIONAL``), and
    the lifecycle records after it.

    With ``records`` every document is upserted first, and the chunk carries its record; documents that are
    skipped as unchanged give no chunks, unless ``keep_skipped``.  Without them every document counts as
    active since ``now``.  With a ``folder`` the documents left are written there before they are cut, so that
    what prose and tables share is done once.
    """
    docs = chunking.first_by_content(_complete(documents)).withColumn("source_unit_id", t.source_unit_id("source"))
    docs = docs.withColumn("extraction_method", F.coalesce("extraction_method", F.lit("text_file_parser")))
    docs = docs.withColumn("extraction_ts", F.coalesce("extraction_ts", F.lit(now)))
    stamps = ["ingestion_iso_ts", "last_upsert_iso_ts", "deletion_mark_iso_ts", "status"]
    state = None
    if records is not None and settings.ingestion_persist_lifecycle_state:
        batch = docs.select("source_unit_id", "source", "content_fingerprint", F.col("doc_ord").alias("seq"))
        state = lifecycle.upsert(records, batch, now, settings.lifecycle_skip_unchanged)
        docs = docs.join(state.select("source_unit_id", *stamps, "action"), "source_unit_id")
        if not keep_skipped:
            docs = docs.where("action <> 'unchanged_skipped'")
        docs = docs.drop("action")
    else:
        docs = docs.withColumns(
            {
                "ingestion_iso_ts": F.lit(now),
                "last_upsert_iso_ts": F.lit(now),
                "deletion_mark_iso_ts": F.lit(None).cast("string"),
                "status": F.lit("active"),
            }
        )
    kind = chunking.resolved_doc_type(
        F.col("doc_type"), F.col("source"), F.col("text"), F.col("extraction_method"), settings.taxonomy
    )
    docs = docs.withColumns(
        {
            "doc_type": kind,
            "is_tabular": (F.coalesce(F.size("table_metadata"), F.lit(0)) > 0) | chunking.looks_tabular("text"),
            "document_metadata": document_metadata(settings.chunk_include_document_level_details),
        }
    )
    if folder is not None:
        docs = storage.written(docs, folder)
    chunks = _prose(docs.where("not is_tabular"), settings).unionByName(_tables(docs.where("is_tabular"), settings))
    chunks = chunks.withColumn("text", t.strip("text")).where("text <> ''")
    chunks = chunks.withColumns(
        {
            "content_fingerprint": t.fingerprint("text"),
            "domain_area": F.lit("unknown"),
            "confidence_inputs": confidence_inputs("extraction_method", "status", "deletion_mark_iso_ts", "is_tabular"),
            # Words of prose windows have one space between them, so their blanks are collapsed already.
            "boilerplate_key": F.when(F.col("source_unit_kind") == "prose", t.fingerprint(F.lower("text"))).otherwise(t.boilerplate_key("text")),
        }
    )
    return chunks, state


_CARRIED = [
    "doc_ord", "source", "source_unit_id", "doc_type", "is_tabular", "extraction_method", "extraction_ts", "ingestion_iso_ts",
    "last_upsert_iso_ts", "deletion_mark_iso_ts", "status", "document_metadata",
]
#: Names of the fields that place a chunk in its table, and of their columns here.
_TABLE_PLACES = {
    "section_index": "section_index", "table_id": "table_id", "sheet_name": "sheet_name", "has_header": "has_header",
    "header_text": "header", "header_source": "header_source", "header_repeat_index": "header_repeat_index",
    "header_repeat_count": "header_repeat_count", "section_row_count": "section_row_count",
    "section_line_start_index": "section_line_start", "section_line_end_index": "section_line_end",
    "section_data_row_start_index": "section_data_row_start", "section_data_row_end_index": "section_data_row_end",
    "row_start_index": "row_start", "row_end_index": "row_end", "absolute_row_start_index": "absolute_row_start",
    "absolute_row_end_index": "absolute_row_end", "window_row_count": "window_row_count", "overlap_rows": "overlap_rows",
}
_TABLE_TYPE = T.StructType(
    [
        T.StructField(n, {"has_header": T.BooleanType()}.get(n, T.StringType() if n in ("table_id", "sheet_name", "header_text", "header_source") else T.IntegerType()))
        for n in _TABLE_PLACES
    ]
)
#: Names of the fields that place a chunk in its prose, and of their columns here.
_PROSE_PLACES = {
    "chunk_start_word_index": "start_word", "chunk_end_word_index": "end_word", "chunk_word_count": "word_count",
    "overlap_words": "overlap_words", "absolute_chunk_start_word_index": "absolute_start_word",
    "absolute_chunk_end_word_index": "absolute_end_word", "cohesion_split_applied": "cohesion_split_applied",
}
_PROSE_TYPE = T.StructType(
    [T.StructField(n, T.BooleanType() if n == "cohesion_split_applied" else T.IntegerType()) for n in _PROSE_PLACES]
)
_BOUNDARY = "struct<unit_start_word_index:int,unit_end_word_index:int,unit_start_row_index:int,unit_end_row_index:int>"


def _boundary(words: bool, start: str, end: str) -> Column:
    own = [F.col(start).cast("int"), F.col(end).cast("int")]
    none = [F.lit(None).cast("int")] * 2
    names = ["unit_start_word_index", "unit_end_word_index", "unit_start_row_index", "unit_end_row_index"]
    return F.struct(*[c.alias(n) for c, n in zip(own + none if words else none + own, names)]).cast(_BOUNDARY)


def _shape(rows: DataFrame, kind: str, places: Column, tables: Column, boundary: Column) -> DataFrame:
    return rows.select(
        *_CARRIED,
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.concat(t.basename("source"), F.lit(":"), F.col("chunk_index")).alias("chunk_id"),
        "text",
        F.lit(kind).alias("source_unit_kind"),
        "source_unit_local_id",
        boundary.alias("source_unit_boundary"),
        places.alias("prose_chunk_metadata"),
        tables.alias("tabular_chunk_metadata"),
    )


def _prose(docs: DataFrame, settings: Settings) -> DataFrame:
    found = chunking.prose_chunks(docs, settings)
    places = F.struct(*[F.col(c).cast(_PROSE_TYPE[n].dataType).alias(n) for n, c in _PROSE_PLACES.items()])
    return _shape(found, "prose", places, F.lit(None).cast(_TABLE_TYPE), _boundary(True, "unit_start", "unit_end"))


def _tables(docs: DataFrame, settings: Settings) -> DataFrame:
    """Windows of a document are numbered inside its row, so no table is moved."""
    sections = chunking.table_sections(docs)
    found = chunking.table_windows(sections, settings.table_chunk_rows, settings.table_overlap_rows)
    order = chunking._by_document(docs).orderBy("section_index", "row_start")
    found = found.withColumns(
        {
            "has_header": F.col("header").isNotNull(),
            "chunk_index": F.row_number().over(order) - 1,
            "source_unit_local_id": F.concat_ws(":", "source_unit_id", F.lit("table"), F.coalesce("table_id", F.col("section_index").cast("string"))),
        }
    ).withColumn("text", F.col("text_window"))
    tables = F.struct(*[F.col(c).cast(_TABLE_TYPE[n].dataType).alias(n) for n, c in _TABLE_PLACES.items()])
    return _shape(found, "tabular_section", F.lit(None).cast(_PROSE_TYPE), tables, _boundary(False, "section_data_row_start", "section_data_row_end"))


def source_statistics(chunks: DataFrame) -> DataFrame:
    """Per source: chunk_count, tabular_chunk_count, prose_chunk_count, inferred_doc_types."""
    kind = F.when(t.strip(F.coalesce("doc_type", F.lit(""))) == "", "unknown").otherwise(F.lower(t.strip("doc_type")))
    return chunks.groupBy("source").agg(
        F.count("*").alias("chunk_count"),
        F.count_if("is_tabular").alias("tabular_chunk_count"),
        F.count_if(~F.col("is_tabular")).alias("prose_chunk_count"),
        F.array_sort(F.collect_set(kind)).alias("inferred_doc_types"),  # as many as the taxonomy has
    )


def ingestion_files(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every file of a scan with what became of it: parser, status, skip_reason and its chunk statistics."""
    found = parsed.select("source", "parser", "status", "skip_reason").join(source_statistics(chunks), "source", "left")
    return found.fillna(0, ["chunk_count", "tabular_chunk_count", "prose_chunk_count"]).withColumn(
        "inferred_doc_types", F.coalesce("inferred_doc_types", F.array().cast("array<string>"))
    )
