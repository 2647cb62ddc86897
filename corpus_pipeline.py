"""Corpus preparation: quality, exact copies, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  Each stage's output is written as Parquet to the shared folder and
read again as the next stage's input, so a lost executor never costs more than one stage.  What a stage
writes on its way is deleted when its output is there, and that when the next stage's is.

Defined cases are those of the operators: a null text counts as empty, null ids stay and sort last,
an empty table passes through every stage, and columns beyond those of ``documents`` are kept until
packing, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, exact_dedup, likeness, packing, quality
from lodestone.llm.queries import WORD_BPE
from lodestone.llm.shared import discard, new_folder, table, workspace


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: linked fingerprints, or a similarity of 0.8 over five words."""
    return likeness.drop_similar(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack_documents(docs, WORD_BPE, with_ids=False).drop("row", "ids")


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: The classifier and the packing cannot be expressed in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
