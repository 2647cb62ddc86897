"""Shared folder, materialised tables and row identities used by the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at a time; texts may be long, so batches stay small.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_WORKSPACE: ContextVar[str] = ContextVar("workspace", default="")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{_WORKSPACE.get()}{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that no table reads any longer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at its end, so nothing may read them after it."""
    name = f"work-{uuid.uuid4().hex}"
    before = _WORKSPACE.set(f"{_WORKSPACE.get()}{name}/")
    path = f"{shared_folder(spark)}/lodestone/{_WORKSPACE.get()}".rstrip("/")
    try:
        yield
    finally:
        _WORKSPACE.reset(before)
        discard(spark, path)


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor
    costs only the tasks that were running on it."""
    spark = df.sparkSession
    steady(spark)
    path = path or new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # An empty partitioned table leaves no files to infer a schema from.
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, name: str, *used: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """(table, names, restore): ``docs`` written with a ``row`` number, so that rows have exact names.

    Columns of the table are called by position, so no name of the input can clash or break; ``names``
    are those of the columns ``used``, and ``restore`` gives rows of the table the input's columns.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    table = materialise(plain.withColumn("row", F.monotonically_increasing_id()), name)
    restore = lambda rows: rows.select(*plain.columns).toDF(*docs.columns)
    return table, [f"c{docs.columns.index(u)}" for u in used], restore


#: A row's number holds the part of the table that it was written in.
PART_BITS = 33


def parts_of(found: DataFrame, row_col: str, name: str, path: str | None = None) -> str:
    """Write a table of row numbers, one folder for each part that they lie in; returns its path."""
    spark = found.sparkSession
    path = path or new_folder(spark, name)
    rows = found.withColumn("part", F.shiftright(row_col, PART_BITS))
    rows.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return path


def read_part(path: str, part: int, columns: list[str]) -> pa.Table | None:
    """The rows of one part, as a task of its own reads them; None if there are none."""
    fs, base = pyarrow.fs.FileSystem.from_uri(f"{path}/part={part}")
    found = []
    for info in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as source:
                found.append(pyarrow.parquet.ParquetFile(source).read(columns))
    return pa.concat_tables(found) if found else None


@lru_cache(maxsize=4)
def _numbers(path: str, part: int) -> np.ndarray:
    found = read_part(path, part, ["row"])
    return np.empty(0, np.int64) if found is None else found["row"].to_numpy()


def among(path: str, rows: np.ndarray) -> np.ndarray:
    """Which of the ``rows`` numbers are in the list that ``parts_of`` wrote at ``path``."""
    parts = rows >> PART_BITS
    out = np.zeros(len(rows), bool)
    for part in np.unique(parts).tolist():
        here = parts == part
        out[here] = np.isin(rows[here], _numbers(path, part))
    return out


def listed(found: DataFrame, name: str, path: str | None = None) -> Column:
    """Whether the ``row`` of a numbered table is among the rows of ``found`` (row).

    A task looks up the parts that it reads, so neither texts nor other columns are moved.
    """
    path = parts_of(found.select("row"), "row", name, path)

    @F.pandas_udf("boolean")
    def there(rows: pd.Series) -> pd.Series:
        return pd.Series(among(path, rows.to_numpy()))

    return there("row")


def steady(spark: SparkSession) -> None:
    """Keep unions from passing on the partitioning of their sides: adaptive execution may change one side's
    after an aggregation above the union has been planned on it, and groups then come out in parts."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    steady(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(column(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def id_crc32(doc_id: str | Column) -> Column:
    """CRC-32 of the decimal text of an id, as the fold rules use it; null ids fall in no fold."""
    return F.crc32((column(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))


#: Bytes of a table that is dealt to all cores if it has fewer parts than there are.
SMALL_TABLE = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data; one small file, which Spark would read in one task, is dealt to all cores."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    small = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_TABLE
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if small and found.rdd.getNumPartitions() < cores else found
