"""Tables in a folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def steady(spark: SparkSession) -> None:
    """Keep unions from passing on the partitioning of their sides: adaptive execution may change one side's
    after an aggregation above the union has been planned on it, and groups then come out in parts."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, path: str) -> DataFrame:
    """``table`` as Parquet at ``path``, read back, so its plan ends there."""
    steady(table.sparkSession)
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of the shared one, deleted at the end; nothing may read its tables after that."""
    path = new_folder(spark, name)
    try:
        yield path
    finally:
        discard(spark, path)


#: Bytes of a table that is dealt to all cores if it has fewer parts than there are.
SMALL_TABLE = 64 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table of fewer parts than there are cores, such as one file, dealt to all of them; others as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    small = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_TABLE
    return table.repartition(cores) if small and table.rdd.getNumPartitions() < cores else table


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _target(spark, path)
    return files.exists(target)


def version(spark: SparkSession, path: str) -> str:
    """A digest of the files that a Parquet table has, with their total size and the last change of its top folder, to
    tell whether a table is the one it was; writers name their files anew, so a replaced file is noticed."""
    target, files = _target(spark, path)
    names = sorted(spark.read.parquet(path).inputFiles())
    found = files.getContentSummary(target).getLength(), files.getFileStatus(target).getModificationTime()
    return hashlib.sha256("\n".join([*map(str, found), *names]).encode()).hexdigest()


def claimed(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there already, also if another process creates it just now."""
    target, files = _target(spark, path)
    try:
        files.create(target, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(target):
            return False
        raise
    return True


def renamed(spark: SparkSession, path: str, to: str) -> None:
    target, files = _target(spark, path)
    if not files.rename(target, _target(spark, to)[0]):
        raise OSError(f"{path} could not be renamed to {to}")


def discard(spark: SparkSession, path: str) -> None:
    target, files = _target(spark, path)
    files.delete(target, True)
