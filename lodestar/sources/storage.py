"""Saving and loading: Parquet folders, with modes that never append to a saved table."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

MODES = ("error", "errorifexists", "overwrite", "ignore")


def save(df: DataFrame, path: str, mode: str = "error", partitions: int | None = None, order: str | None = None) -> None:
    """Write a table; ``append`` is refused. ``order`` range-partitions by a key, so that lookups skip files."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} isn't supported; use one of {', '.join(MODES)}")
    if order:
        df = (df.repartitionByRange(partitions, order) if partitions else df.repartitionByRange(order)).sortWithinPartitions(order)
    elif partitions:
        df = df.repartition(partitions)
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, level: StorageLevel | None = None) -> DataFrame:
    """Read a saved table or one of its part files; ``level`` keeps it at hand."""
    df = spark.read.parquet(path)
    return df.persist(level) if level else df


def hadoop(spark: SparkSession, path: str):
    """The JVM's file system of a path, and the path with its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, store.makeQualified(at)


def stored_size(spark: SparkSession, path: str) -> int:
    """Bytes that a saved table takes where it is stored, compressed as it is."""
    store, at = hadoop(spark, path)
    return store.getContentSummary(at).getLength()


def text_records(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``value``: a record for each line, or for each file."""
    return spark.read.text(path, wholetext=whole)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("value"))


def delimited(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """A table of strings from delimited text with a header row."""
    return spark.read.option("sep", sep).option("header", True).csv(path)


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; one of our own only where the cluster names none.

    What is written there goes when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/lodestar-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone by then
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
