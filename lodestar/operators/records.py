"""Records in a total order: dense ids, global byte offsets, and what is read by offset, without a single-task window.

Rows are range-partitioned by key; each partition counts for itself, and what lies before it is one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import byte_text, byte_view, checked
from lodestar.sources.storage import scratch

#: Bytes in one bucket of the offset lookup.
BUCKET = 1 << 16


def numbered(df: DataFrame, key: str, value: str | None = None, first_id: int = 0, first_offset: int = 0) -> DataFrame:
    """Add ``record_id`` (dense, by ``key``) and, given ``value``, ``global_offset``: bytes and a newline for each before.

    Runs a job: the rows are written in order, once, to the folder that executors share. Splitters of range partitions
    are sampled anew wherever a plan computes them, so counts and rows must come from the same written partitions.
    """
    size = F.coalesce(F.octet_length(F.col(value)), F.lit(0)) + 1 if value else F.lit(1)
    parts = df.withColumn("__size", size.cast("long")).repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id())
    if value:
        parts = parts.mapInArrow(_running, parts.withColumn("__local", F.lit(0).cast("long")).schema)
    path = scratch(df.sparkSession, "records")
    parts.write.parquet(path)
    placed = df.sparkSession.read.schema(parts.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__rows"))
    sums = sums.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__bytes", "__rows")])
    placed = placed.join(F.broadcast(sums), "__part")  # one row a partition
    place = {"record_id": F.col("__rows") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(first_id)}
    if value:
        place["global_offset"] = F.col("__bytes") + F.col("__local") + F.lit(first_offset)
    return placed.withColumns(place).select(*df.columns, *place)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the sizes of those before it in its partition."""
    total = 0
    for b in batches:
        sizes = b.column("__size").to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes) + total
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - sizes)], [*b.schema.names, "__local"])
        total = int(ends[-1]) if len(ends) else total


def total_size(records: DataFrame, value: str = "value") -> DataFrame:
    """One row: n_records and n_bytes, a newline counted for each record."""
    return records.agg(F.count("*").alias("n_records"), F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(value)), F.lit(0)) + 1), F.lit(0)).cast("long").alias("n_bytes"))


def extract_global(records: DataFrame, offset: int, length: int, value: str = "value") -> DataFrame:
    """One row, ``content`` (binary): ``length`` bytes from a global offset on, across as many records as it takes."""
    if offset < 0 or length < 0:
        raise ValueError("offset and length can't be negative")
    held = F.coalesce(F.col(value).cast("binary"), F.lit("").cast("binary"))
    data = F.concat(held, F.lit("\n").cast("binary"))
    touched = records.filter((F.col("global_offset") < offset + length) & (F.col("global_offset") + F.octet_length(held) + 1 > offset))
    pieces = touched.select(F.struct(F.col("global_offset").alias("at"), byte_view(data).alias("data")).alias("piece"))
    joined = pieces.agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["data"]), "")
    start = F.greatest(F.lit(0), F.lit(offset) - F.coalesce(F.element_at("pieces", 1)["at"], F.lit(offset))) + 1
    cut = F.when(F.size("pieces") > 0, text.substr(start.cast("int"), F.lit(length)))
    return joined.select(F.encode(F.coalesce(cut, F.lit("")), "ISO-8859-1").alias("content"))


def check_range(records: DataFrame, offset: int, length: int, value: str = "value") -> None:
    """IndexError if the range leaves the collection."""
    n = total_size(records, value).first()["n_bytes"]
    if offset < 0 or length < 0 or offset + length > n:
        raise IndexError(f"{offset} + {length} is beyond {n} bytes")


def offset_to_record(records: DataFrame, positions: DataFrame, position: str = "position", value: str = "value") -> DataFrame:
    """``positions`` with the ``record_id`` that holds each global offset, as an equi-join on buckets of offsets."""
    end = F.col("global_offset") + F.coalesce(F.octet_length(F.col(value)), F.lit(0))
    spans = records.select("record_id", F.col("global_offset").alias("__from"), end.alias("__to"))
    spans = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__from") / BUCKET), F.floor(F.col("__to") / BUCKET))))
    asked = positions.withColumn("__bucket", F.floor(F.col(position) / BUCKET))
    inside = (F.col(position) >= F.col("__from")) & (F.col(position) <= F.col("__to"))
    return asked.join(spans, "__bucket").filter(inside).drop("__bucket", "__from", "__to")


def same_record(records: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b", value: str = "value") -> DataFrame:
    """``pairs`` of global offsets with ``same``: whether one record holds both."""
    one = offset_to_record(records, pairs, a, value).withColumnRenamed("record_id", "__a")
    both = offset_to_record(records, one, b, value).withColumnRenamed("record_id", "__b")
    return both.withColumn("same", F.col("__a") == F.col("__b")).drop("__a", "__b")


def alphabet(df: DataFrame, value: str = "value") -> DataFrame:
    """Distinct bytes of all values, as ``symbol``, with how often each occurs."""
    each = df.select(F.explode(F.split(byte_view(F.col(value)), "")).alias("symbol")).filter("symbol <> ''")
    return each.groupBy(F.ascii("symbol").alias("symbol")).agg(F.count("*").alias("n"))


def range_starts(df: DataFrame, key: str, first: str, last: str, value: str = "value") -> DataFrame:
    """(``key``, offset) of every suffix that lies between two prefixes, both included, in byte order."""
    if byte_text(checked(first)) > byte_text(checked(last)):
        raise ValueError("the first prefix must not follow the last")
    width = max(len(first.encode()), len(last.encode()))
    view = byte_view(F.col(value))
    grams = df.select(key, view.alias("__v"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(view)))).alias("__at"))
    part = F.substring("__v", F.col("__at"), F.lit(width))
    low, high = byte_text(first), byte_text(last)
    hit = (part >= low) & ((part <= high) | part.startswith(high))
    return grams.filter((F.length("__v") > 0) & hit).select(key, (F.col("__at") - 1).cast("long").alias("offset"))
