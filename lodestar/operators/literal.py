"""Literal search: counts and predicates in the JVM, offsets in one Arrow pass over the rows that contain the literal."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as t


def count(df: DataFrame, query: str | bytes, value: str = "value", binary: bool = False) -> DataFrame:
    """One row, ``n``: occurrences over all values, overlaps included."""
    return df.agg(F.coalesce(F.sum(t.occurrences(F.col(value), query, binary)), F.lit(0)).cast("long").alias("n"))


def containing(df: DataFrame, query: str | bytes, value: str = "value") -> DataFrame:
    """The rows whose value contains the literal."""
    return df.filter(t.has(F.col(value), query))


def offsets(df: DataFrame, query: str | bytes, keys: list[str], value: str = "value", binary: bool = False) -> DataFrame:
    """A row for each occurrence: ``keys`` and its ``offset`` in the value, in characters or, if ``binary``, in bytes."""
    literal = t.checked(query)
    if binary and isinstance(literal, str):
        literal = literal.encode("utf-8")
    hits = containing(df, query, value).select(*keys, F.col(value).cast("binary" if binary else "string").alias("__value"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[int] = []
            for i, v in enumerate(batch.column("__value")):
                v = v.as_py()
                at = v.find(literal)
                while at >= 0:
                    rows.append(i)
                    found.append(at)
                    at = v.find(literal, at + 1)
            took = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(took) for k in keys), pa.array(found, pa.int64())], [*keys, "offset"])

    return hits.mapInArrow(find, df.select(*keys).withColumn("offset", F.lit(0).cast("long")).schema)


def global_offsets(records: DataFrame, query: str | bytes, value: str = "value") -> DataFrame:
    """``offset``: where each occurrence begins in the whole collection, in bytes."""
    found = offsets(records, query, ["global_offset"], value, binary=True)
    return found.select((F.col("global_offset") + F.col("offset")).alias("offset"))
