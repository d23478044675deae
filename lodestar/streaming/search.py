"""Searches over arriving records, as Structured Streaming transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as t


def windowed_count(stream: DataFrame, query: str, ts: str, value: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Occurrences of a literal in each window of event time; rows later than ``late`` are left out. Works on batches too."""
    n = t.occurrences(F.col(value), query)
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.sum(n).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
