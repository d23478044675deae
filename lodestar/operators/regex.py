"""Pattern search: existence in the JVM by a translated expression, matches in Arrow on the rows that have one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.pattern import Matcher, existence
from lodestar.functions.text import byte_text, byte_view


def matching(df: DataFrame, pattern: str, value: str = "value") -> DataFrame:
    """The rows whose value has a match."""
    java = existence(pattern)
    return df.filter(F.lit(False) if java is None else F.coalesce(F.col(value).cast("string").rlike(java), F.lit(False)))


def matches(df: DataFrame, pattern: str, keys: list[str], value: str = "value", greedy: bool = True, binary: bool = False) -> DataFrame:
    """A row for each match: ``keys``, ``offset`` in the value and ``length``, in characters or, if ``binary``, in bytes."""
    hits = matching(df, pattern, value)
    text = byte_view(F.col(value)) if binary else F.col(value).cast("string")
    hits = hits.select(*keys, text.alias("__value"))
    wanted = byte_text(pattern) if binary else pattern

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(wanted, greedy)
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[int, int]] = []
            for i, v in enumerate(batch.column("__value")):
                each = matcher(v.as_py())
                rows += [i] * len(each)
                found += each
            took = pa.array(rows, pa.int64())
            places = [pa.array([m[0] for m in found], pa.int64()), pa.array([m[1] for m in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(took) for k in keys), *places], [*keys, "offset", "length"])

    made = df.select(*keys).withColumns({"offset": F.lit(0).cast("long"), "length": F.lit(0)})
    return hits.mapInArrow(find, made.schema)


def global_matches(records: DataFrame, pattern: str, value: str = "value", greedy: bool = True) -> DataFrame:
    """(``offset``, ``length``) of each match in the whole collection, in bytes."""
    found = matches(records, pattern, ["global_offset"], value, greedy, binary=True)
    return found.select((F.col("global_offset") + F.col("offset")).alias("offset"), "length")


def in_order(found: DataFrame, by: str = "front") -> DataFrame:
    """Matches by where they begin (``front``) or end (``end``), the shorter first where these agree."""
    if by not in ("front", "end"):
        raise ValueError(f"by must be 'front' or 'end', not {by!r}")
    return found.orderBy(F.col("offset") if by == "front" else F.col("offset") + F.col("length"), "length")
