"""Typed tables: predicates and projections as plain column expressions, so that Parquet prunes and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREDICATES = {
    "eq": lambda c, v: c == v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.contains(v),
    "in": lambda c, v: c.isin(list(v)),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "between": lambda c, v: c.between(*v),
    "eqnullsafe": lambda c, v: c.eqNullSafe(v),
}


def predicate(column: str, op: str, value: object) -> Column:
    if op not in PREDICATES:
        raise ValueError(f"unknown predicate {op!r}; known: {', '.join(PREDICATES)}")
    return PREDICATES[op](F.col(column), value)


def prune_filter(df: DataFrame, columns: list[str] | None = None, where: list[tuple[str, str, object]] = ()) -> DataFrame:
    """Rows that meet all predicates, with the columns asked for, in that order."""
    if where:
        df = df.filter(reduce(lambda a, b: a & b, (predicate(*p) for p in where)))
    return df.select(*columns) if columns else df


def limits(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: min_<c> and max_<c> of each column; nulls don't count."""
    return df.agg(*[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


BITS = 63  # of a long, without its sign


def rollup_count_distinct(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and ``n``: GROUP BY ROLLUP with the distinct values of a column, without repeating rows for each grouping set.

    A value's groups become the bits of one long, so that a value leaves each task once; values with equal bits are then
    counted together. Tables of more groups than bits are sorted by value instead.
    """
    groups = df.select(*keys).distinct()
    found = groups.limit(BITS + 1).count()
    if not found:  # the grand total alone
        return df.agg(*[F.max(k).alias(k) for k in keys], F.count(value).alias("n"))
    return _by_bits(df, groups, keys, value) if found <= BITS else _by_order(df, keys, value)


def _by_bits(df: DataFrame, groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    place = F.row_number().over(W.orderBy(*keys)) - 1
    groups = groups.withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), place))
    of_row = groups.select("bit", *[F.col(k).alias(f"{k} of group") for k in keys])
    rows = df.select(value, *keys).join(F.broadcast(of_row), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k} of group")) for k in keys)))
    masks = rows.groupBy(value).agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count(value).alias("n"))
    sets = groups.rollup(*keys).agg(F.bit_or("bit").alias("bits"), F.grouping_id().alias("level"))
    counted = masks.join(F.broadcast(sets), F.col("mask").bitwiseAND(F.col("bits")) != 0)
    return counted.groupBy("level", *keys).agg(F.sum("n").alias("n")).select(*keys, "n")


def _by_order(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A value counts for a group of the first k keys at its first row there, ``new k``."""
    w, depths = W.partitionBy(value).orderBy(*keys), range(len(keys) + 1)
    firsts = [F.row_number().over(w) == 1] + [~F.lag(F.struct(*keys[:k])).over(w).eqNullSafe(F.struct(*keys[:k])) for k in depths[1:]]
    rows = df.select(value, *keys).distinct().select(value, *keys, *[f.alias(f"new {k}") for k, f in enumerate(firsts)])
    news = rows.groupBy(*keys).agg(*[F.count(F.when(F.col(f"new {k}"), F.col(value))).alias(f"new {k}") for k in depths])
    n = F.coalesce(*[F.when(F.grouping_id() == 2 ** (len(keys) - k) - 1, F.sum(f"new {k}")) for k in depths])
    return news.rollup(*keys).agg(n.alias("n"))


def append(df: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of both; new ones lie as densely as those that are there."""
    return df.unionByName(settled(df, new), allowMissingColumns=False)


def settled(df: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in as many partitions as the density of ``df`` asks for; counts both."""
    parts = parts_for(df.count(), new.count(), df.rdd.getNumPartitions())
    return new.coalesce(parts) if parts <= new.rdd.getNumPartitions() else new.repartition(parts)


def parts_for(rows: int, new_rows: int, parts: int) -> int:
    """Partitions of appended rows at the density of those that are there."""
    per = max(1, rows // max(1, parts))
    return max(1, -(-new_rows // per))
