"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted (externally, spilling where it must),
equal texts end up adjacent and neighbours are compared in full. The sort key is (leading characters, SHA-256, full
text, id). The splitters are bounded in size, whatever the texts are: the sampled part of the key is the leading
characters, the digest and the id. Since the id is part of it, a text that a third of all rows share is cut into as
many partitions as its rows need, and no partition holds more than its share. Runs that touch a partition's edge are
joined across partitions afterwards from one head row a run: two rows a partition, the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import ascii_lower, bounded_batches, documents, written

LEAD = 16
#: Characters of text that Python compares at once.
SLICE = 4 << 20


def _slices(batch: pa.RecordBatch, col: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE bytes of text each, so that very long texts don't meet in one buffer."""
    ends = np.cumsum(pc.binary_length(batch.column(col)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


class _Runs:
    """Cuts one sorted partition into runs of equal texts; holds ids of the open run and one text, nothing else."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.ids: list[pa.Array] = []
        self.text = None
        self.sha = None
        self.first = True

    def close(self, last: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        n = len(ids)
        known = ids.drop_null()
        same = pc.fill_null(pc.equal(ids.slice(0, n - 1), ids.slice(1)), False)
        both_null = pc.and_(ids.slice(0, n - 1).is_null(), ids.slice(1).is_null())
        last_of_id = pa.concat_arrays([pc.invert(pc.or_(same, both_null)), pa.array([True])])
        edge = 0 if self.first else 1 if last else None  # a run that fills its partition counts as the first
        rep = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
        lo, hi = (known[0], known[-1]) if len(known) else (None, None)
        kind = ids.type
        head = pa.array([len(self.text) if edge is not None else None], pa.int64())
        out = [
            ids,
            rep(self.sha, pa.string()),
            rep(lo.as_py() if lo is not None else None, kind),
            rep(hi.as_py() if hi is not None else None, kind),
            rep(n, pa.int64()),
            last_of_id,
            rep(edge, pa.int32()),
            pa.concat_arrays([head, pa.nulls(n - 1, pa.int64())]),
        ]
        self.ids, self.first = [], False
        return pa.RecordBatch.from_arrays(out, schema=self.schema)

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sha, text = batch.column(0), batch.column(1), batch.column(2)
        n = batch.num_rows
        inner = pc.invert(pc.equal(text.slice(1), text.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        starts = [*([0] if self.text is None or text[0].as_py() != self.text else []), *(np.flatnonzero(inner) + 1).tolist()]
        at = 0
        many: list[pa.RecordBatch] = []
        for start in starts:
            if start > at:
                self.ids.append(ids.slice(at, start - at))
            if self.ids:
                many.append(self.close(False))
            self.text, self.sha, at = text[start].as_py(), sha[start].as_py(), start
        self.ids.append(ids.slice(at))
        if many:
            yield pa.Table.from_batches(many).combine_chunks().to_batches()[0]


def content_sort_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only; null counts as empty, and empty texts are equal. ``keep``
    names the id that stays in each group: ``smallest`` (the usual) or ``largest``. Null ids are never chosen unless a
    group has no other; of rows with the same id and text exactly one stays. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    id_type = df.schema[id_col].dataType
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("norm"))
    rows = rows.select("id", F.sha2("norm", 256).alias("sha"), "norm", F.substring("norm", 1, LEAD).alias("lead"))
    rows = rows.repartitionByRange("lead", "sha", "id").sortWithinPartitions("lead", "sha", "norm", "id").select("id", "sha", "norm")

    out = T.StructType([
        T.StructField("id", id_type), T.StructField("sha", T.StringType()), T.StructField("lo", id_type),
        T.StructField("hi", id_type), T.StructField("n", T.LongType()), T.StructField("last_of_id", T.BooleanType()),
        T.StructField("edge", T.IntegerType()), T.StructField("head", T.LongType()),
    ])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = None
        for whole in batches:
            for batch in _slices(whole, "norm"):
                if cut is None:
                    kinds = {"id": batch.schema.field("id").type, "sha": pa.string(), "lo": batch.schema.field("id").type, "hi": batch.schema.field("id").type, "n": pa.int64(), "last_of_id": pa.bool_(), "edge": pa.int32(), "head": pa.int64()}
                    cut = _Runs(pa.schema(list(kinds.items())))
                yield from cut.feed(batch)
        if cut is not None:
            yield cut.close(True)

    bounded_batches(df.sparkSession)
    cut = rows.mapInArrow(runs, out).withColumn("part", F.spark_partition_id())
    cut, _ = written(cut, "dedup-runs")
    # of a text at a partition's edge only digest and length go on: no task gathers the texts of a hot group's edges
    same = W.partitionBy("sha", "head")
    edges = cut.filter(F.col("head").isNotNull()).select(
        F.col("part"), F.col("edge"), F.min("lo").over(same).alias("all_lo"), F.max("hi").over(same).alias("all_hi"), F.sum("n").over(same).alias("all_n"),
    )
    joined = cut.drop("head").join(F.broadcast(edges), ["part", "edge"], "left")
    best = F.coalesce("all_lo", "lo") if keep == "smallest" else F.coalesce("all_hi", "hi")
    joined = joined.withColumn("keep_id", best)
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & F.col("last_of_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(documents(spark, sf_dir), keep="largest")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
