"""What the operators share: scratch tables in the shared checkpoint folder and distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


#: Bytes of one Arrow batch between the JVM and Python, about; a longer text is a batch of its own.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python are bounded by bytes, not by rows alone, unless the session says how large they may be."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; on one machine, where it is unset, one of our own.

    RuntimeError on a cluster without it: a local folder would be another one on each executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        fs, at = _fs(spark, path)
        fs.delete(at, True)
        _made.pop(path, None)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may be gone by then
            discard(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    Returns the table and its path; :func:`discard` deletes it early, otherwise it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lodestar-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


@contextlib.contextmanager
def shuffles_end_with_writes(spark: SparkSession):
    """Within it, shuffle files go as soon as the write they served is done; Spark makes them again if it should need them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def bucketed(df: DataFrame, n: int, key: str, name: str):
    """``df`` as a table of ``n`` buckets by ``key``: it meets other tables by key without moving again. The table and its
    files go on leaving, whatever happened within."""
    spark = df.sparkSession
    table = f"lodestar_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/lodestar-{spark.sparkContext.applicationId}/{table}"
    _made[path] = spark
    try:
        df.write.option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table)
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        discard(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(col) -> F.Column:
    """Lower-case A-Z and nothing else. ``lower`` is the same and faster where the text is pure ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def spread_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, total: str, name: str) -> tuple[DataFrame, str]:
    """Add the rank from 0 of each row within ``keys`` by ``order``, and the rows of its key; keys may not be null.

    Rows are range-partitioned by keys and order together, so a key of any size spreads over many partitions; ranks
    follow from the position within the partition and the counts of (partition, key) before it, which are as many as
    partitions and keys. Returns the table and the path of the scratch table behind it.
    """
    at = "__at"
    df = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id())
    df, path = written(df, name)
    df = df.withColumn("__part", F.shiftright(at, 33))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy("__part", *keys).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    counts = counts.select(
        "__part", *keys, "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(*keys)).alias(total),
    )
    df = df.join(counts, ["__part", *keys])
    return df.withColumn(rank, F.col(at) - F.col("__first") + F.col("__before")).drop("__part", at, "__first", "__before"), path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_col: str, text_col: str, seed: int) -> Column:
    """Hash of a row's id and text: with the id, what :func:`with_copies_placed` tells rows apart by."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.crc32(text.cast("binary")), F.octet_length(text).cast("long"))


def with_copies_placed(df: DataFrame, placed: DataFrame, id_col: str, key: Column, cols: dict[str, str]) -> DataFrame:
    """Give each row of ``df`` one of the rows of ``placed`` (id, h, ...) with the same id and key: of repeated rows each
    gets another, or nulls where ``placed`` has fewer; rows it doesn't have go. ``cols`` names what is added: column of
    ``placed`` to new column. ``key`` and ``h`` are never null.

    The texts move once: the join's keys are not null, so that rows stay dealt as they are for numbering repeated ones.
    """
    ident, none, h, places, place = fresh(df, "__id", "__none", "__h", "__places", "__place")
    named = lambda c: {ident: F.coalesce(c.cast("string"), F.lit("")), none: c.isNull()}
    many = placed.withColumns({"__key": F.col("h"), **named(F.col("id"))})
    many = many.groupBy("__key", ident, none).agg(F.collect_list(F.struct(*cols)).alias(places)).withColumnRenamed("__key", h)
    full = df.withColumns({h: key, **named(F.col(f"`{id_col}`"))})
    nth = F.row_number().over(W.partitionBy(h, ident, none).orderBy(F.lit(0)))
    both = full.join(many, [h, ident, none]).withColumn(place, F.get(places, nth - 1))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{place}.{c}").alias(new) for c, new in cols.items()])


#: Keys that :func:`dealt_join` deals into parts at most: what it broadcasts is bounded, whatever the tables hold.
MOST_HOT = 100_000


def dealt_join(many: DataFrame, one: DataFrame, key: str, least: int = 256) -> DataFrame:
    """``many`` joined with ``one``, which has a row a key at most, without hot keys: a key of more rows than a bound is
    dealt into parts, to each of which its row of ``one`` goes. ``many`` should be a written table, as it is counted first.

    The bound is ``least`` rows or a MOST_HOT-th of the table, so that MOST_HOT keys at most are broadcast.
    """
    n = many.count()
    bound = max(least, -(-n // MOST_HOT))
    if n <= bound:
        return many.join(one, key)
    hot = many.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > bound).select(key, F.ceil(F.col("__n") / bound).alias("__parts"))
    hot = F.broadcast(hot)
    drawn = F.pmod(F.xxhash64(*[c for c, kind in many.dtypes if "map" not in kind]), F.col("__parts"))
    many = many.join(hot, key, "left").withColumn("__part", F.coalesce(drawn, F.lit(0).cast("long"))).drop("__parts")
    one = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__parts")
    return many.join(one, [key, "__part"]).drop("__part")


def byte_buffer(column):
    """The bytes of an Arrow binary or string column and the offsets of its values within them (one more than values)."""
    import numpy as np
    import pyarrow as pa

    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets
