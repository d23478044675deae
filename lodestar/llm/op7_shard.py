"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the fractional rank (rank + 1/2) / rows of the
source orders the whole table, and the order is cut into shards whose counts differ by one at most. Each shard so
holds every source in its share. Both ranks come from range partitions and prefix counts (see ``spread_rank``): no
window spans a source or the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, documents, row_key, spread_rank, with_copies_placed


def keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Narrow rows: id, source, size, crc and a seeded shuffle key; a null source is a source of its own."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.octet_length(text).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("crc"), row_key(id_col, text_col, seed).alias("h"),
    )
    return df.withColumns({"no_source": F.col("source").isNull(), "src": F.coalesce("source", F.lit(""))})


def interleave(df: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, no_source, src, h, bytes, crc, shard, slot.

    A null text has no bytes, a null source counts as one more source, null ids and repeated rows are placed like any
    other, an empty table gives an empty result; other columns are ignored, whatever their names. Equal texts may part:
    shards of equal counts can't hold a group of copies that is larger than a shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    narrow = keyed(df, id_col, text_col, source_col, seed)
    ranked, path = spread_rank(narrow, ["no_source", "src"], ["h", "id", "crc", "bytes"], "rank", "of", "shard-ranks")
    ranked = ranked.withColumn("share", (F.col("rank") + 0.5) / F.col("of")).drop("of").withColumn("all", F.lit(0))
    placed, _ = spread_rank(ranked, ["all"], ["share", "no_source", "src", "rank"], "g", "n", "shard-order")
    discard(df.sparkSession, path)
    n = F.lit(n_shards).cast("long")
    placed = placed.withColumn("shard", F.expr(f"cast((g * {n_shards}L) div n as int)"))
    return placed.withColumn("slot", F.expr(f"g - ((shard * n + {n_shards - 1}L) div {n_shards}L)")).drop("all", "share", "rank", "g", "n")


def deal(order: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """id, h, shard, slot of the rows of a mixing order (id, source, h, mix_pos as ``op1_mix.mix`` gives them).

    Each source's rows are dealt to the shards one by one in mixing order, and a shard's slots follow that order: sizes,
    and the rows of a source in any prefix of the order, differ by one at most between shards.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    narrow = order.select("id", "h", "mix_pos", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), F.lit(0).alias("all"))
    listed, path = spread_rank(narrow, ["all"], ["no_source", "src", "mix_pos"], "g", "n", "deal-order")
    listed = listed.select("id", "h", "mix_pos", F.pmod(F.col("g") + F.lit(seed).cast("long"), F.lit(n_shards).cast("long")).cast("int").alias("shard"))
    dealt, _ = spread_rank(listed, ["shard"], ["mix_pos"], "slot", "n", "deal-slots")
    discard(order.sparkSession, path)
    return dealt.select("id", "h", "shard", "slot")


def shard_documents(
    df: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    order: DataFrame | None = None, order_seed: int = 0,
) -> DataFrame:
    """``df`` with shard and slot (columns of these names give way): only narrow rows are ranked, the texts move once.

    With ``order``, the places that ``op1_mix.mix`` gives ``df`` under ``order_seed``, shards are dealt along it.
    """
    places = interleave(df, n_shards, seed, id_col, text_col, source_col) if order is None else deal(order, n_shards, seed)
    df = df.drop(*({"shard", "slot"} - {id_col, text_col, source_col}))
    return with_copies_placed(df, places, id_col, row_key(id_col, text_col, seed if order is None else order_seed), {"shard": "shard", "slot": "slot"})


def write_shards(df: DataFrame, path: str, **kwargs) -> None:
    """Write the rows as one folder a shard, in slot order within it."""
    shard_documents(df, **kwargs).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(documents(spark, sf_dir), n_shards=40, seed=7).select(
        F.col("id").alias("doc_id"), (F.col("bytes") + 16).alias("size"), F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source",
    )
