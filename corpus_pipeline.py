"""From raw documents to training shards: five stages, each written as Parquet and read again before the next.

A stage works on all that the one before it kept. The first three drop rows (texts whose language can't be told, near
copies, documents into which a benchmark leaked), the fourth orders the rest by the mixing schedule, the last deals
them to shards along that schedule, so that each shard read by slot follows the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import discard, documents, written
from lodestar.llm.near_copies import similar_groups
from lodestar.llm.op1_mix import mix, mix_documents
from lodestar.llm.op6_decontaminate import decontaminate
from lodestar.llm.op7_shard import shard_documents
from lodestar.llm.op8_language import identify
from lodestar.llm.op10_simhash import near_dedup

N_SHARDS = 40
#: Settings of the schedule that the mixing stage writes and the sharding stage deals along.
MIX = {"seed": 1}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identify(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, groups=similar_groups(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs, **MIX)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the order of files isn't read: the schedule follows again from the rows and the same settings
    return shard_documents(docs, N_SHARDS, seed=7, order=mix(docs, **MIX), order_seed=MIX["seed"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixing", mixing), ("sharding", sharding)]
#: SQL can't express the stages (a trained network, fingerprints, tiling); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
