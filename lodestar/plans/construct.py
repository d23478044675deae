"""Builds a saved collection from files: text or binary, as one value a file or one record a line."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.collections import FlatCollection
from lodestar.sources.storage import MODES, binary_files, text_records

USAGE = "usage: python -m lodestar.plans.construct text-file|binary-file|indexed-text-file|indexed-binary-file INPUT OUTPUT [MODE]"


def records_of(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """``value``: whole files, or for the indexed kinds their lines; bytes of binary ones needn't be text."""
    match kind:
        case "text-file":
            return text_records(spark, path, whole=True)
        case "indexed-text-file":
            return text_records(spark, path)
        case "binary-file":
            return binary_files(spark, path).select("value")
        case "indexed-binary-file":
            return spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("value"))
    raise ValueError(f"unknown kind {kind!r}")


def construct(spark: SparkSession, kind: str, path: str, out: str, mode: str = "error") -> None:
    FlatCollection.build(records_of(spark, kind, path)).save(out, mode)


def main(argv: list[str]) -> int:
    if len(argv) not in (3, 4) or argv[3:] and argv[3] not in MODES:
        print(USAGE, file=sys.stderr)
        return 2
    construct(SparkSession.builder.appName("lodestar").getOrCreate(), *argv)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
