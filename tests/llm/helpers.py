"""Documents with every awkward row, and brute-force helpers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward() -> list[tuple]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(150)
    near = base.split()
    near[70] = "changed"
    rows = [(i, prose(rng.randint(1, 120)), rng.choice(["en", "de"]), f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, base, "en", "s0") for i in range(6)]  # exact copies
    rows += [(110, " ".join(near), "en", "s1"), (111, base.upper(), "de", "s2")]
    rows += [(120, None, "en", "s0"), (121, "", None, "s1"), (122, " \t\n", "de", None), (123, "12345 !!", "en", "s0")]
    rows += [(None, prose(40), "de", "s1"), (None, base, None, None), (130, prose(20), None, "s2"), (130, prose(20), "en", "s2")]
    rows += [(131, "same row", "en", "s1")] * 3  # repeated rows
    rows += [(140, prose(6000), "en", "s0"), (141, "ab" * 900, "de", "s1"), (142, "É ünï 漢字 \U0001f600 \x00 x", "de", "s2")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


#: Names that operators use themselves.
CLASHING = ["id", "bytes", "key", "rank", "h", "src", "norm", "sha", "part", "block", "fp", "root", "spans", "size", "row", "kind", "all", "slot", "__id", "__h"]


def clashing(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
