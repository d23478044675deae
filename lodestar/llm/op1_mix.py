"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in seeded order, form blocks. A source with weight w is a Pfair task: its j-th block (from 0) may
run from slot floor(j / w) and must run before slot ceil((j + 1) / w); of the released blocks the one with the earliest
deadline runs next. With weights that add up to one all deadlines are met, so that in every prefix each source is less
than one block away from its share. Weights are exact rationals, never rounded: windows come from whole numbers in their
ratio. One task plans the blocks in slot order, holding a few numbers a source, and writes them as a table of one row a
block, which the rows are joined with. Where a source runs out, a new phase begins, in which the others keep their
proportions: no row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents, fresh, row_key, spread_rank, with_copies_placed, written
from lodestar.llm.op7_shard import keyed

#: Sources whose counts the driver and the planning task hold: some 20 MB.
MAX_SOURCES = 100_000
#: Rows that a file of a mixed table holds at most, about, and files.
FILE_ROWS, MAX_FILES = 100_000, 1_000_000
#: Blocks that the planning task passes on at once.
BATCH = 1 << 14


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot) of each block, in slot order, by the exact ratio of the weights.

    Sources of weight 0 follow when all others have run out, in proportion to their blocks. Memory is by source.
    """
    done = [0] * len(blocks)
    start = phase = 0
    for named in (True, False):
        of = [i for i, w in enumerate(weights) if (w > 0) == named]
        exact = {i: Fraction(weights[i]) if named else Fraction(blocks[i]) for i in of}
        scale = math.lcm(*[w.denominator for w in exact.values()])
        while active := [i for i in of if done[i] < blocks[i]]:
            parts = {i: int(exact[i] * scale) for i in active}
            whole = sum(parts.values())
            first = {i: done[i] for i in active}
            waiting = [(0, i) for i in active]  # release of the next block
            ready: list[tuple[int, int, int]] = []
            t, over = 0, False
            while not over:
                while waiting and waiting[0][0] <= t:
                    release, i = heapq.heappop(waiting)
                    heapq.heappush(ready, (-(-(done[i] - first[i] + 1) * whole // parts[i]), i, release))
                deadline, i, release = heapq.heappop(ready)
                yield i, done[i], phase, start + release, start + deadline, start + t
                done[i] += 1
                t += 1
                over = done[i] == blocks[i]
                heapq.heappush(waiting, ((done[i] - first[i]) * whole // parts[i], i))
            start += t
            phase += 1


def _planned(spark: SparkSession, sources: list[tuple[bool, str, int]], weights: list[float], block_rows: int) -> DataFrame:
    """One row a block: its source, phase, release, deadline, slot and the position of its first row."""
    blocks = [-(-n // block_rows) for *_, n in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        begin, found = 0, schedule(blocks, weights)
        while part := list(islice(found, BATCH)):
            begins = []
            for i, block, *_ in part:
                begins.append(begin)
                begin += min(block_rows, sources[i][2] - block * block_rows)
            of, *numbers = zip(*part, strict=True)
            names = [pa.array([sources[i][0] for i in of], pa.bool_()), pa.array([sources[i][1] for i in of], pa.string())]
            block, phase, release, deadline, slot = numbers
            # a window of a source of next to no weight may end beyond what a long holds
            late = [min(x, (1 << 63) - 1) for x in deadline]
            yield pa.RecordBatch.from_arrays(
                [*names, pa.array(block, pa.int64()), pa.array(phase, pa.int32()), pa.array(release, pa.int64()), pa.array(late, pa.int64()), pa.array(slot, pa.int64()), pa.array(begins, pa.int64())],
                ["no_source", "src", "block", "phase", "release", "deadline", "slot", "begin"],
            )

    kind = "no_source boolean, src string, block long, phase int, release long, deadline long, slot long, begin long"
    return written(spark.range(0, 1, 1, 1).mapInArrow(run, kind), "mix-schedule")[0]


def mix(
    df: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block_rows: int = 64, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per input row: id, source, h, block, phase, release, deadline, slot, mix_pos (gapless from 0).

    ``weights`` gives each source's target; without it a source weighs its rows to ``power``. Sources that ``weights``
    doesn't name, or gives 0, follow when all others have run out. Equal deadlines are settled by the sources' names. A
    null source is a source of its own; null texts and ids and repeated rows are placed like any other, a row counts as
    one however long its text; an empty table gives an empty result; other columns are ignored. The driver holds one
    number a source, for MAX_SOURCES sources at most: with more it raises ValueError.
    """
    narrow = keyed(df, id_col, text_col, source_col, seed)
    ranked, _ = spread_rank(narrow, ["no_source", "src"], ["h", "id", "crc", "bytes"], "rank", "of", "mix-ranks")
    counts = ranked.groupBy("no_source", "src").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give related ones a common name")
    counts = sorted(counts, key=lambda r: (r.no_source, r.src))
    target = [r.n**power if weights is None else weights.get(None if r.no_source else r.src, 0) for r in counts]
    if any(w < 0 or not math.isfinite(w) for w in target):
        raise ValueError("weights must be finite and not negative")
    planned = _planned(df.sparkSession, [tuple(r) for r in counts], target, block_rows)
    ranked = ranked.withColumn("block", F.expr(f"rank div {block_rows}L")).join(planned, ["no_source", "src", "block"])
    ranked = ranked.withColumn("mix_pos", F.col("begin") + F.expr(f"rank % {block_rows}L"))
    return ranked.select("id", "source", "h", "block", "phase", "release", "deadline", "slot", "mix_pos")


def mix_documents(df: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``df`` in mixed order: written as files, the rows follow the schedule from the first file to the last.

    Rows are those of ``df``, null ids and texts, ties and repeated rows included; an empty table stays empty. Texts move
    twice: to their places, then to their files.
    """
    [pos] = fresh(df, "__pos")
    places, _ = written(mix(df, seed=seed, id_col=id_col, text_col=text_col, **kwargs).select("id", "h", "mix_pos"), "mix-places")
    n = places.count()
    parts = max(1, min(-(-n // FILE_ROWS), MAX_FILES), min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    full = with_copies_placed(df, places, id_col, row_key(id_col, text_col, seed), {"mix_pos": pos})
    # positions are gapless, so that a row's file follows from its own: nothing is sampled, the join runs once
    return full.repartitionById(parts, F.expr(f"cast(`{pos}` * {parts}L div {max(1, n)}L as int)")).sortWithinPartitions(pos).drop(pos)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), seed=1).withColumnRenamed("id", "doc_id").drop("h")
