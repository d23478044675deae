"""Stupid-backoff language-model scores, computed relationally.

Documents are dealt into blocks of bounded size. For each order, every block sends each of its distinct n-grams once, with
its count, to the bucket that the n-gram's hash names; the bucket adds up what all blocks sent and answers each with the
totals. These are the count tables, partitioned by hash, and their join with the blocks' exploded n-grams; as a block
sends an n-gram once, one that occurs everywhere costs a bucket one entry a block. N-grams and totals travel as packed
columns, a row for each (block, bucket), never as a row for each occurrence. Scores add up in the document's block.

A document's own occurrences are taken off all counts, so that nothing vouches for itself. An n-gram can occur elsewhere
only if its first and its last n - 1 words do, so higher orders send only those that may.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import words
from lodestar.llm.common import bucketed, discard, documents, shuffles_end_with_writes, written

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a block and in a bucket's share, about.
BLOCK, BUCKET = 4 << 20, 8 << 20
#: Blocks and buckets that a small table has at least: their number follows the text, not the cluster.
SPREAD = 16
#: Files of a bucketed table at most, as Spark's ``spark.sql.sources.bucketing.maxBuckets``: beyond, a file holds more blocks.
MOST_TABLE_BUCKETS = 100_000


def pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes: the upper planes of small ones are zeros, which any codec shrinks."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Level:
    """The n-grams of one order in a block: each distinct one with its count, and each occurrence's share of its document."""

    def __init__(self, grams: np.ndarray, docs: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")  # keeps documents in order within an n-gram
        g, d = grams[order], docs[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        part = new.copy()
        part[1:] |= d[1:] != d[:-1]
        self.distinct, self.counts = g[new], np.diff(np.r_[np.flatnonzero(new), len(g)])
        own = np.diff(np.r_[np.flatnonzero(part), len(g)])[np.cumsum(part) - 1] if len(g) else np.zeros(0, np.int64)
        self.which, self.own = np.empty(len(g), np.int32), np.empty(len(g), np.int32)
        self.which[order], self.own[order] = np.cumsum(new) - 1, own


class Block:
    """The words of a block's documents, order by order."""

    def __init__(self, texts: list[str | None]) -> None:
        parts = [(h, of) for h, of, _, _, _ in words.blocks(texts)]
        self.h = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
        self.of = np.concatenate([np.zeros(0, np.int32), *(of.astype(np.int32) for _, of in parts)])
        self.n = np.bincount(self.of, minlength=len(texts))
        first = np.cumsum(self.n) - self.n
        self.place = (np.arange(len(self.h)) - first[self.of]).astype(np.int32)  # words before it in its document
        self.elsewhere: list[np.ndarray] = []  # for each order, how often the n-gram that ends here occurs in other documents

    def level(self) -> tuple[Level, np.ndarray]:
        """The next order's n-grams that may occur elsewhere, and where they end."""
        k = len(self.elsewhere)
        # Horner's rule from the last word back, so that a hash of k words grows by the word before them
        grown = self.h.copy()
        for j in range(1, k + 1):
            grown[j:] = grown[j:] * words.BASE + self.h[:-j] if j < len(grown) else grown[j:]
        may = self.place >= k
        if k:
            last = self.elsewhere[-1]
            may &= last > 0
            may[1:] &= last[:-1] > 0
        at = np.flatnonzero(may)
        return Level(words.mixed(grown[at] + np.uint64(k)), self.of[at]), at

    def learn(self, level: Level, at: np.ndarray, totals: np.ndarray) -> None:
        out = np.zeros(len(self.h), np.int64)
        out[at] = totals.astype(np.int64)[level.which] - level.own
        self.elsewhere.append(out)

    def scores(self, all_words: int, backoff: float) -> np.ndarray:
        """The sum of the logarithms of each document's word scores."""
        order = len(self.elsewhere)
        reach = np.minimum(self.place + 1, order)
        rest = np.maximum(1, all_words - self.n[self.of])
        best, logs = np.zeros(len(self.h), np.int64), -np.log(rest)  # a word seen nowhere else counts as a part of one
        for k, n in enumerate(self.elsewhere, 1):
            hit = np.flatnonzero(n)
            below = rest[hit] if k == 1 else self.elsewhere[k - 2][hit - 1]
            logs[hit] = np.log(n[hit] / below)
            best[hit] = k
        return np.bincount(self.of, (reach - best) * math.log(backoff) + logs, minlength=len(self.n))


def _totals(sent: DataFrame, parts: int) -> DataFrame:
    """Each bucket's totals, for every block that sent to it."""

    def add(batches):
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def solve():
            _, which = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
            total = np.bincount(which, np.concatenate([x[3] for x in held]).astype(np.float64)).astype(np.uint64)[which]
            ends = np.cumsum([len(x[2]) for x in held])
            answers = [pack(t) for t in np.split(total, ends[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in held], pa.int64()), pa.array([x[0] for x in held], pa.int64()), pa.array(answers, pa.binary())], ["block", "bucket", "totals"])

        for b in batches:
            for bucket, block, grams, counts in zip(*(b.column(c) for c in ("bucket", "block", "grams", "counts")), strict=True):
                bucket = bucket.as_py()
                if held and held[0][0] != bucket:
                    yield solve()
                    held = []
                held.append((bucket, block.as_py(), np.cumsum(unpack(grams.as_py()), dtype=np.uint64), unpack(counts.as_py())))
        if held:
            yield solve()

    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(add, "block long, bucket long, totals binary")


def _levels(block: Block, answers: pa.Table, orders: int) -> None:
    """Take the answers of all orders that were asked so far; a block may have had nothing to ask in some."""
    rows = sorted(zip(answers.column("order").to_pylist(), answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True))
    for order in range(1, orders + 1):
        level, at = block.level()
        block.learn(level, at, np.concatenate([np.zeros(0, np.uint64), *(unpack(r[2]) for r in rows if r[0] == order)]))


def lm_scores(df: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, log_score (sum over words of the logarithm), mean_log_score.

    A word scores c(n-gram) / c(its first words) for the longest n-gram that ends with it and occurs in other documents,
    times ``backoff`` for each order given up; a word that occurs nowhere else scores as a part of one occurrence among
    all other words. Copies vouch for each other. Null and empty texts have no words, log_score 0 and no mean; null ids
    and repeated rows are rows like others; an empty table gives an empty result; other columns are ignored.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(-(-size // BLOCK), min(SPREAD, 1 + (size >> 20)))
    bits = math.ceil(math.log2(max(size / BUCKET, SPREAD)))
    # dealt in turn, so that blocks are even whatever the ids
    rows = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)))
    n = min(MOST_TABLE_BUCKETS, n_blocks)
    with shuffles_end_with_writes(spark), bucketed(rows.repartition(n, "block"), n, "block", "blocks") as texts:
        return _scored(texts, kind, bits, order, backoff).withColumnRenamed("id", id_col)


def _scored(texts: DataFrame, kind: str, bits: int, order: int, backoff: float) -> DataFrame:
    """The scores of the blocks' texts, written."""

    def ask(table: pa.Table, answers: pa.Table | None, orders: int) -> pa.Table:
        block = Block(table.column("text").to_pylist())
        if answers is not None:
            _levels(block, answers, orders)
        level, _ = block.level()
        bucket = (level.distinct >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1] if len(bucket) else np.zeros(0, np.int64)
        pieces = zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True) if len(bucket) else ()
        out = [(int(bucket[a]), pack(np.diff(level.distinct[a:z], prepend=np.uint64(0))), pack(level.counts[a:z]), int(level.counts[a:z].sum())) for a, z in pieces]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        made = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
        of = table.column("block")[0].as_py()
        return pa.Table.from_arrays([pa.array([of] * len(out), pa.int64()), *made], ["block", "bucket", "grams", "counts", "n"])

    def asking(orders: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda table, got: ask(table, got, orders)

    sent_schema = "block long, bucket long, grams binary, counts binary, n long"
    blocks = texts.groupBy("block")
    answers: DataFrame | None = None
    made: list[str] = []
    all_words = 0
    for k in range(1, order + 1):
        if answers is None:
            first: Callable[[pa.Table], pa.Table] = lambda table: ask(table, None, 0)
            sent = blocks.applyInArrow(first, sent_schema)
        else:
            sent = blocks.cogroup(answers.groupBy("block")).applyInArrow(asking(k - 1), sent_schema)
        if k == 1:
            sent, sent_path = written(sent, "unigrams")
            made.append(sent_path)
            all_words = sent.agg(F.sum("n")).first()[0] or 0
        back, back_path = written(_totals(sent, min(MOST_TABLE_BUCKETS, 1 << bits)).withColumn("order", F.lit(k)), f"totals-{k}")
        made.append(back_path)
        answers = back if answers is None else answers.unionByName(back)

    def score(table: pa.Table, got: pa.Table) -> pa.Table:
        block = Block(table.column("text").to_pylist())
        _levels(block, got, order)
        sums = block.scores(all_words, backoff) if len(block.h) else np.zeros(table.num_rows)
        means = pa.array(sums / np.maximum(1, block.n), mask=block.n == 0)
        return pa.Table.from_arrays([table.column("id").combine_chunks(), pa.array(block.n.astype(np.int64)), pa.array(sums), means], ["id", "n_words", "log_score", "mean_log_score"])

    result = blocks.cogroup(answers.groupBy("block")).applyInArrow(score, f"id {kind}, n_words long, log_score double, mean_log_score double")
    scored, _ = written(result, "scores")
    discard(texts.sparkSession, *made)
    return scored


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six places: sums of logarithms vary beyond these with the order of adding."""
    scores = lm_scores(documents(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words FROM documents
),
w AS (SELECT rid, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
g AS (
  SELECT rid, i, w AS g1, lag(w) OVER p || ' ' || w AS g2, lag(w, 2) OVER p || ' ' || lag(w) OVER p || ' ' || w AS g3
  FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)
),
n AS (
  SELECT rid, i, greatest(1, count(*) OVER () - count(*) OVER (PARTITION BY rid)) AS rest,
         count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY rid, g1) AS n1,
         CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY rid, g2) END AS n2,
         CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY rid, g3) END AS n3
  FROM g
),
s AS (
  SELECT rid, (least(i, 3) - CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END) * ln(0.4)
              + CASE WHEN n3 > 0 THEN ln(n3 / lag(n2) OVER p) WHEN n2 > 0 THEN ln(n2 / lag(n1) OVER p) WHEN n1 > 0 THEN ln(n1 / rest) ELSE -ln(rest) END AS score
  FROM n WINDOW p AS (PARTITION BY rid ORDER BY i)
),
t AS (SELECT rid, count(*) AS n_words, sum(score) AS log_score FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_score, 0), 6) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN t USING (rid)
"""
