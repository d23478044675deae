"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences. Shared grams of MIN_TILE words, found by their Karp-Rabin hashes, are
the seeds of a (document, item) pair. The pair is then tiled: the longest common run of words that no tile covers yet
becomes a tile, again and again, until none of MIN_TILE words is left. The share of the item that tiles cover, wherever
they lie in the document, tells whether it leaked; passages whose parts were reordered are covered like others.

The benchmark goes to the executors in blocks of bounded size, each against all documents; documents never move.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm import words
from lodestar.llm.common import bounded_batches, documents, fresh, written

MIN_TILE = 5
COVERAGE = 0.5
#: Bytes of benchmark text in one block, about.
BLOCK_BYTES = 8 << 20


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of each tile, longest first; seeds: where grams of ``least`` words agree."""
    heap: list[tuple[int, int, int]] = []
    reached: dict[int, int] = {}  # diagonal -> end of the last run on it
    for i, j in sorted(seeds):
        if reached.get(i - j, -1) > i:
            continue
        n = least
        m = min(len(doc) - i, len(item) - j)
        while n < m and doc[i + n] == item[j + n]:
            n += 1
        reached[i - j] = i + n - least + 1
        heap.append((-n, i, j))
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = np.flatnonzero(in_doc[i : i + n] | in_item[j : j + n])
        if not len(taken):
            in_doc[i : i + n] = in_item[j : j + n] = True
            found.append((i, j, n))
            continue
        at = 0
        for t in [*taken.tolist(), n]:  # what is left between tiles waits for its turn
            if t - at >= least:
                heapq.heappush(heap, (at - t, i + at, j + at))
            at = t + 1
    return found


class Tiler:
    """A block of benchmark items, ready to be held against any text."""

    def __init__(self, items: list[tuple[object, str | None]], least: int = MIN_TILE, coverage: float = COVERAGE) -> None:
        self.least, self.coverage = least, coverage
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
        gram, of, at = [], [], []
        for h, text, _, first, end in words.blocks([t for _, t in items]):
            bounds = np.searchsorted(text, np.arange(first, end + 1))
            for k in range(first, end):
                self.words[k] = h[bounds[k - first] : bounds[k - first + 1]]
            g, start = words.grams(h, text, least)
            gram.append(g)
            of.append(text[start])
            at.append(start - bounds[text[start] - first])
        self.gram, self.of, self.at = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((gram, np.uint64), (of, np.int64), (at, np.int64)))
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.of, self.at = self.gram[order], self.of[order], self.at[order]
        self.sizes = np.array([len(w) for w in self.words])
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.gram >> np.uint64(42)] = True

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text number, item number, coverage, tiles, words of the longest) for each leak."""
        for h, of, _, first, end in words.blocks(texts):
            g, start = words.grams(h, of, self.least)
            maybe = np.flatnonzero(self.bits[g >> np.uint64(42)])
            lo, hi = (np.searchsorted(self.gram, g[maybe], side=s) for s in ("left", "right"))
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            bounds = np.searchsorted(of, np.arange(first, end + 1))
            at, lo, hi = start[maybe[hit]], lo[hit], hi[hit]
            text = of[at]
            cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                t = int(text[a])
                begin = bounds[t - first]
                for item, seeds in self._candidates(at[a:z] - begin, lo[a:z], hi[a:z]):
                    found = tiles(h[begin : bounds[t - first + 1]], self.words[item], seeds, self.least)
                    share = sum(n for _, _, n in found) / len(self.words[item])
                    if share >= self.coverage:
                        yield t, item, share, len(found), max(n for _, _, n in found)

    def _candidates(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Items that one text may cover, with their seeds; at: the text's grams that items have, as lo to hi.

        What seeds touch bounds what tiles can cover. It follows from the text's distinct grams, so that a phrase that
        many items share costs one step an item, not one for each time the text says it.
        """
        kinds, where = np.unique(lo, return_index=True)
        many = hi[where] - kinds
        kind = np.repeat(kinds, many)
        place = kind + np.arange(len(kind)) - np.repeat(np.cumsum(many) - many, many)
        order = np.lexsort((self.at[place], self.of[place]))
        kind, item, pos = kind[order], self.of[place][order], self.at[place][order]
        same = item[1:] == item[:-1]
        step = np.full(len(item), self.least)
        step[:-1][same] = np.minimum(self.least, (pos[1:] - pos[:-1])[same])
        cuts = np.flatnonzero(np.r_[True, ~same, True])
        touched = np.add.reduceat(step, cuts[:-1])
        for k in np.flatnonzero(touched >= self.coverage * self.sizes[item[cuts[:-1]]]).tolist():
            own = slice(cuts[k], cuts[k + 1])
            by_kind = np.argsort(kind[own], kind="stable")
            kind_of, pos_of = kind[own][by_kind], pos[own][by_kind]
            left, right = (np.searchsorted(kind_of, lo, side=s) for s in ("left", "right"))
            n = right - left
            j = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield int(item[cuts[k]]), list(zip(np.repeat(at, n).tolist(), pos_of[j].tolist(), strict=True))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple[object, str]]]]:
    """Blocks of the benchmark, one at a time, and if there is no other after it."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield k == n - 1, sorted(((r.item, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]) if x[0] is not None else (False, 0, x[1]))


def leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row for each document and item that leaked into it: ``id_col``, ``item_col``, coverage, n_tiles, longest.

    Items of fewer than ``least`` words never match: chance alone would. Null and empty texts match nothing; repeated
    documents and items give a row each; empty tables give an empty result; other columns are ignored.
    """
    ids, items = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    bounded_batches(df.sparkSession)
    for last, block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tiler = Tiler(shared.value, least, coverage)
            for b in batches:
                found = list(tiler(b.column("text").to_pylist()))
                if found:
                    t, item, share, n, longest = zip(*found, strict=True)
                    item_ids = pa.array([tiler.ids[i] for i in item], item_type)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(t)), item_ids, pa.array(share), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], ["id", "item", "coverage", "n_tiles", "longest"])

        found = rows.mapInArrow(run, f"id {ids}, item {items}, coverage double, n_tiles int, longest int")
        if not last:  # the next block takes this one's place on the driver and the executors
            found, _ = written(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` without the rows into which an item leaked; rows stay where they are.

    Null, empty and short texts stay; repeated rows go together; an empty benchmark or table changes nothing; columns of any
    names are kept; long texts are held whole against each item.
    """
    cols, [held] = df.columns, fresh(df, "__words")
    bounded_batches(df.sparkSession)
    for last, block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tiler = Tiler(shared.value, least, coverage)
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[x[0] for x in tiler(b.column(held).to_pylist())]] = False
                yield b.filter(pa.array(stays)).select(cols)

        df = df.withColumn(held, F.col(f"`{text_col}`").cast("string")).mapInArrow(run, df.schema)
        if not last:
            df, _ = written(df, "without-leaks")
            shared.destroy()
    return df


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
