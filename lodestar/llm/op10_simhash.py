"""SimHash near-dedup with BK-trees.

Fingerprints that differ in four bits at most link; groups are the connected components. The 64 bits are cut into six
blocks: of two linked fingerprints at least two blocks agree, so that each pair meets in one of the 15 shards that a
fingerprint belongs to (one for each two blocks and their value). A shard's BK-tree (children keyed by the integer
Hamming distance to the parent) is built where the shard lies and walked along the edges within the radius only. A
walk removes what it has linked, so a dense group of near copies costs about as many steps as it has members, and a
shard yields a spanning forest, never its pairs. Distinct fingerprints only enter: exact copies count once. A shard with
more than LARGE members is dealt into parts, and each two parts make a tree of their own, so that no task holds more than
about two parts and any two members still meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import MOST_HOT, bounded_batches, dealt_join, discard, documents, fresh, with_copies_placed, written

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Bits of each block; a fingerprint's shards are its pairs of blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
AGREE = len(BLOCKS) - RADIUS
#: Shingles whose bits are counted at once.
STEP = 1 << 16
#: Members of a shard up to which it is one tree.
LARGE = 1 << 16
#: A fingerprint's links meet in one task up to so many, or a MOST_HOT-th of all; minima of larger hubs are broadcast.
HUB = 256


def shingles(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's word shingles in order, STEP at most at a time; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(joined)]
    n = max(1, len(words) - shingle + 1)
    ends = ends[-1:] if len(words) < shingle else ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        to = min(n, at + STEP)
        pairs = zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 for a text without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingles(text, shingle):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


class BKTree:
    """Children keyed by the integer Hamming distance to their parent. Members found can be taken out; nodes stay as guides."""

    def __init__(self, members: list[int]) -> None:
        self.value, self.children, self.up = [], [], []
        for x in members:
            self._add(x)
        self.left = [1] * len(self.value)  # members not taken, in each node's part of the tree
        self.taken = [False] * len(self.value)
        for i in range(len(self.value) - 1, 0, -1):
            self.left[self.up[i]] += self.left[i]

    def _add(self, x: int) -> None:
        at, new = -1, len(self.value)
        if new:
            at = 0
            while (child := self.children[at].get(d := (x ^ self.value[at]).bit_count())) is not None:
                at = child
            self.children[at][d] = new
        self.value.append(x)
        self.children.append({})
        self.up.append(at)

    def take(self, x: int, radius: int) -> list[int]:
        """Remove and return the members within the radius of x, along the edges whose distances allow any."""
        out, stack = [], [0]
        while stack:
            at = stack.pop()
            if not self.left[at]:
                continue
            d = (x ^ self.value[at]).bit_count()
            if d <= radius and not self.taken[at]:
                self.taken[at] = True
                out.append(self.value[at])
                up = at
                while up >= 0:
                    self.left[up] -= 1
                    up = self.up[up]
            stack += [child for e, child in self.children[at].items() if abs(e - d) <= radius]
        return out


def forest(members: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct members: (other, first of its tree)."""
    tree = BKTree(members)
    seen: set[int] = set()
    for x in members:
        if x in seen:
            continue
        grown = [y for y in tree.take(x, radius) if y != x]
        while grown:
            y = grown.pop()
            seen.add(y)
            yield y, x
            grown += tree.take(y, radius)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64)), b.column("h")], ["id", "fp", "h"])

    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_hash(text_col).alias("h"), text.alias("text"))
    bounded_batches(df.sparkSession)
    return rows.mapInArrow(run, f"id {kind}, fp long, h long")


def _shards(fps: DataFrame, large: int) -> DataFrame:
    """Each fingerprint once for each two blocks (the pair's number and the bits of the two) and each two parts of that shard."""
    starts = np.cumsum([0, *BLOCKS])
    keys = []
    for k, blocks in enumerate(combinations(range(len(BLOCKS)), AGREE)):
        mask = sum(((1 << BLOCKS[i]) - 1) << int(starts[i]) for i in blocks)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    each = fps.select("fp", F.inline(F.array(*keys)))
    sizes, _ = written(each.groupBy("pair", "bits").count().filter(F.col("count") > large), "large-shards")
    each = each.join(sizes.withColumn("parts", F.ceil(F.col("count") / large)).drop("count"), ["pair", "bits"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != mine)
    cells = F.transform(others, lambda x: F.least(x, mine) * F.col("parts") + F.greatest(x, mine))
    return each.select("fp", "pair", "bits", F.explode(F.coalesce(cells, F.array(F.lit(0).cast("long")))).alias("cell"))


def _links(fps: DataFrame, large: int) -> DataFrame:
    """A spanning forest of links within each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        key = None
        for b in batches:
            n = b.num_rows
            pair, bits, cell, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "bits", "cell", "fp"))
            cuts = np.flatnonzero((pair[1:] != pair[:-1]) | (bits[1:] != bits[:-1]) | (cell[1:] != cell[:-1])) + 1
            # shards of one member end where they begin: only larger ones, and those at the batch's edges, are looked at
            starts, ends = np.r_[0, cuts], np.r_[cuts, n]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if n else ():
                if s == 0 and key == (pair[0], bits[0], cell[0]):
                    held += fp[s:e].view(np.uint64).tolist()
                elif e - s > 1 or s == 0 or e == n:
                    if len(held) > 1:
                        out += forest(held)
                    held, key = fp[s:e].view(np.uint64).tolist(), (pair[s], bits[s], cell[s])
            if out:
                both = np.array(out, np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])
        if len(held) > 1:
            both = np.array([*forest(held)], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    shards = _shards(fps, large).repartition("pair", "bits", "cell").sortWithinPartitions("pair", "bits", "cell", "fp")
    return shards.mapInArrow(run, "u long, v long")


def components(links: DataFrame, hub: int = HUB) -> tuple[DataFrame, str]:
    """The least member of each linked value's component (u, root), by alternating large and small stars.

    Minima are aggregated before they are shuffled and joined back, so that a hub's neighbours never meet in one list.
    Those of values with more links than ``hub``, or than a MOST_HOT-th of all if that is more, are broadcast: MOST_HOT
    values at most, whatever the table.
    """
    spark = links.sparkSession
    edges, path = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")

    def starred(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.union(e.select("v", "u").toDF("u", "v")) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        most = max(hub, -(-n // MOST_HOT))
        if n > most:
            told = both.join(F.broadcast(least.filter(F.col("n") > most)), "u", "left")
            joined = told.filter("m is null").select("u", "v").join(least.filter(F.col("n") <= most), "u").unionByName(told.filter("m is not null"))
        else:
            joined = both.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()

    total = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = total(edges)
    while True:
        n = 2 * state[0]
        nxt, new = written(starred(starred(edges, True, n), False, n), "links")
        discard(spark, path)
        edges, path = nxt, new
        now = total(edges)
        if now == state:
            return edges.select("u", F.col("v").alias("root")), path
        state = now


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, large: int = LARGE) -> DataFrame:
    """One row per input row: id, fp (signed long), h (hash of the text), root (least fp of its group), component_id (its smallest id).

    Null and empty texts have fingerprint 0 and link like any other; a group without an id has a null component_id;
    repeated rows are all returned; an empty table gives an empty result; other columns are ignored. No link is lost:
    shards beyond ``large`` members are dealt out, none of them is left out, and every row takes part.
    """
    prints, _ = written(_fingerprints(df, id_col, text_col, shingle), "fingerprints")
    fps, fps_path = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots, roots_path = components(_links(fps, large))
    at = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = at.groupBy("root").agg(F.min("low").alias("component_id"))
    at, _ = written(at.join(lowest, "root").select("fp", "root", "component_id"), "fingerprint-groups")
    discard(df.sparkSession, fps_path, roots_path)
    return dealt_join(prints, at, "fp")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """``df`` with one row of each group: the one with the smallest id (ties and groups without ids: by the text's hash).

    Null, empty and blank texts are one group; of repeated rows one stays; an empty table stays empty; other columns are
    kept, whatever their names; long texts count whole. Texts move once.

    ``groups`` are those of :func:`simhash_groups` unless others of the same shape are given (``near_copies.similar_groups``).
    """
    groups = simhash_groups(df, id_col, text_col) if groups is None else groups
    stays = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("id").alias("id"), F.min("h").alias("h"))
    [one] = fresh(df, "__one")
    kept = with_copies_placed(df, stays.withColumn("one", F.lit(1)), id_col, text_hash(text_col), {"one": one})
    return kept.filter(F.col(one) == 1).drop(one)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
