"""Groups of texts whose word shingles have a Jaccard similarity of 0.8 or more, for the pipeline.

Operator 10's method with a wide radius, an exact check, and an exact way for what it leaves:

1. Each shingle set has a SimHash. At a similarity of 0.8 two differ in 9.7 bits of 64 on average (standard deviation 2.9),
   where no blocks of bits agree any more, so a fingerprint's shards aren't pairs of blocks but its MinHash bands (BANDS
   keys of ROWS minima each: a pair at 0.8 shares no key with a probability of 5e-8, a more similar one with less).
2. A shard's BK-tree is walked with RADIUS bits, from the most central member on. Each pair it gives is checked with its
   whole shingle sets; those that hold make components.
3. A walk gives a spanning forest, in which a pair that fails the check may hide one that holds, and a rare pair is more than
   RADIUS bits apart. So an exact join follows over all sets that met any: two that are similar enough share one of their
   rarest shingles, so that sets which have only a common passage or line don't meet. Those that step 2 left in different
   components are compared, so that no pair that shares one is left out.

Groups are the connected components of all pairs that hold.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_batches, dealt_join, discard, written
from lodestar.llm.op10_simhash import BKTree, components, shingles, text_hash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Bits in which fingerprints differ that a tree links, three standard deviations beyond the mean at 0.8; members of a tree, about.
RADIUS, TREE = 18, 1 << 12
#: Shingles whose minima are taken at once, and that a batch holds before it is passed on.
STEP, BATCH = 512, 1 << 17
#: Shingles before one, in the order of rarity, that tell whether a pair has already met.
BEFORE = 16

_rng = np.random.default_rng(10)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, shingle)]))


def simhash(held: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a shingle set; 0 for an empty one."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(held), BATCH):
        ones += np.unpackbits(held[at : at + BATCH].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(held), bitorder="little").view(np.uint64)[0])


def walked(members: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints: (other, the one whose walk took it).

    The most central, by the majority of each bit, comes first: it takes a dense group in one walk.
    """
    bits = np.unpackbits(np.array(members, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    far = (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(members))).sum(axis=1)
    members = [members[i] for i in np.argsort(far, kind="stable").tolist()]
    tree = BKTree(members)
    seen: set[int] = set()
    for first in members:
        if first in seen:
            continue
        grown = deque([first])
        while grown:
            x = grown.popleft()
            for y in tree.take(x, radius):
                if y != x:
                    seen.add(y)
                    grown.append(y)
                    yield y, x


def bands(held: np.ndarray) -> np.ndarray:
    """The keys under which a shingle set meets similar ones; an empty set has none."""
    if not len(held):
        return np.zeros(0, np.uint64)
    low, least = held.astype(np.uint32)[:, None], np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(low), STEP):
        np.minimum(least, ((low[at : at + STEP] ^ _XOR) * _TIMES).min(axis=0), out=least)
    data, width = least.tobytes(), 4 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[i * width : (i + 1) * width], i) for i in range(BANDS)], np.uint64)


def _each(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """First and last text and the shingle sets of a few texts at a time, BATCH shingles about."""
    start, size, rows = 0, 0, []
    for i, x in enumerate(texts):
        rows.append(shingle_set(x.as_py(), shingle))
        size += len(rows[-1])
        if size >= BATCH or i + 1 == len(texts):
            yield start, i + 1, rows
            start, size, rows = i + 1, 0, []


def _digest(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate(parts).view(np.int64)))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("id"), text_hash(text_col).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _prints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, h (hash of the text), set (a hash of the shingle set), n (its size), fp (its SimHash) and keys of each row: no text, no set."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, sets in _each(b.column("text"), shingle):
                own = b.slice(start, end - start)
                digests = _signed([_digest(r) for r in sets])
                columns = [own.column("id"), own.column("h"), digests, pa.array([len(r) for r in sets], pa.int32()), _signed([simhash(r) for r in sets]), _lists([bands(r) for r in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "set", "n", "fp", "keys"])

    return _rows(df, id_col, text_col).mapInArrow(run, f"id {kind}, h long, set long, n int, fp long, keys array<long>")


def _shards(prints: DataFrame) -> tuple[DataFrame, str]:
    """A table (key, part, set, fp) and its path: each set under all its keys that another set has too. A key of more than
    TREE sets is dealt into parts.
    """
    # one row a set, so that copies of one text don't meet under its keys
    one_each = prints.groupBy("set").agg(F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")).select("set", "fp", F.explode("keys").alias("key"))
    each, path = written(one_each, "similar-each")
    sizes = each.groupBy("key").agg(F.min("set").alias("first"), F.max("set").alias("last"), F.ceil(F.count("*") / TREE).alias("parts"))
    shared = dealt_join(each, sizes.filter("first <> last").select("key", "parts"), "key")
    shards = written(shared.select("key", F.pmod(F.xxhash64("set"), "parts").alias("part"), "set", "fp"), "similar-shards")
    discard(prints.sparkSession, path)
    return shards


def tree_pairs(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): pairs of sets that the shards' BK-trees link, u > v; a pair that meets in several shards comes several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int, int]]:
            for b in batches:
                fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64).tolist()
                yield from zip(b.column("key").to_pylist(), b.column("part").to_pylist(), fp, b.column("set").to_pylist(), strict=True)

        def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both.max(axis=1)), pa.array(both.min(axis=1))], ["u", "v"])

        out: list[tuple[int, int]] = []
        for _, shard in groupby(rows(), lambda r: r[:2]):
            of: dict[int, list[int]] = {}
            for _, _, fp, own in shard:
                of.setdefault(fp, []).append(own)
            out += [(x, same[0]) for same in of.values() for x in same[1:]]
            out += [(of[y][0], of[x][0]) for y, x in walked([*of], radius)] if len(of) > 1 else []
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return shards.repartition("key", "part").sortWithinPartitions("key", "part", "set").mapInArrow(run, "u long, v long")


def _marked(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose column isn't wanted: a bitmap of 8 MB at most, so that the others needn't move."""
    spot = F.shiftrightunsigned(column, 38)
    place = {"part": F.shiftright(spot, 15), "bit": spot.bitwiseAND(F.lit(32767).cast("long"))}
    marks = wanted.withColumns(place).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("marks"))
    found = rows.withColumns(place).join(F.broadcast(marks), "part")
    return found.filter("shiftright(cast(conv(hex(substring(marks, cast(bit div 8 + 1 as int), 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1").select(*rows.columns)


def _wanted_sets(df: DataFrame, prints: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(set, held): the shingle sets of the wanted ones, made again from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, sets in _each(b.column("text"), shingle):
                digests = _signed([_digest(r) for r in sets])
                yield pa.RecordBatch.from_arrays([digests, _lists(sets)], ["set", "held"])

    of_row = F.xxhash64("id", "h")
    one_each = prints.join(wanted, "set").groupBy("set").agg(F.min(of_row).alias("of_row"))
    texts = _marked(_rows(df, id_col, text_col).withColumn("of_row", of_row), one_each, "of_row").select("text")
    # what the bitmap lets through besides is dropped by the join; equal rows give equal sets
    return texts.mapInArrow(run, "set long, held array<long>").join(wanted, "set").groupBy("set").agg(F.any_value("held").alias("held"))


def _rarest(sets: DataFrame, p: int, q: int) -> tuple[DataFrame, str]:
    """A table (set, n, token, small, at, before) and its path: of each set's shingles in the order of their rarity among all sets, so
    many that any two sets with a similarity of p / q share one, which is ``small`` in the one with fewer shingles; shingles
    of one set only come first in that order and are left out. ``at`` is the place in the order, ``before`` has the BEFORE shingles
    in front of it.
    """
    spark = sets.sparkSession
    tokens, path = written(sets.select("set", "n", F.explode("held").alias("token")), "similar-shingles")
    shared = tokens.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    known = dealt_join(tokens, shared, "token")
    ordered = W.partitionBy("set").orderBy("times", "token")
    nth, before = F.row_number().over(ordered), F.collect_list("token").over(ordered.rowsBetween(-BEFORE, -1))
    own = F.col("n") - F.count("*").over(W.partitionBy("set"))
    # a set no larger than its partner shares at least 2p / (p + q) of its own shingles, any set p / q of them
    spare = lambda a, b: F.col("n") - F.expr(f"-((-n * {a}L) div {b}L)") + 1
    known = known.withColumns({"at": nth + own, "before": before}).filter(F.col("at") <= spare(p, q))
    rare = written(known.select("set", "n", "token", (F.col("at") <= spare(2 * p, p + q)).alias("small"), "at", "before"), "similar-rare")
    discard(spark, path)
    return rare


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, h (hash of the text), root (least set of its group), component_id (its smallest id).

    Pairs come from the BK-trees first, then from the exact join of what these left apart. Words are split at white space
    and compared without ASCII case; a text of fewer words than a shingle is one shingle; null, empty and blank texts are one group. Every row takes part, whole texts of any length, repeated rows are all
    returned; an empty table gives an empty result; other columns are ignored, whatever their names. Keys are made for
    similarities of 0.8 and more; below it ``similarity`` finds fewer of the pairs.
    """
    spark = df.sparkSession
    ratio = Fraction(str(similarity))
    p, q = ratio.numerator, ratio.denominator

    def holding(pairs: DataFrame) -> tuple[DataFrame, str]:
        """Those of the pairs (u, v) whose sets are similar enough, as a table and its path."""
        pairs, pairs_path = written(pairs.distinct(), "similar-candidates")
        both, both_path = written(dealt_join(pairs, sets.select("set", "held").toDF("u", "a"), "u"), "similar-halves")
        both = dealt_join(both, sets.select("set", "held").toDF("v", "b"), "v").withColumn("common", F.size(F.array_intersect("a", "b")))
        links = written(both.filter(F.col("common") * q >= (F.size("a") + F.size("b") - F.col("common")) * p).select("u", "v"), "similar-links")
        discard(spark, pairs_path, both_path)
        return links

    prints, prints_path = written(_prints(df, id_col, text_col, shingle), "shingle-prints")
    shards, shards_path = _shards(prints)
    wanted, wanted_path = written(shards.select("set").distinct(), "similar-wanted")
    sets, sets_path = written(_wanted_sets(df, prints, wanted, id_col, text_col, shingle).withColumn("n", F.size("held")), "similar-sets")
    near, near_path = holding(tree_pairs(shards))
    discard(spark, shards_path, wanted_path)
    roots, roots_path = components(near)
    rare, rare_path = _rarest(sets, p, q)
    columns = ["token", "set", "n", "small", "at", "before"]
    at, at_path = written(rare.join(roots.toDF("set", "root"), "set", "left").select(*columns, F.coalesce("root", "set").alias("root")), "similar-rooted")
    discard(spark, rare_path, roots_path)
    room = F.max(F.col("n") - F.col("at")).alias("room")
    parts = at.groupBy("token", "root").agg(F.count("*").alias("rows"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("small").alias("small"), room)
    fits = (F.col("x.small") | F.col("y.small")) & (F.col("x.hi") * q >= F.col("y.lo") * p) & (F.col("y.hi") * q >= F.col("x.lo") * p)
    fits &= (F.least("x.room", "y.room") + 1) * (p + q) >= (F.col("x.lo") + F.col("y.lo")) * p
    # the smaller component of a cell comes first, so that the rows made on the way are those of the smaller ones
    apart = parts.alias("x").join(parts.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.struct("x.rows", "x.root") < F.struct("y.rows", "y.root")) & fits)
    apart = apart.select(F.col("x.token").alias("token"), F.col("x.root").alias("r1"), F.col("y.root").alias("r2"))
    one, two = at.toDF("token", "u", "un", "us", "ua", "ub", "r1"), at.toDF("token", "v", "vn", "vs", "va", "vb", "r2")
    cross = apart.join(one, ["token", "r1"]).join(two, ["token", "r2"]).filter(F.greatest("un", "vn") * p <= F.least("un", "vn") * q)
    cross = cross.filter("us and un <= vn or vs and vn <= un")
    # a similar pair has enough left where it first meets, and where it has met before it needn't be made again
    cross = cross.filter((F.least(F.col("un") - F.col("ua"), F.col("vn") - F.col("va")) + 1) * (p + q) >= (F.col("un") + F.col("vn")) * p)
    cross = cross.filter(~F.arrays_overlap("ub", "vb"))
    more, more_path = holding(cross.select("u", "v"))
    discard(spark, at_path, sets_path)
    roots, _ = components(near.union(more))
    discard(spark, near_path, more_path)

    rows = prints.select("id", "h", "set")
    low = rows.groupBy("set").agg(F.min("id").alias("low")).join(roots.toDF("set", "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    lowest = low.groupBy("root").agg(F.min("low").alias("component_id"))
    low, _ = written(low.join(lowest, "root").select("set", "root", "component_id"), "similar-groups")
    out, _ = written(dealt_join(rows, low, "set").select("id", "h", "root", "component_id"), "similar-rows")
    discard(spark, prints_path)
    return out
