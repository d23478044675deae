"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else. No corpus-wide suffix array is
needed: each window of ``length`` bytes has an anchor, the least hash among the grams in it, so equal windows have equal
anchors. Consecutive windows with one anchor form a run.

1. Distinct texts (a text held twice is repeated as a whole) are cut into runs: (anchor, digest of the run's bytes).
2. A run whose digest occurs twice is repeated as a whole; one whose anchor's gram occurs once is not repeated at all.
3. What remains are different runs with the same anchor, the edges of repeated passages, and periodic runs. Their bytes are fetched, brought
   together by anchor, and windows with an equal elsewhere are found with suffix arrays: suffixes smaller than their
   successors are sorted directly, all others are induced by scanning the buckets of first bytes, and common prefixes of
   neighbours tell which windows repeat.
4. Anchors with more than HOT different runs don't go to one task: they are dealt into parts of about HOT runs. A suffix
   array for each part settles the windows that repeat within it; digests of the others, and of one window of each kind
   that repeats, are counted over the parts, pre-aggregated before the shuffle, which settles the rest.

Strings are judged on the input; matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_batches, bucketed, discard, documents, written

LENGTH = 400
GRAM = 32
#: Windows in a run at most, and bytes of a text that are hashed at once.
RUN, CHUNK = 512, 1 << 20
#: Different runs of one anchor up to which they stay together, about.
HOT = 64
#: Suffixes that one suffix array holds, about.
SUFFIXES = 60_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _grams(s: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling."""
    h, step = s.astype(np.uint64) + np.uint64(1), 1
    for m in _MIX:
        h = h[:-step] * m + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return h * np.uint64(0x9FB21C651E98DF25)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(h)
    x = np.concatenate([h, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs_of(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], list[bool]]]:
    """Anchor, start, number of windows and digest of each run of a text, for one chunk after the other.

    The last says if the anchor's gram occurs twice within the run: then windows of one run may equal each other.
    """
    for at in range(0, len(text) - length + 1, CHUNK):
        part = text[at : at + CHUNK + length - 1]
        width = length - GRAM + 1
        grams = _grams(np.frombuffer(part, np.uint8))
        anchor = _least(grams, width)
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        starts = np.r_[0, cuts]
        sizes = np.diff(np.r_[starts, len(anchor)])
        if sizes.max() > RUN:  # periodic text keeps one anchor for long
            pieces = -(-sizes // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, left = np.repeat(starts, pieces) + nth * RUN, np.repeat(sizes, pieces) - nth * RUN
            sizes = np.minimum(left, RUN)
        digest = xxhash.xxh3_128_digest
        digests, selves = [], []
        for s, n, a in zip(starts.tolist(), sizes.tolist(), anchor[starts], strict=True):
            digests.append(digest(part[s : s + n + length - 1]))
            selves.append(np.count_nonzero(grams[s : s + n + width - 1] == a) > 1)
        yield anchor[starts].view(np.int64), starts + at, sizes, digests, selves


def suffix_array(s: np.ndarray, ends: np.ndarray, windows: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage sort of the suffixes that begin windows, to ``depth`` bytes.

    ``s`` holds segments one after the other, ``ends`` where each ends, ``windows`` how many suffixes of each, from its
    start on, matter. Suffixes smaller than their successors are sorted directly; the rest is induced from them.
    """
    n = len(s)
    code = s.astype(np.int16)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    # smaller than its successor: the next different byte is larger; a segment's end counts as smallest
    step = np.sign(np.diff(code, append=np.int16(-1))).astype(np.int8)
    step[last] = -1
    told = np.flatnonzero(step)
    small = step[told[np.searchsorted(told, np.arange(n))]] > 0
    # of each segment only the suffixes of windows matter, and what they are induced from: all up to the next small one
    begins = np.r_[0, ends[:-1]]
    smalls = np.flatnonzero(small)
    k = np.searchsorted(smalls, begins + windows)
    to = np.where(k < len(smalls), smalls[np.minimum(k, max(0, len(smalls) - 1))] if len(smalls) else n, n)
    to = np.minimum(to, ends - 1)
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, begins, 1)
    np.add.at(keep, to + 1, -1)
    keep = np.cumsum(keep[:-1]) > 0

    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([s, np.zeros(depth, np.uint8)]), depth)
    direct = np.flatnonzero(small & keep)
    direct = direct[np.argsort(rows[direct].view(f"S{depth}").ravel(), kind="stable")]
    size = np.bincount(s[keep], minlength=256)
    bucket = np.cumsum(size) - size
    sa = np.full(int(size.sum()), -1, np.int64)
    # direct ones fill the rear of their buckets, in order
    many = np.bincount(s[direct], minlength=256)
    rear = bucket + size - many
    sa[rear[s[direct]] + np.arange(len(direct)) - np.repeat(np.cumsum(many) - many, many)] = direct
    head = bucket.copy()

    def induce(found: np.ndarray) -> None:
        before = found - 1
        before = before[(found > 0) & keep[before] & ~small[before] & ~last[before]]
        if len(before):
            c = s[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            n_of = np.bincount(c, minlength=256)
            sa[head[c] + np.arange(len(c)) - np.repeat(np.cumsum(n_of) - n_of, n_of)] = before
            head[:] += n_of

    ended = ends[keep[ends - 1] & ~small[ends - 1]] - 1  # suffixes of one byte follow from the end itself
    for c in np.flatnonzero(size):
        mine = ended[s[ended] == c]
        sa[head[c] : head[c] + len(mine)] = mine
        head[c] += len(mine)
    for c in np.flatnonzero(size):
        at = bucket[c]
        while at < head[c]:  # a bucket's own larger suffixes may induce more of them
            done, at = at, int(head[c])
            induce(sa[done:at])
        induce(sa[rear[c] : bucket[c] + size[c]])
    return sa


def repeated(segments: list[bytes], windows: list[int], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment, which of its first windows occur elsewhere among all segments' windows; which are the first of their kind."""
    s = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum([len(x) for x in segments])
    begins, many = np.r_[0, ends[:-1]], np.array(windows)
    sa = suffix_array(s, ends, many, length)
    first = np.zeros(len(s), bool)
    for b, w in zip(begins.tolist(), windows, strict=True):
        first[b : b + w] = True
    sa = sa[first[sa]]
    rows = np.lib.stride_tricks.sliding_window_view(s, length)
    found, equal = np.zeros(len(s), bool), np.zeros(len(sa), bool)
    for at in range(0, len(sa) - 1, 1 << 14):
        block = rows[sa[at : at + (1 << 14) + 1]]
        differ = block[1:] != block[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        hit = np.flatnonzero(common >= length) + at
        found[sa[hit]] = found[sa[hit + 1]] = equal[hit + 1] = True
    lead = np.zeros(len(s), bool)
    lead[sa[~equal]] = True
    return [(found[b : b + w], lead[b : b + w]) for b, w in zip(begins.tolist(), windows, strict=True)]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _distinct_texts(rows: DataFrame):
    """Each text once, with its copies, as a table bucketed by key."""
    n = min(100_000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bucketed(rows.groupBy("key").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies")), n, "key", "texts")


FOUND = "anchor long, digest binary, spans array<struct<from:int,to:int>>"


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of distinct texts (key, bytes, copies): for texts without copies, the windows that repeat, as (key, spans)."""
    spark = texts.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, copies, held, count = b.column("key"), b.column("copies"), [], 0
            for i, text in enumerate(b.column("bytes")):
                for anchor, start, size, digest, own in runs_of(text.as_py(), length):
                    of = pa.array(np.full(len(start), i))
                    held.append([keys.take(of), copies.take(of), pa.array(anchor), pa.array(digest, pa.binary()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(own, pa.bool_())])
                    count += len(start)
                if count > 50_000:
                    yield _batch(held)
                    held, count = [], 0
            if held:
                yield _batch(held)

    def _batch(held: list[list[pa.Array]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], ["key", "copies", "anchor", "digest", "start", "size", "own"])

    runs, runs_path = written(texts.mapInArrow(cut, "key binary, copies long, anchor long, digest binary, start int, size int, own boolean"), "runs")
    each = runs.groupBy("anchor", "digest").agg(F.sum("copies").alias("n"), F.max("own").alias("own"))
    whole = each.filter("n > 1").select("anchor", "digest", F.lit(None).cast("array<struct<from:int,to:int>>").alias("spans"))
    several = each.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("own").alias("any_own")).filter("kinds > 1 or any_own").select("anchor", "kinds")
    unclear = runs.join(several, "anchor").dropDuplicates(["anchor", "digest"]).select("key", "anchor", "digest", "start", "size", "kinds")
    got = unclear.join(texts.select("key", "bytes"), "key")
    got = got.select("anchor", "digest", "kinds", "size", F.substring("bytes", F.col("start") + 1, F.col("size") + F.lit(length - 1)).alias("segment"))
    got, got_path = written(got, "segments")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, bytes, int, int]] = []
        n = 0
        low = xxhash.xxh3_128_intdigest
        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def solve() -> pa.RecordBatch:
            flags = repeated([x[3] for x in held], [x[4] for x in held], length)
            out = []
            for (anchor, _, digest, segment, _, kinds), (found, lead) in zip(held, flags, strict=True):
                rest = []
                if kinds > HOT:
                    for i in np.flatnonzero(lead).tolist():
                        h1, h2 = divmod(low(segment[i : i + length]), 1 << 64)
                        rest.append({"at": None if found[i] else i, "h1": signed(h1), "h2": signed(h2)})
                if rest or found.any():
                    out.append((anchor, digest, [{"from": a, "to": b} for a, b in _spans(found)], rest))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.list_(pa.struct([("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["anchor", "digest", "spans", "rest"])

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("anchor", "part", "digest", "segment", "size", "kinds")), strict=True):
                if n >= SUFFIXES and x[:2] != held[-1][:2]:  # a part's segments stay together
                    yield solve()
                    held, n = [], 0
                held.append(x)
                n += x[4]
        if held:
            yield solve()

    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("kinds") / HOT))
    dealt = got.withColumn("part", part).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "digest")
    settled, settled_path = written(dealt.mapInArrow(arrays, FOUND + ", rest array<struct<at:int,h1:long,h2:long>>"), "settled")
    rest = settled.filter(F.size("rest") > 0).select("anchor", "digest", F.inline("rest"))
    twice = rest.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    late = rest.filter("at is not null").join(twice, ["h1", "h2"]).groupBy("anchor", "digest").agg(F.transform(F.collect_list("at"), lambda a: F.struct(a.alias("from"), (a + 1).alias("to"))).alias("spans"))
    parts = settled.filter(F.size("spans") > 0).select("anchor", "digest", "spans").unionByName(late).join(whole.select("anchor", "digest"), ["anchor", "digest"], "left_anti")
    found, found_path = written(whole.unionByName(parts), "repeats")
    discard(spark, got_path, settled_path)
    mine = runs.filter("copies = 1").join(found, ["anchor", "digest"])
    spans = F.coalesce(F.transform("spans", lambda x: F.struct((x["from"] + F.col("start")).alias("from"), (x["to"] + F.col("start")).alias("to"))), F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to"))))
    out, _ = written(mine.select("key", spans.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(spark, runs_path, found_path)
    return out


def removed_bytes(n: int, copies: int, spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes of a text, from the spans of its repeated windows."""
    if copies > 1:
        return [(0, n)] if n >= length else []
    out: list[list[int]] = []
    for a, b in sorted((x["from"], x["to"] + length - 1) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    A null text counts as empty; texts shorter than ``length`` stay whole; a text that two rows hold goes whole, if it is
    long enough; null ids and repeated rows are rows like others; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    bounded_batches(df.sparkSession)
    data = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), data.alias("bytes"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("bytes", 256), 1, 32)))
    fields = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, copies, found in zip(b.column("bytes"), b.column("copies").to_pylist(), b.column("spans").to_pylist(), strict=True):
                view = memoryview(text.as_buffer())
                gone = removed_bytes(len(view), copies, found, length)
                sha, at, kept = hashlib.sha256(), 0, []
                for a, z in [*gone, (len(view), len(view))]:
                    sha.update(view[at:a])
                    if with_text:
                        kept.append(bytes(view[at:a]))
                    at = z
                out.append((len(view), sum(z - a for a, z in gone), len(gone), sha.hexdigest(), b"".join(kept)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(fields) - 1]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], fields)

    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    with _distinct_texts(rows.select("key", "bytes")) as texts:
        full = texts.join(repeated_spans(texts, length), "key", "left").select("key", "bytes", "copies", "spans")
        done, _ = written(full.mapInArrow(apply, schema), "kept")
    return rows.select("id", "key").join(done, "key").select(F.col("id").alias(id_col), *fields[1:])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT rid, i, md5(b[i + 1:i + 400]) AS m FROM (SELECT rid, b, unnest(range(0, n - 399)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
e AS (SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 400, true)::INT AS new FROM r),
s AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM e) GROUP BY rid, k),
k AS (SELECT rid, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS y FROM s),
p AS (
  SELECT rid, string_agg(hex(b[y + 1:a]), '' ORDER BY a) AS kept, sum(z - a) AS gone, count(*) AS spans, max(z) AS last
  FROM k JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:n]))) AS kept_sha256
FROM d LEFT JOIN p USING (rid)
"""
