"""Exact dedup (2), repeated strings (4), SimHash (10)."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import common, op2_exact_dedup, op4_suffix_dedup, op10_simhash
from tests.llm.helpers import awkward, clashing, frame, rows_of


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    groups = defaultdict(list)
    for r in awkward():
        groups[lower(r[1])].append(r[0])
    rows = op2_exact_dedup.content_sort_dedup(frame(spark), keep=keep).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in awkward())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((min if keep == "smallest" else max)(known) if known else None)
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == Counter(by_sha)  or (set(kept) == set(by_sha) and set(kept.values()) == {1})


def test_exact_dedup_of_one_hot_text_over_many_partitions(spark):
    rows = [(i, "hot " * 20 if i % 3 else f"t{i}", None, None, 0) for i in range(3000)]
    got = op2_exact_dedup.content_sort_dedup(frame(spark, rows), keep="largest").collect()
    hot = [r for r in got if r.group_size > 1]
    assert len(hot) == 2000 and {r.group_size for r in hot} == {2000} and {r.keep_id for r in hot} == {2999}
    assert sum(r.kept for r in got) == 1001


def test_exact_dedup_edges(spark):
    assert op2_exact_dedup.content_sort_dedup(frame(spark).limit(0)).count() == 0
    assert rows_of(op2_exact_dedup.content_sort_dedup(clashing(frame(spark)))) == rows_of(op2_exact_dedup.content_sort_dedup(frame(spark)))
    with pytest.raises(ValueError):
        op2_exact_dedup.content_sort_dedup(frame(spark), keep="any")


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), len(op4_suffix_dedup._spans(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256))])
def test_suffix_array_against_sorting(alphabet):
    rng = random.Random(7)
    for _ in range(60):
        base = bytes(rng.choice(alphabet) for _ in range(120))
        segments = [base[a : a + rng.randint(40, 60)] if rng.random() < 0.7 else bytes(rng.choice(alphabet) for _ in range(rng.randint(40, 80))) for a in (rng.randint(0, 60) for _ in range(rng.randint(1, 6)))]
        windows = [len(s) - 39 for s in segments]
        whole, ends = np.frombuffer(b"".join(segments), np.uint8), np.cumsum([len(s) for s in segments])
        sa = op4_suffix_dedup.suffix_array(whole, ends, np.array(windows), 40)
        begins = [0, *ends[:-1].tolist()]
        first = {b + i: s[i : i + 40] for b, s, w in zip(begins, segments, windows, strict=True) for i in range(w)}
        order = [first[i] for i in sa.tolist() if i in first]
        assert order == sorted(first.values())
        seen = Counter(first.values())
        got = op4_suffix_dedup.repeated(segments, windows, 40)
        assert [x[0].tolist() for x in got] == [[seen[s[i : i + 40]] > 1 for i in range(w)] for s, w in zip(segments, windows, strict=True)]


def passages():
    """A passage that many texts share, at different places and between different neighbours, periodic text and copies."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, other = text(700), text(450)
    rows = [text(rng.randint(0, 300)) + shared + text(rng.randint(0, 300)) for _ in range(90)]
    rows += [shared[: 400 + i] + text(50) for i in range(12)] + [text(100) + shared[-405:]]
    rows += [other + text(200) + other, "xy" * 600, "z" * 1500, text(900), text(399), other[:399]]
    rows += [text(500)] * 3
    return [(i, t, None, None, 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize("hot", [1, 64])
def test_repeated_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(op4_suffix_dedup, "HOT", hot)
    rows = passages()
    got = {r.doc_id: tuple(r)[1:] for r in op4_suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    want = brute_repeats([r[1].encode() for r in rows], 400)
    assert got == dict(enumerate(want))


def test_repeated_strings_of_awkward_rows(spark):
    rows = awkward()
    want = Counter(zip((r[0] for r in rows), brute_repeats([(r[1] or "").encode() for r in rows], 400), strict=True))
    assert Counter((r.doc_id, tuple(r)[1:]) for r in op4_suffix_dedup.suffix_dedup(clashing(frame(spark))).collect()) == want
    assert op4_suffix_dedup.suffix_dedup(frame(spark).limit(0)).count() == 0
    kept = op4_suffix_dedup.suffix_dedup(frame(spark), with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(op4_suffix_dedup, "CHUNK", 1000)
    rows = passages()[:20] + [(900, "q" * 5000, None, None, 0)]
    got = {r.doc_id: tuple(r)[1:] for r in op4_suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got == dict(zip((r[0] for r in rows), brute_repeats([r[1].encode() for r in rows], 400), strict=True))


def brute_print(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not found:
        return 0
    h = [xxhash.xxh64(" ".join(found[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(found) - 3))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def roots(items, linked):
    up = {i: i for i in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(items):
        for b in items[:n]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in items}


def test_simhash_groups(spark):
    rows = awkward()
    prints = [brute_print(r[1]) for r in rows]
    group = roots(range(len(rows)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    smallest = {}
    for i, r in enumerate(rows):
        smallest[group[i]] = min((x for x in (smallest.get(group[i]), r[0]) if x is not None), default=None)
    want = Counter((r[0], prints[i], smallest[group[i]]) for i, r in enumerate(rows))
    got = Counter((r.id, r.fp % 2**64, r.component_id) for r in op10_simhash.simhash_groups(clashing(frame(spark))).collect())
    assert got == want
    kept = op10_simhash.near_dedup(frame(spark))
    assert kept.count() == len(set(group.values())) and kept.columns == frame(spark).columns
    assert op10_simhash.simhash_groups(frame(spark).limit(0)).count() == 0
    assert op10_simhash.near_dedup(frame(spark).limit(0)).count() == 0


def test_long_text_is_counted_in_steps(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    whole = op10_simhash.fingerprint(text)
    monkeypatch.setattr(op10_simhash, "STEP", 64)
    assert op10_simhash.fingerprint(text) == whole == brute_print(text)


def test_forest_spans_components():
    for seed in range(40):
        rng = random.Random(seed)
        centres = [rng.getrandbits(64) for _ in range(4)]
        members = list({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(rng.randint(2, 200))})
        want = roots(members, lambda a, b: (a ^ b).bit_count() <= 4)
        edges = list(op10_simhash.forest(members)) if len(members) > 1 else []
        assert len(edges) == len(members) - len(set(want.values()))
        assert all(want[a] == want[b] for a, b in edges)


@pytest.mark.parametrize("large", [7, 1000])
def test_shards_dealt_into_parts_lose_no_link(spark, large):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    members = list({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(250)})
    members += [rng.getrandbits(64) for _ in range(100)]
    want = roots(members, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = lambda x: x - 2**64 if x >> 63 else x
    links = op10_simhash._links(spark.createDataFrame([(signed(x),) for x in members], "fp long"), large).collect()
    assert all(want[r.u % 2**64] == want[r.v % 2**64] for r in links)
    edges = {frozenset((r.u % 2**64, r.v % 2**64)) for r in links}
    got = roots(members, lambda a, b: frozenset((a, b)) in edges)
    assert len({(want[x], got[x]) for x in members}) == len(set(want.values())) == len(set(got.values()))


def test_linked_chains_across_shards(spark):
    chain = [0]
    for i in range(15):
        chain.append(chain[-1] ^ (0b1111 << (4 * i)))
    links = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)] + [(7, 7)], "u long, v long")
    got, _ = op10_simhash.components(links)
    assert {r.u: r.root for r in got.collect()} == {c: 0 for c in chain[1:]}


@pytest.mark.parametrize("hub", [2, 10**6])
def test_components_with_hubs(spark, hub):
    rng = random.Random(2)
    edges = [(5, 100 + i) for i in range(40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(140, 300)]
    want = roots(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in edges or (b, a) in edges)
    got, _ = op10_simhash.components(spark.createDataFrame(edges, "u long, v long"), hub)
    assert {r.u: r.root for r in got.collect()} == {x: r for x, r in want.items() if x != r}


def test_bucketed_tables_go_even_after_a_failure(spark):
    rows = spark.range(10).withColumn("v", F.lit("x"))
    with pytest.raises(RuntimeError, match="stop"), common.bucketed(rows, 3, "id", "test") as table:
        assert table.count() == 10
        assert any(t.name.startswith("lodestar_test_") for t in spark.catalog.listTables())
        raise RuntimeError("stop")
    assert not any(t.name.startswith("lodestar_test_") for t in spark.catalog.listTables())
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with pytest.raises(RuntimeError), common.shuffles_end_with_writes(spark):
        raise RuntimeError
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
