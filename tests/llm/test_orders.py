"""Mixing (1) and sharding (7)."""

import zlib
from collections import Counter

import pytest

from lodestar.llm import op1_mix, op7_shard
from tests.llm.helpers import awkward, clashing, frame, rows_of


@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 1}, {None: 1}])
def test_mix(spark, weights):
    rows = op1_mix.mix(frame(spark), weights, block_rows=2, seed=4).collect()
    assert sorted(r.mix_pos for r in rows) == list(range(len(awkward())))
    assert Counter(r.source for r in rows) == Counter(r[3] for r in awkward())
    assert all(r.release <= r.slot < r.deadline for r in rows)
    per = Counter((r.slot, r.source) for r in rows)
    assert len({s for s, _ in per}) == len(per) and max(per.values()) <= 2
    if weights and "s0" in weights:  # sources without a weight come last
        named = [r.mix_pos for r in rows if r.source in weights]
        assert max(named) < min(r.mix_pos for r in rows if r.source not in weights)


def test_mixed_documents_keep_rows_and_follow_the_schedule(spark):
    df = frame(spark)
    mixed = op1_mix.mix_documents(df, seed=4, block_rows=2)
    assert mixed.columns == df.columns
    got = [tuple(r) for r in mixed.collect()]
    assert sorted(got, key=repr) == rows_of(df)
    place = {(r.id, r.source): r.mix_pos for r in op1_mix.mix(df, seed=4, block_rows=2).collect()}
    unique = [r for r in got if Counter((x[0], x[3]) for x in awkward())[r[0], r[3]] == 1]
    assert [place[r[0], r[3]] for r in unique] == sorted(place[r[0], r[3]] for r in unique)


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        op1_mix.mix(frame(spark), {"s0": -1})


def test_shards(spark):
    rows = op7_shard.interleave(frame(spark), n_shards=7, seed=1).collect()
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    data = Counter((r[0], len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in awkward())
    assert Counter((r.id, r.bytes, r.crc) for r in rows) == data
    for source, total in Counter(r[3] for r in awkward()).items():  # every shard has its share of each source
        each = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(each[s] - total / 7) < 2 for s in range(7))


def test_shard_query_brute_force(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op7_shard.op7_shard(spark, str(tmp_path)).collect()
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in awkward())


def test_sharded_documents_keep_rows(spark, tmp_path):
    df = frame(spark)
    got = op7_shard.shard_documents(df, 5)
    assert rows_of(got.drop("shard", "slot")) == rows_of(df)
    assert len({(r.shard, r.slot) for r in got.collect()}) == df.count()
    op7_shard.write_shards(df, str(tmp_path / "out"), n_shards=5)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


def test_empty_and_clashing(spark):
    empty, wide = frame(spark).limit(0), clashing(frame(spark))
    assert op1_mix.mix(empty).count() == op7_shard.interleave(empty).count() == 0
    assert op1_mix.mix_documents(empty).count() == op7_shard.shard_documents(empty).count() == 0
    assert rows_of(op7_shard.interleave(wide, 3).select("id", "shard")) == rows_of(op7_shard.interleave(frame(spark), 3).select("id", "shard"))
    assert rows_of(op1_mix.mix_documents(wide)) == rows_of(wide)
    with pytest.raises(ValueError):
        op7_shard.interleave(empty, 0)
