from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from tests.llm.helpers import frame, rows_of

ROWS = [(i, f"text {i} of the table", "en", ("a", "b", None)[i % 3], 0) for i in range(1200)]


def dealt(spark, monkeypatch, weights):
    monkeypatch.setattr(corpus_pipeline, "MIX", {"seed": 1, "block_rows": 4, "weights": weights})
    df = frame(spark, ROWS)
    return corpus_pipeline.sharding(spark, corpus_pipeline.mixing(spark, df, ""), "")


@pytest.mark.parametrize("weights", [{"a": 8, "b": 1, None: 1}, {"a": 1, "b": 8, None: 1}, {"a": 1, "b": 4}])
def test_prefixes_of_every_shard_follow_the_weights(spark, monkeypatch, weights):
    out = dealt(spark, monkeypatch, weights)
    assert rows_of(out.drop("shard", "slot")) == rows_of(frame(spark, ROWS))
    shards = defaultdict(dict)
    for r in out.collect():
        shards[r.shard][r.slot] = r.source
    assert sorted(shards) == list(range(corpus_pipeline.N_SHARDS))
    for slots in shards.values():
        assert sorted(slots) == list(range(30))
        first = Counter(slots[i] for i in range(10))
        for source in ("a", "b", None):
            assert abs(first[source] - 10 * weights.get(source, 0) / sum(weights.values())) <= 2
        assert all(abs(n - 10) <= 1 for n in Counter(slots.values()).values())


def test_weights_change_the_rows_of_run(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    runs = []
    for weights in ({"a": 8, "b": 1, None: 1}, {"a": 1, "b": 8, None: 1}, {"a": 8, "b": 1, None: 1}):
        monkeypatch.setattr(corpus_pipeline, "MIX", {"seed": 1, "block_rows": 4, "weights": weights})
        runs.append(rows_of(corpus_pipeline.run(spark, str(tmp_path))))
    assert runs[0] == runs[2] != runs[1]
