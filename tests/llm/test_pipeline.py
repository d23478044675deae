from collections import Counter

import corpus_pipeline
from lodestar.llm import near_copies, op6_decontaminate, op7_shard, op8_language
from tests.llm.helpers import awkward, frame, rows_of


def _tables(spark, path):
    frame(spark).write.parquet(f"{path}/documents.parquet")
    leaked = awkward()[40][1] if len(awkward()[40][1] or "") > 60 else next(r[1] for r in awkward() if r[1] and len(r[1].split()) > 60)
    spark.createDataFrame([(1, " ".join(leaked.split()[:40]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    sf = str(tmp_path)
    _tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/{name}")
        seen.append((name, before.count(), docs.count()))
        if name != "sharding":
            assert docs.columns == columns
        if name == "language":
            assert {r.text for r in before.subtract(docs).collect()} == {r[1] for r in awkward() if not any(map(str.isalpha, r[1] or ""))}
        if name == "near_duplicates":
            groups = near_copies.similar_groups(before).select("root").distinct().count()
            assert docs.count() == groups and docs.subtract(before).count() == 0
        if name == "benchmark":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert op6_decontaminate.leaks(docs, bench).count() == 0 and before.count() > docs.count()
        if name == "mixing":
            assert rows_of(before) == rows_of(docs)
        if name == "sharding":
            assert rows_of(docs.drop("shard", "slot")) == rows_of(before)
            n = Counter(r.shard for r in docs.collect())
            assert max(n.values()) - min(n.values()) <= 1
    assert rows_of(corpus_pipeline.run(spark, sf)) == rows_of(docs)
    assert [s[0] for s in seen] == ["language", "near_duplicates", "benchmark", "mixing", "sharding"]


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    frame(spark).limit(0).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_operators_are_the_ones_of_the_package():
    assert corpus_pipeline.identify is op8_language.identify
    assert corpus_pipeline.shard_documents is op7_shard.shard_documents
