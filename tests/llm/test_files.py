from __future__ import annotations

from plumbline.llm import sharding

SF = "/root/testdata/sf0.001"


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "shard"])
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    plan = {r["doc_id"]: r["shard"] for r in sharding.shard_plan(docs, shards=4).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == plan


def test_written_shards_keep_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 9, "k", 3), (None, None, None, "_id", 4), (1, "a", 9, "k", 3)], "doc_id long, text string, shard int, shard_key string, _crc int")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=2, files_per_shard=1)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "_shard"])
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
