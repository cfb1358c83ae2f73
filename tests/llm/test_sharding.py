"""Shards against one pass over the sorted rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import sharding
from graphloom.llm.queries import QUERIES


def plain(rows, shards):
    """(shard, slot) of rows of (order key, size) in order."""
    total, start, out, slots = sum(s for _, s in rows), 0, [], {}
    for _, size in rows:
        shard = (2 * start + size) * shards // (2 * total)
        out.append((shard, slots.get(shard, 0)))
        slots[shard] = out[-1][1] + 1
        start += size
    return out


@pytest.mark.parametrize("shards", [1, 3, 8, 50])
def test_shards(spark, docs, texts, shards, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 4)
    sized = docs.withColumn("size", sharding.text_bytes()).withColumn("shard", F.lit("old")).withColumn("_shard_1", F.lit(7))
    got = sharding.shard(sized, shards).collect()
    rows = sorted(((i, len((t or "").encode()) + 1) for i, t in texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted((r["shard"], r["slot"], r["doc_id"] or 0, r["size"]) for r in got) == sorted((*p, i or 0, s) for p, (i, s) in zip(plain(rows, shards), rows))
    assert set(sized.columns) | {"slot"} == set(got[0].asDict()) and all(r["_shard_1"] == 7 for r in got)


def test_one_key_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 16)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit(5).cast("long").alias("size"))
    counts = {r["shard"]: (r["n"], r["top"]) for r in sharding.shard(df, 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert counts == {s: (375, 374) for s in range(8)}


def test_written_shards_and_empty(spark, docs, none, tmp_path):
    sized = docs.withColumn("size", sharding.text_bytes())
    made = sharding.shard(sized, 4)
    sharding.write(made, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["shard"], r["slot"]) for r in back.collect()) == sorted((r["shard"], r["slot"]) for r in made.collect())
    assert sharding.shard(none.withColumn("size", sharding.text_bytes()), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(sized, 0)


def test_query_is_native(spark):
    df = QUERIES["op12_sharding"](spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = df.collect()
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in got) and len(got) == len(texts)
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got)
