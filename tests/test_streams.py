"""Streams of contributions against the fold over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import merge
from graphloom.streaming import ingest

SCHEMA = "id string, key string, op string, seq long, source string, value string"


def contributions(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(f"n{r.randrange(4)}", op, op, i, f"d{i}", r.choice(["a", "b", "c", "", None])) for i in range(n) for op in merge.OPS]


@pytest.mark.parametrize("ordered", [True, False])
def test_any_split(spark, tmp_path, ordered):
    rows = contributions(60, 3)
    if not ordered:
        random.Random(5).shuffle(rows)
    for part in range(3):  # each a stream taken up again from the checkpoint
        some = rows[part::3] if not ordered else rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.keep_merged(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {(r["id"], r["key"]): r["values"] if r["value"] is None else r["value"] for r in ingest.merged(spark, f"{tmp_path}/out").collect()}
    table, want = spark.createDataFrame(rows, SCHEMA), {}
    for op in merge.OPS:
        mine = table.where(F.col("op") == op)
        folded = merge.merge_lists(mine).withColumnRenamed("values", "value") if op in merge.LIST else merge.merge_scalars(mine, op)
        want |= {(r["id"], r["key"]): r["value"] for r in folded.collect()}
    assert got == want


def test_lateness(spark, tmp_path):
    for part, rows in enumerate(([("x", 1), ("y", 10), ("z", 100)], [("late", 5), ("w", 101)])):
        spark.createDataFrame([("n", "k", "firstWriteWin", seq, f"d{seq}", v) for v, seq in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.keep_merged(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", lateness=50).awaitTermination()
    row = ingest.merged(spark, f"{tmp_path}/out").first()
    want = ""
    for v, seq in (("x", 1), ("y", 10), ("z", 100), ("w", 101)):
        want = ingest.flag(want, v, f"d{seq}")
    assert row["value"] == want and row["late"] == 1 and row["conflict"] and row["seq"] == 101


def test_repeated_batch_counts_once(spark, tmp_path):
    rows = [(1, "a", "d1"), (2, "b", "d2")]
    assert ingest.step("firstWriteWin", ingest.step("firstWriteWin", [], rows), rows) == rows
    assert ingest.step("union", [(1, "a", "d1")], [(0, "a", "d0"), (3, None, "d3")]) == [(0, "a", "d0")]
    with pytest.raises(ValueError):
        ingest.step("odd", [], rows)
