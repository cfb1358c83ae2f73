"""Contiguous shards of nearly equal bytes, by a global prefix sum of sizes.

Rows are put in order by a range sort and written once, each with its range and
its place there.  Totals of chunks of CHUNK rows and of ranges are added up to
the first byte and the first row of each chunk; within a chunk a running sum
gives the first byte of every row, and the middle of a row decides its shard.
No window spans more than a chunk, the chunks of a range, or the ranges.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .workspace import free_name, store

CHUNK = 1024
SHARDS_BROADCAST = 1_000_000


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and one more."""
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1


def _hashed(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashed(f.dataType) for f in kind.fields)
    return _hashed(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType) and kind.typeName() != "variant"


def shard(docs: DataFrame, shards: int, order: tuple[str, ...] = ("doc_id",), size: str = "size") -> DataFrame:
    """The rows with shard (0 to shards - 1) and slot (0, 1, ... within the shard, in order).

    ``size`` names a column of bytes, at least 1 in every row.  A shard's bytes differ
    from an equal share by less than the size of the two rows at its ends.  Rows
    come in the order given, nulls first; rows of the same key are ordered by size and
    by the hash of all columns, so a key or a text that many rows share is cut
    like any others, and equal texts may be in different shards.  With fewer
    rows than shards some shards are empty; an empty table gives no rows.
    Columns shard and slot are replaced, all others stay.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    docs = docs.drop("shard", "slot")
    part, pos, chunk, of_part, of_chunk, of_shard, before, total, first, place, twice = (free_name(docs, f"_shard_{i}") for i in range(11))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    like = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if _hashed(f.dataType)))
    ranged = docs.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in (*order, size)), like, F.monotonically_increasing_id())
    placed = store(ranged.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(pos)), "ranges")
    placed = placed.withColumn(chunk, F.expr(f"`{pos}` div {CHUNK}"))

    def sum_before(value: str, window) -> Column:
        return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = placed.groupBy(F.col(part).alias(of_part)).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))  # a row for each task of the sort
    in_order = Window.orderBy(of_part)
    ranges = ranges.select(of_part, sum_before("bytes", in_order).alias("bytes"), sum_before("rows", in_order).alias(first), F.sum("bytes").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
    chunks = placed.groupBy(F.col(part).alias("p"), F.col(chunk).alias(of_chunk)).agg(F.sum(size).alias("n"))
    chunks = chunks.withColumn("n", sum_before("n", Window.partitionBy("p").orderBy(of_chunk)))
    offsets = chunks.join(F.broadcast(ranges), F.col("p") == F.col(of_part)).select(of_part, of_chunk, (F.col("n") + F.col("bytes")).alias(before), first, total)

    placed = placed.withColumn(twice, sum_before(size, Window.partitionBy(part, chunk).orderBy(pos)))
    found = placed.join(offsets, (F.col(part) == F.col(of_part)) & (F.col(chunk) == F.col(of_chunk)))
    wide = lambda c: F.col(f"`{c}`").cast("decimal(20,0)")  # noqa: E731  twice the bytes times the shards may pass 63 bits
    found = found.withColumn(twice, (2 * (wide(before) + wide(twice)) + wide(size)) * F.lit(shards).cast("decimal(10,0)")).withColumn(total, 2 * wide(total))
    found = found.select(*columns, F.expr(f"cast({twice} div {total} as int)").alias("shard"), (F.col(first) + F.col(pos)).alias(place))
    heads = found.groupBy(F.col("shard").alias(of_shard)).agg(F.min(place).alias(first))
    heads = F.broadcast(heads) if shards <= SHARDS_BROADCAST else heads
    return found.join(heads, F.col("shard") == F.col(of_shard)).select(*columns, "shard", (F.col(place) - F.col(first)).alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """Write each shard as a folder shard=N of Parquet files, its rows in the order of slot."""
    sharded.orderBy("shard", "slot").write.partitionBy("shard").parquet(path)
