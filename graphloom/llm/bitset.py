"""A one-hash Bloom filter of bounded size, as a small table, to thin a table before a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import free_name

MOST_BITS = 1 << 26  # a million rows of 64 bits at most


def mark(rows: DataFrame, ids: DataFrame, flag: str, key: str = "doc_id") -> DataFrame:
    """Rows with a boolean: false only where the key is surely none of the distinct ids (one column).

    The filter has 16 bits for each id up to MOST_BITS, so what is broadcast
    has a fixed bound; beyond it more other rows are marked, and results stay right.
    """
    n = ids.count()
    bits = 1 << 10
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
    slot, word, held = (free_name(rows, c) for c in ("_p", "_word", "_bits"))
    words = ids.select(place(ids.columns[0]).alias("p")).groupBy(F.shiftright("p", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias(held))
    placed = rows.withColumn(slot, place(key)).withColumn(word, F.shiftright(slot, 6))
    hit = F.expr(f"shiftrightunsigned({held}, cast({slot} % 64 as int)) & 1L") == 1
    return placed.join(F.broadcast(words), word, "left").select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(flag))


def thin(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key may be among the ids: all that are, and some others."""
    flag = free_name(rows, "_may")
    return mark(rows, ids, flag, key).where(flag).drop(flag)
