"""Commits and the paths they touched: what an ingestion may take back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(touched: DataFrame) -> DataFrame:
    """(seq, eligible): whether a commit is the newest one on every path that it touched."""
    last = touched.groupBy("path").agg(F.max("seq").alias("last"))
    return touched.join(last, "path").groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("last")).alias("eligible"))


def split_paths(touched: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed paths, each with whether one commit alone has touched it."""
    wanted = touched.join(changed.select("path").distinct(), "path", "left_semi")
    counts = wanted.groupBy("path").agg(F.min("seq").alias("_a"), F.max("seq").alias("_b"))
    return changed.join(counts, "path").withColumn("exclusive", F.col("_a") == F.col("_b")).drop("_a", "_b")


def sweep(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Links without those to removed nodes (column id)."""
    return edges.join(removed.select(F.col("id").alias("dst")), "dst", "left_anti")


def writers(touched: DataFrame) -> DataFrame:
    """(path, first_writer, newest) documents by seq."""
    return touched.groupBy("path").agg(F.min_by("document", "seq").alias("first_writer"), F.max_by("document", "seq").alias("newest"))


def stamp(nodes: DataFrame, published: Column, now: str) -> DataFrame:
    """New nodes with published (where there is none) and indexed; stubs (column stub) stay without."""
    return nodes.withColumn("published", F.when(F.col("stub"), F.lit(None).cast("timestamp")).otherwise(F.coalesce("published", published))).withColumn("indexed", F.when(~F.col("stub"), F.lit(now)))
