"""A star schema projected into a graph: rows are nodes, foreign keys are edges."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


#: table, id letter, key, type, name column, and foreign keys as (predicate, letter, key)
_TABLES = (
    ("customer", "C", "c_custkey", "Customer", "c_name", (("locatedIn", "N", "c_nationkey"),)),
    ("supplier", "S", "s_suppkey", "Supplier", "s_name", (("locatedIn", "N", "s_nationkey"),)),
    ("part", "P", "p_partkey", "Part", "p_name", ()),
    ("orders", "O", "o_orderkey", "Order", "o_orderpriority", (("placedBy", "C", "o_custkey"),)),
    ("nation", "N", "n_nationkey", "Nation", "n_name", (("inRegion", "R", "n_regionkey"),)),
    ("region", "R", "r_regionkey", "Region", "r_name", ()),
)


def nodes(spark: SparkSession, folder: str, types: tuple[str, ...] = ()) -> DataFrame:
    """(id, type, name) of the rows of all tables, or of those of some types."""
    parts = [table(spark, folder, t).select(_id(letter, key).alias("id"), F.lit(type_).alias("type"), F.col(name).alias("name")) for t, letter, key, type_, name, _ in _TABLES if not types or type_ in types]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, folder: str, predicates: tuple[str, ...] = ()) -> DataFrame:
    """(src, predicate, dst) of all foreign keys, or of those of some predicates."""
    parts = []
    for t, letter, key, _, _, links in _TABLES:
        parts += [table(spark, folder, t).select(_id(letter, key).alias("src"), F.lit(p).alias("predicate"), _id(to, k).alias("dst")) for p, to, k in links if not predicates or p in predicates]
    for p, to, k in (("contains", "P", "l_partkey"), ("suppliedBy", "S", "l_suppkey")):
        if not predicates or p in predicates:
            parts.append(table(spark, folder, "lineitem").select(_id("O", "l_orderkey").alias("src"), F.lit(p).alias("predicate"), _id(to, k).alias("dst")))
    return reduce(DataFrame.unionByName, parts)


def stamp(spark: SparkSession, folder: str) -> str:
    """A name for the state of the tables: their paths, sizes and times of change."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted({t for t, *_ in _TABLES} | {"lineitem"}):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        files = path.getFileSystem(conf)
        at, sizes = files.getFileStatus(path), files.getContentSummary(path)
        found.append(f"{at.getPath()} {at.getModificationTime()} {sizes.getLength()} {sizes.getFileCount()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:24]


def ends(spark: SparkSession, folder: str) -> DataFrame:
    """(id, outgoing, incoming): counts of the ends of all edges, one row for each node.

    All tables are counted in one aggregation by letter and key, before any id is
    made.  One for each table would shuffle keys that compress so well that a
    single task is given all of them.
    """
    parts = []

    def count(t: str, letter: str, key: str, outgoing: int, incoming: int) -> None:
        rows = table(spark, folder, t).where(F.col(key).isNotNull())
        parts.append(rows.select(F.lit(letter).alias("letter"), F.col(key).cast("long").alias("key"), F.lit(outgoing).cast("long").alias("o"), F.lit(incoming).cast("long").alias("i")))

    for t, letter, key, _, _, links in _TABLES:
        if links:
            count(t, letter, key, len(links), 0)
        for _, to, k in links:
            count(t, to, k, 0, 1)
    count("lineitem", "O", "l_orderkey", 2, 0)
    count("lineitem", "P", "l_partkey", 0, 1)
    count("lineitem", "S", "l_suppkey", 0, 1)
    sums = reduce(DataFrame.unionByName, parts).groupBy("letter", "key").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
    return sums.select(F.concat("letter", F.col("key").cast("string")).alias("id"), "outgoing", "incoming")
