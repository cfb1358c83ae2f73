"""Traversal: degrees, breadth-first search both ways, caps, subgraphs and boundary stubs.

Edges are rows (src, predicate, dst); parallel edges count and dangling targets
count to degrees, but aren't visited.  A graph that is searched more than once is
laid out as an ``Adjacency``, of which each hop reads the frontier's buckets only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NodeNotFound
from ..session import cut

BUCKETS = 64
SOUGHT = 500  # ids that are sought by value; more are joined


def reverse_index(edges: DataFrame) -> DataFrame:
    """Edges by target: (dst, src, n), n of them parallel."""
    return edges.groupBy("dst", "src").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, out_degree, in_degree, degree) by one partial aggregation; of the given ids (column id) only, if there are any given."""
    side = lambda column, out: _among(edges.select(F.col(column).alias("id"), F.lit(out).alias("outgoing"), F.lit(1 - out).alias("incoming")), ids)
    return degrees_of(side("src", 1).union(side("dst", 0)))


def _among(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    return rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")


def degrees_of(ends: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``degrees`` from counts of ends (id, outgoing, incoming), of which a node may have several rows."""
    sums = _among(ends, ids).groupBy("id").agg(F.sum("outgoing").alias("out_degree"), F.sum("incoming").alias("in_degree"))
    return sums.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Adjacency:
    """A graph laid out for traversal under a path that all executors reach.

    Tables ``out`` and ``in`` have each edge by its source and by its target,
    ``nodes`` the nodes and ``degrees`` the degrees, all in buckets by the hash of
    their first id and sorted by it.  Each is written when it is first needed,
    from the edges and nodes given; a table that is there already is taken as it is.
    """

    def __init__(self, spark: SparkSession, root: str, edges: Callable[[], DataFrame], nodes: Callable[[], DataFrame]):
        self.spark, self.root, self._edges, self._nodes = spark, root.rstrip("/"), edges, nodes
        self._open: dict[str, DataFrame] = {}

    def _made(self, table: str) -> DataFrame:
        if table == "nodes":
            return self._nodes()
        if table == "degrees":
            count = lambda t, out: self.table(t).groupBy("id").agg(F.count("*").alias("n")).select("id", F.when(F.lit(out), F.col("n")).otherwise(0).alias("outgoing"), F.when(F.lit(out), 0).otherwise(F.col("n")).alias("incoming"))
            return degrees_of(count("out", True).unionByName(count("in", False)))
        a, b = ("dst", "src") if table == "in" else ("src", "dst")
        return self._edges().select(F.col(a).alias("id"), "predicate", F.col(b).alias("next"))

    def table(self, table: str) -> DataFrame:
        """out and in: (id, predicate, next); nodes; degrees; all with their bucket."""
        if table not in self._open:
            path = f"{self.root}/{table}"
            done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
                rows = self._made(table).withColumn("bucket", _bucket("id"))
                # one file or more for each bucket: a bucket that holds a hub is split
                rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)
            self._open[table] = self.spark.read.parquet(path)
        return self._open[table]

    def of(self, table: str, ids: DataFrame) -> DataFrame:
        """A table's rows of some ids (a written table with a column id), from their buckets only."""
        rows = self.table(table)
        some = [r[0] for r in ids.select("id").limit(SOUGHT + 1).collect()]
        if len(some) <= SOUGHT:
            buckets = [r[0] for r in ids.select(_bucket("id").alias("b")).distinct().collect()]
            return rows.where(F.col("bucket").isin(buckets) & F.col("id").isin(some)).drop("bucket")
        return rows.withColumnRenamed("bucket", "_b").join(ids.select("id", _bucket("id").alias("_b")), ["_b", "id"], "left_semi").drop("_b")


def bfs(edges: DataFrame | Adjacency, nodes: DataFrame | None, seeds: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(id, hop) of the nodes within depth hops of the seeds (column id), seeds left out.

    Targets without a node are skipped; a depth of 0 or less gives none.  Every
    hop reads the links once, or the frontier's buckets of an adjacency, which
    has its own nodes; its frontier is written once.
    """
    laid = edges if isinstance(edges, Adjacency) else None
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = None if laid else edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    visited = cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = visited
    for hop in range(1, depth + 1):
        near = laid.of("in" if backward else "out", frontier) if laid else steps.join(frontier.select("id"), "id", "left_semi")
        fresh = near.select(F.col("next").alias("id")).distinct().join(visited, "id", "left_anti")
        fresh = laid.of("nodes", cut(fresh)) if laid else nodes.select("id").join(fresh, "id", "left_semi")
        frontier = cut(fresh.select("id").distinct().withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.where("hop > 0")


def cap(pool: DataFrame, edges: DataFrame | Adjacency, most: int) -> DataFrame:
    """The most ids of a pool, by degree from the highest and then id; the pool itself where it isn't larger or most isn't positive."""
    if most <= 0:
        return pool
    known = edges.of("degrees", pool) if isinstance(edges, Adjacency) else degrees(edges, pool)
    ranked = pool.join(known.select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.orderBy(F.desc("degree"), "id").limit(most).drop("degree")


@dataclass(frozen=True)
class Subgraph:
    """Ids with what they are (seed, direct, backlink or stub), and the counts of the search."""

    members: DataFrame
    direct: int
    backlinks: int
    direct_truncated: bool
    backlinks_truncated: bool


def subgraph(nodes: DataFrame | None, edges: DataFrame | Adjacency, seed: str, depth: int = 1, direct_cap: int = 4096, backlink_cap: int = 1024, keep: Column | None = None, stubs: bool = False) -> Subgraph:
    """The surroundings of a node, in both directions.

    Both pools are searched apart and capped after the whole search; the filter
    comes after the caps, never applies to the seed, and nodes that fail it are
    still passed through.  Stubs are existing targets of members that aren't
    members.  NodeNotFound without the seed.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    laid = edges if isinstance(edges, Adjacency) else None
    start = (laid.of("nodes", laid.spark.createDataFrame([(seed,)], "id string")) if laid else nodes.where(F.col("id") == seed)).select("id").limit(1)
    if start.isEmpty():
        raise NodeNotFound(seed)
    pools, counts = [], []
    for backward, most in ((False, direct_cap), (True, backlink_cap)):
        pool = cut(bfs(edges, nodes, start, depth, backward).select("id"))
        n = pool.count()
        counts.append(n)
        pools.append(cap(pool, edges, most) if 0 < most < n else pool)
    direct, back = pools
    found = direct.withColumn("part", F.lit("direct")).unionByName(back.join(direct, "id", "left_anti").withColumn("part", F.lit("backlink")))
    if keep is not None:
        found = found.join((laid.table("nodes") if laid else nodes).where(keep).select("id"), "id", "left_semi")
    members = cut(start.withColumn("part", F.lit("seed")).unionByName(found))
    if stubs:
        members = members.unionByName(boundary(nodes, edges, members).withColumn("part", F.lit("stub")))
    return Subgraph(members, *counts, *(0 < m < n for m, n in zip((direct_cap, backlink_cap), counts)))


def boundary(nodes: DataFrame | None, edges: DataFrame | Adjacency, members: DataFrame) -> DataFrame:
    """Ids of existing nodes that members link to and that aren't members."""
    if isinstance(edges, Adjacency):
        found = cut(edges.of("out", members).select(F.col("next").alias("id")).distinct().join(members, "id", "left_anti"))
        return edges.of("nodes", found).select("id").distinct()
    targets = edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return targets.join(members, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
