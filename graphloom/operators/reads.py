"""Further read verbs over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .merge import is_marker


def popular(edges: DataFrame, most: int) -> DataFrame:
    """(id, links, place) of the nodes with most links to them; ties share a place."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links"))
    # places are those of the distinct counts, of which there are few, whatever the number of ties
    sizes = counts.groupBy("links").agg(F.count("*").alias("n")).orderBy(F.desc("links")).limit(most)
    above = F.sum("n").over(Window.orderBy(F.desc("links")).rowsBetween(Window.unboundedPreceding, -1))
    places = sizes.select("links", (F.coalesce(above, F.lit(0)) + 1).cast("int").alias("place")).where(F.col("place") <= most)
    return counts.join(F.broadcast(places), "links").select("id", "links", "place")  # most rows at most


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def since(contributions: DataFrame, seq: int) -> DataFrame:
    return contributions.where(F.col("seq") > seq)


def citations(edges: DataFrame) -> DataFrame:
    return edges.where("predicate = 'cites'")


def neighbors(edges: DataFrame, id_: str) -> DataFrame:
    """(id, predicate, direction) of the nodes one link away."""
    out = edges.where(F.col("src") == id_).select(F.col("dst").alias("id"), "predicate", F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == id_).select(F.col("src").alias("id"), "predicate", F.lit("in").alias("direction"))).distinct()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, name, n): nodes by type and links by predicate."""
    one = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), F.col("type").alias("name"), "n")
    return one.unionByName(edges.groupBy("predicate").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), F.col("predicate").alias("name"), "n"))


def conflicts(texts: DataFrame) -> DataFrame:
    """Texts that are an open conflict."""
    return texts.where(is_marker(F.col("value")))


def path(edges: DataFrame, start: str, goals: DataFrame, most: int) -> DataFrame:
    """One shortest path from a node to each reached goal (column id): path array.  Of equal ones the least is taken."""
    spark = edges.sparkSession
    steps = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct()
    frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    visited = frontier
    for _ in range(most):
        grown = frontier.join(steps, "id").select(F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"))
        frontier = cut(grown.join(visited.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.join(goals.select("id").distinct(), "id", "left_semi")
