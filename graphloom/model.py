"""Tables of a typed property graph.

Every node has one row in ``nodes``; its attributes, named prose, structural
links and inline citations are rows of the other tables, so the vocabulary is
open and never becomes columns.  Any of them may come from documents or be
projected from other tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NODES = "id string, type string, published timestamp, path string, raw string"
ATTRS = "id string, key string, pos int, value_str string, vtype string, target string, alias string"
TEXTS = "id string, key string, value string"
EDGES = "src string, pos int, predicate string, dst string, alias string"
PREDICATES = "name string, role string, merge string, label string, aligned string, description string"
TYPES = "name string, merge string, required array<string>, optional array<string>, bases array<string>, description string"
COMMITS = "seq long, hash string, subject string, source_id string"
TOUCHED = "seq long, path string"


@dataclass(frozen=True)
class Graph:
    """The tables of one graph."""

    nodes: DataFrame
    attrs: DataFrame
    texts: DataFrame
    edges: DataFrame
    hrefs: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(*(spark.createDataFrame([], s) for s in (NODES, ATTRS, TEXTS, EDGES, EDGES)))


class GraphError(Exception):
    """Any refusal of an operation on a graph."""


class NodeNotFound(GraphError):
    """No node has the id."""


class InvalidPattern(GraphError):
    """A pattern outside the accepted dialect."""


class InvalidDocument(GraphError):
    """A document that can't be read as what it should be."""


class InvalidSchema(GraphError):
    """A schema that can't be resolved."""
