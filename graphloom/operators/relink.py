"""Proposed links: names of nodes that prose mentions without linking to them.

Distinct names make automata of about BLOCK_BYTES of names each; they are
broadcast, every text is read once for each, and the nodes that have a name are
joined to its places.  A mention stands between white
space or the text's start and white space, punctuation or its end, and touches
no brackets.  Of mentions that overlap, the first counts, and of those that begin
together the longest.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK_BYTES = 2 << 20
ROWS = 1_000_000  # results of a name that a task makes, about
MOST_PARTS = 256  # of a name; beyond that a task makes more
AT_ONCE = 20_000  # places that a task holds before it hands them on
_BRACKETS = re.compile(r"\[+[^\[\]]*\]+")
_BEFORE, _AFTER = frozenset("\t\n\f\r "), frozenset("\t\n\f\r " + string.punctuation)


def _known(names: DataFrame) -> DataFrame:
    return names.where("coalesce(name, '') <> ''").select(F.col("id").cast("string").alias("id"), "name").distinct()


def places(docs: DataFrame, names: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, start, end, name): every place in documents (id, raw) where one of the names (column name) is mentioned, whoever has it.

    Automata hold each name once, however many nodes have it, and not the nodes.
    """
    spark = docs.sparkSession
    known = cut(names.where("coalesce(name, '') <> ''").select("name").distinct())
    size = known.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for block in range(blocks):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for r in known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).toLocalIterator():  # about block_bytes
            automaton.add_word(r["name"])
        some = len(automaton) > 0
        if some:
            automaton.make_automaton()
        sent = spark.sparkContext.broadcast(automaton)

        def run(frames: Iterator[pd.DataFrame], sent=sent, some=some) -> Iterator[pd.DataFrame]:
            made = lambda rows: pd.DataFrame(rows, columns=["id", "start", "end", "name"]).astype({"start": "int32", "end": "int32"})
            rows = []
            for frame in frames:
                for id_, raw in zip(frame["id"], frame["raw"]) if some else ():
                    spans = _spans(raw) if raw else []
                    at = 0
                    for start, end in sorted((last + 1 - length, last + 1) for last, length in sent.value.iter(raw or "")):
                        if (start and raw[start - 1] not in _BEFORE) or (end < len(raw) and raw[end] not in _AFTER):
                            continue
                        while at < len(spans) and spans[at][1] <= start:
                            at += 1
                        if at < len(spans) and spans[at][0] < end:
                            continue
                        rows.append((id_, start, end, raw[start:end]))
                    if len(rows) >= AT_ONCE:
                        yield made(rows)
                        rows = []
            yield made(rows)

        found = docs.select(F.col("id").cast("string").alias("id"), "raw").mapInPandas(run, "id string, start int, end int, name string")
        out = found if out is None else out.unionByName(found)
    return out


def _spans(raw: str) -> list[tuple[int, int]]:
    return [m.span() for m in _BRACKETS.finditer(raw)] if "[" in raw else []


def mentions(docs: DataFrame, names: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, start, end, target): every mention in documents (id, raw) of the names (id, name) of other nodes, overlapping ones too.

    Places count characters.  Null texts have none, null and empty names are
    mentioned nowhere; of nodes with one name each is a target.
    """
    to = _known(names).withColumnRenamed("id", "target")
    return places(docs, names, block_bytes).join(to, "name").where("target <> id").select("id", "start", "end", "target")


def mentioned(docs: DataFrame, names: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, target): the nodes that each document mentions, once, however often it does; nodes are joined to each name of a document once."""
    to = _known(names).withColumnRenamed("id", "target")
    own = cut(places(docs, names, block_bytes).select("id", "name").distinct())
    return _dealt(own, to).where("target <> id").select("id", "target")


def _dealt(own: DataFrame, to: DataFrame) -> DataFrame:
    """The documents (id, name) joined to the nodes (target, name) by name; the documents of a name with many results are dealt over tasks.

    Few bytes make many rows here, so neither skew nor size of a partition tells.
    """
    sizes = own.groupBy("name").count().join(to.groupBy("name").agg(F.count("*").alias("nodes")), "name")
    parts = cut(sizes.select("name", F.least(F.lit(MOST_PARTS), F.ceil(F.col("count") * F.col("nodes") / ROWS)).cast("int").alias("g")).where("g > 1"))
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = F.coalesce("g", F.lit(1))
    one = own.join(parts, "name", "left").select("id", "name", F.pmod(F.xxhash64("id"), g).cast("int").alias("part"))
    two = to.join(parts, "name", "left").select("target", "name", F.explode(F.sequence(F.lit(0), g - 1)).alias("part"))
    return one.repartition(tasks, "name", "part").join(two.repartition(tasks, "name", "part").hint("merge"), ["name", "part"])


def proposals(docs: DataFrame, names: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, start, end, targets): the mentions that links are proposed for, with the nodes that have the name.

    A document's mentions are at most as many as its characters, so they are
    settled within one row each.
    """
    spans = mentions(docs, names, block_bytes).groupBy("id", "start", "end").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    longest = spans.groupBy("id", "start").agg(F.max_by(F.struct("end", "targets"), "end").alias("x"))
    lines = longest.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "x.end", "x.targets"))).alias("all"))

    def step(state, m):
        free = m["start"] >= state["end"]
        return F.struct(F.when(free, m["end"]).otherwise(state["end"]).alias("end"), F.when(free, F.concat(state["kept"], F.array(m))).otherwise(state["kept"]).alias("kept"))

    none = F.array().cast("array<struct<start: int, end: int, targets: array<string>>>")
    return lines.select("id", F.inline(F.aggregate("all", F.struct(F.lit(0).alias("end"), none.alias("kept")), step)["kept"]))
