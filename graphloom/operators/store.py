"""Ingestion and retraction over an append-only log.

Every value a document contributes is one row of ``contributions``; what the
graph holds is a fold of that log, so nothing is rewritten in place.  The commit
row is written last and alone decides: rows of a log without their commit count
for nothing, so an aborted write leaves no trace.  One writer at a time is
assumed.  Retracting a document adds a row to ``retractions``.  Types and
predicates that documents bring are rows of ``definitions`` and are there again
when the store is opened anew.  Nodes that only retracted documents wrote are gone, and so are
links to them; of nodes shared with other documents only the prose is taken
back, and conflicts that the document caused dissolve with it.

A table of patches of any size is ingested by ``apply_all``: its commits count
once the row of their batch is there.  ``compact`` writes a snapshot of what the
log amounts to, with the log itself, by buckets of node ids; only buckets that
were touched since the last one are written anew.  A read then folds the nodes
that were touched since, and takes all others from the snapshot.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.text import node_path
from ..model import Graph, GraphError, InvalidDocument
from ..session import cut
from ..sources import codec
from . import definitions, merge, timeline
from .schema import Predicate, Schema, Type

CONTRIBUTIONS = (
    "seq long, document string, node_seq int, id string, type string, kind string, key string, pos int, "
    "value string, target string, alias string, at timestamp"
)
RETRACTIONS = "seq long, document string"
COMMITS = "seq long, subject string, source_id string, message string, batch long"
BATCHES = "batch long"
SNAPSHOTS = "at long, bucket int, version long, through long, policies string"
BUCKETS = 32  # of node ids, in a snapshot
ROWS_AT_ONCE = 20_000  # contributions that a parsing task hands on
HUB = 200  # contributions to one text beyond which it is merged in joins
DEFINITIONS = "seq long, kind string, name string, body string"


@dataclass
class Outcome:
    """What an ingestion or retraction did."""

    document: str
    skipped: bool = False
    created: dict[str, int] = field(default_factory=dict)
    merged: dict[str, int] = field(default_factory=dict)
    removed: dict[str, int] = field(default_factory=dict)
    reconciled: dict[str, int] = field(default_factory=dict)
    links_removed: int = 0
    warnings: list[str] = field(default_factory=list)
    approach: str = ""
    message: str = ""


@dataclass
class Ingested:
    """What the ingestion of a table of patches did; seq is that of the table."""

    batch: int
    counts: DataFrame  # document, type, created, merged
    skipped: DataFrame  # seq, document
    refused: DataFrame  # seq, err
    definitions: list[tuple[str, str]]  # kind and name


def count_text(counts: dict[str, int]) -> str:
    """``3 (A: 1, B: 2)``."""
    inner = ", ".join(f"{k}: {n}" for k, n in sorted(counts.items()))
    return f"{sum(counts.values())} ({inner})" if counts else "0"


def rows_of(patch: codec.Patch, seq: int, at: dt.datetime | int) -> list[tuple]:
    """The contributions of a patch; timeline sections name further periods only."""
    out = []
    for i, n in enumerate(patch.nodes):
        head = (seq, patch.document, i, n.id, n.type)
        if n.type == "Timeline":
            out.append((*head, "period", n.id, 0, None, None, None, at))
            continue
        stub = not (n.attrs or n.texts or n.hrefs or n.edges)
        date = n.published or (None if stub else patch.published)
        out.append((*head, "node", "stub" if stub else "full", 0, date.strftime("%Y-%m-%d") if date else None, None, None, at))
        out += [(*head, "attr", k, p, None if v is None else codec.show(v), None, None, at) for k, vs in n.attrs.items() for p, v in enumerate(vs)]
        out += [(*head, "text", k, 0, v, None, None, at) for k, v in n.texts.items()]
        for kind, links in (("edge", n.edges), ("href", n.hrefs)):
            out += [(*head, kind, x.predicate, p, None, x.target, x.alias, at) for p, x in enumerate(links)]
    return out


class GraphStore:
    """A graph kept as Parquet tables under a path that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema):
        """The store at a path; definitions that earlier commits brought are added to the schema."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        for r in self._committed("definitions", DEFINITIONS).orderBy("seq", "name").collect():  # a schema is small
            known, made = (schema.predicates, Predicate) if r["kind"] == "predicate" else (schema.types, Type)
            values = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(r["body"]).items()}
            known[r["name"]] = made(**values)  # later definitions have grown from earlier ones

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def _committed(self, name: str, schema: str) -> DataFrame:
        """A log's rows that have their commit."""
        return self._read(name, schema).join(self.commits.select("seq").distinct(), "seq", "left_semi")

    @property
    def contributions(self) -> DataFrame:
        return self._committed("contributions", CONTRIBUTIONS)

    @property
    def retractions(self) -> DataFrame:
        return self._committed("retractions", RETRACTIONS)

    @property
    def commits(self) -> DataFrame:
        """Commits; those of a batch only if the batch was finished."""
        rows = self._read("commits", COMMITS)
        done = self._read("batches", BATCHES).distinct()
        return rows.where("batch is null").unionByName(rows.where("batch is not null").join(done, "batch", "left_semi"))

    def _next(self) -> int:
        # beyond rows of aborted writes, too
        used = [self._read(n, c).agg(F.max("seq")).first()[0] or 0 for n, c in (("commits", COMMITS), ("contributions", CONTRIBUTIONS), ("retractions", RETRACTIONS), ("definitions", DEFINITIONS))]
        return max(used) + 1

    def _commit(self, seq: int, subject: str, source_id: str, message: str) -> None:
        self.spark.createDataFrame([(seq, subject, source_id, message, None)], COMMITS).write.mode("append").parquet(f"{self.root}/commits")

    def live(self, contributions: DataFrame | None = None) -> DataFrame:
        """Contributions with ``live``: false for those that a later retraction took back."""
        last = self.retractions.groupBy("document").agg(F.max("seq").alias("_r"))
        return (self.contributions if contributions is None else contributions).join(F.broadcast(last) if self._small(last) else last, "document", "left").withColumn("live", F.coalesce(F.col("seq") > F.col("_r"), F.lit(True))).drop("_r")

    def _small(self, df: DataFrame) -> bool:
        return df.limit(10_001).count() <= 10_000

    def active(self) -> DataFrame:
        """Documents that are in the graph."""
        return self.live().where("live").select("document").distinct()

    def graph(self) -> Graph:
        """What the log amounts to: the snapshot's nodes, and those touched since folded anew."""
        held = self._snapshot()
        if not held:
            return fold(self.live(), self.schema)
        made, gone = self._merged(held, list(range(BUCKETS)))
        edges = made["edges"]
        if not gone.isEmpty():  # links to nodes that are gone, and places of the links after them
            hit = edges.join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").select("src").distinct()
            left = edges.join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(edges.columns)
            again = left.join(hit, "src", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("pos")) - 1)
            edges = left.join(hit, "src", "left_anti").unionByName(again)
        return Graph(made["nodes"], made["attrs"], made["texts"], edges, made["hrefs"])

    def _policies(self) -> str:
        return json.dumps({p.name: p.merge for p in self.schema.predicates.values()}, sort_keys=True)

    def _snapshot(self) -> dict[int, tuple[int, int]]:
        """(version, through) of each bucket; none if a policy has changed since."""
        rows = self._read("snapshots", SNAPSHOTS).groupBy("bucket").agg(F.max_by(F.struct("version", "through", "policies"), "at").alias("x")).collect()  # a row for each bucket
        now = {p.name: p.merge for p in self.schema.predicates.values()}
        if any(now.get(name) != op for policies in {r["x"]["policies"] for r in rows} for name, op in json.loads(policies).items()):
            return {}
        return {r["bucket"]: (r["x"]["version"], r["x"]["through"]) for r in rows}

    def _part(self, held: dict[int, tuple[int, int]], buckets: list[int], table: str) -> DataFrame:
        """A snapshot's table, of some buckets."""
        schema = f"{_TABLES[table]}, version long, bucket int"
        by: dict[int, list[int]] = {}
        for bucket in buckets:
            if bucket in held:
                by.setdefault(held[bucket][0], []).append(bucket)
        if not by:
            return self.spark.createDataFrame([], _TABLES[table])
        own = reduce(Column.__or__, [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in by.items()])
        return self.spark.read.schema(schema).parquet(f"{self.root}/snapshot/{table}").where(own).drop("version", "bucket")

    def _merged(self, held: dict[int, tuple[int, int]], buckets: list[int]) -> tuple[dict[str, DataFrame], DataFrame]:
        """Tables of the graph in some buckets, links to nodes that are gone among them, and those nodes."""
        since, touched = self._since(held, buckets)
        log = self._part(held, buckets, "log")
        live = cut(self.live(log.join(touched, "id", "left_semi").unionByName(since)), "kind")
        fresh = fold(live, self.schema, sweep=False)
        lost = live.where("kind = 'node'").groupBy("id").agg(F.bool_or("live").alias("live")).where("not live").select("id")
        out = {}
        for name, made in (("nodes", fresh.nodes), ("attrs", fresh.attrs), ("texts", fresh.texts), ("edges", fresh.edges), ("hrefs", fresh.hrefs), ("gone", lost)):
            key = "src" if name in ("edges", "hrefs") else "id"
            kept = self._part(held, buckets, name).join(touched.withColumnRenamed("id", key), key, "left_anti")
            out[name] = kept.select(made.columns).unionByName(made)
        return out, out.pop("gone")

    def _since(self, held: dict[int, tuple[int, int]], buckets: list[int]) -> tuple[DataFrame, DataFrame]:
        """Contributions later than the snapshot of their node's bucket, and the ids touched since, by retractions too."""
        through = {b: held[b][1] if b in held else -1 for b in buckets}
        place = F.create_map(*(F.lit(x) for b, n in through.items() for x in (b, n)))
        own = _bucket("id").isin(buckets)
        since = self.contributions.where((F.col("seq") > min(through.values())) & own).where(F.col("seq") > place[_bucket("id")])
        back = self.retractions.where(F.col("seq") > min(through.values())).groupBy("document").agg(F.max("seq").alias("_r"))
        taken = self._part(held, buckets, "log").select("id", "document").join(back, "document").where(F.col("_r") > place[_bucket("id")])
        return since, cut(since.select("id").union(taken.select("id")).distinct())

    def compact(self) -> list[int]:
        """Write a snapshot of the buckets that were touched since the last one; their numbers."""
        held, everything = self._snapshot(), list(range(BUCKETS))
        at, through = self._next(), self.commits.agg(F.max("seq")).first()[0]
        if through is None:
            return []
        since, touched = self._since(held, everything)
        dirty = sorted(r[0] for r in touched.select(_bucket("id").alias("b")).distinct().collect())
        if dirty:
            made, gone = self._merged(held, dirty)
            log = self._part(held, dirty, "log").unionByName(since)
            for name, df in (*made.items(), ("gone", gone), ("log", log)):
                placed = df.withColumn("bucket", _bucket("src" if name in ("edges", "hrefs") else "id"))
                placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/snapshot/{name}/version={at}")
        rows = [(at, b, at if b in dirty else held[b][0], through, self._policies()) for b in everything if b in dirty or b in held]
        self.spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")
        return dirty

    def apply_all(self, patches: DataFrame) -> Ingested:
        """Ingest a table of patches (seq long from 0 on, at timestamp, raw string) as ``apply`` would one by one in order of seq.

        Each patch is read with the schema as it is before the first.  Refused
        ones are left out, of patches of one document the first counts, and
        documents that are in the graph already are skipped.  All of it counts
        at once, when the row of the batch is written; if it never is, nothing does.
        """
        base = self._next()
        parsed = parse(patches.withColumn("seq", F.col("seq") + base), self.schema)
        given = parsed.where("kind = 'document'").select("document", "seq")
        chosen = cut(given.groupBy("document").agg(F.min("seq").alias("seq")).join(self.active(), "document", "left_anti"))
        rows = parsed.where("kind not in ('document', 'used')").join(chosen, ["document", "seq"], "left_semi").select([c.split(" ")[0] for c in CONTRIBUTIONS.split(", ")])
        ids = rows.where("kind = 'node'").select("id").distinct()
        known = self.live().where("live and kind = 'node'").join(ids, "id", "left_semi").select("id").distinct()
        done = cut(counts(rows, known))
        used = parsed.where("kind = 'used'").join(chosen, ["document", "seq"], "left_semi").groupBy("key").agg(F.min_by(F.struct("value", "alias"), F.struct("seq", "node_seq", "pos")).alias("x"), F.min(F.struct("seq", "node_seq", "pos")).alias("o"))
        types = rows.where("kind = 'node'").groupBy("type").agg(F.min(F.struct("seq", "node_seq")).alias("o"))
        new = [("type", r["type"]) for r in types.where(~F.col("type").isin(list(self.schema.types))).orderBy("o").collect() if self.schema.register_type(r["type"])]  # a vocabulary, as the schema
        new += [("predicate", r["key"]) for r in used.where(~F.col("key").isin(list(self.schema.predicates))).orderBy("o").collect() if self.schema.register_predicate(r["key"], r["x"]["value"], r["x"]["alias"] or "")]
        by = done.groupBy("document").agg(*(F.sort_array(F.filter(F.collect_list(F.struct("type", F.col(c).alias("n"))), lambda x: x["n"] > 0)).alias(c) for c in ("created", "merged")))
        message = F.concat(F.lit("Ingest "), "document", F.lit("\n\nCreated: "), _count_text("created"), F.lit("\nMerged: "), _count_text("merged"), F.lit("\nSource-Id: "), "document")
        commits = chosen.join(by, "document", "left").select("seq", F.concat(F.lit("Ingest "), "document").alias("subject"), F.col("document").alias("source_id"), message.alias("message"), F.lit(base).cast("long").alias("batch"))
        if new:
            bodies = [(base, k, name, json.dumps(asdict((self.schema.predicates if k == "predicate" else self.schema.types)[name]))) for k, name in new]
            first = chosen.agg(F.min("seq")).first()[0]
            self.spark.createDataFrame([(first, *x[1:]) for x in bodies], DEFINITIONS).write.mode("append").parquet(f"{self.root}/definitions")
        rows.write.mode("append").parquet(f"{self.root}/contributions")
        commits.write.mode("append").parquet(f"{self.root}/commits")
        self.spark.createDataFrame([(base,)], BATCHES).coalesce(1).write.mode("append").parquet(f"{self.root}/batches")
        of_table = lambda df: df.withColumn("seq", F.col("seq") - base)
        return Ingested(base, done, of_table(given.join(chosen, ["document", "seq"], "left_anti").select("seq", "document")), of_table(parsed.where("err is not null").select("seq", "err")), new)

    def timeline(self) -> DataFrame:
        """Entries of all periods, with places."""
        c = self.live().where("live")
        more = c.where("kind = 'period'").groupBy("document").agg(F.collect_set("key").alias("more"))
        dated = c.where("kind = 'node' and id = document").groupBy("document").agg(F.min(F.struct("seq", F.col("value"))).alias("x"))
        docs = dated.select(F.col("document").alias("doc_id"), F.to_timestamp("x.value").alias("published"), F.col("x.seq").alias("seq")).join(more.withColumnRenamed("document", "doc_id"), "doc_id", "left")
        return timeline.positions(timeline.entries(docs, "more"))

    def apply(self, text: str, now: dt.datetime) -> Outcome:
        """Ingest a patch document; skipped if its document is in the graph already."""
        patch = codec.parse_patch(text, self.schema)
        out = Outcome(patch.document)
        for n in patch.nodes:
            if not n.id or "/" in n.id or n.id in (".", ".."):
                raise InvalidDocument(f"bad id {n.id!r}")
        if not self.active().where(F.col("document") == patch.document).isEmpty():
            out.skipped = True
            return out
        real = [n for n in patch.nodes if n.type != "Timeline"]
        ids = self.spark.createDataFrame([(n.id,) for n in real] or [("",)], "id string").distinct()
        known = {r[0] for r in self.live().where("live and kind = 'node'").join(ids, "id", "left_semi").select("id").distinct().collect()}  # of the patch's ids
        new: list[tuple[str, str]] = []
        for n in real:
            if self.schema.register_type(n.type):
                out.warnings.append(f"type {n.type} is new")
                new.append(("type", n.type))
            for predicate, seen in observed(n).items():
                if self.schema.register_predicate(predicate, seen, n.labels.get(predicate, "")):
                    new.append(("predicate", predicate))
            counts = out.merged if n.id in known else out.created
            counts[n.type] = counts.get(n.type, 0) + 1
            known.add(n.id)
        seq = self._next()
        if new:
            bodies = [(seq, k, name, json.dumps(asdict((self.schema.predicates if k == "predicate" else self.schema.types)[name]))) for k, name in new]
            self.spark.createDataFrame(bodies, DEFINITIONS).write.mode("append").parquet(f"{self.root}/definitions")
        self.spark.createDataFrame(rows_of(patch, seq, now), CONTRIBUTIONS).write.mode("append").parquet(f"{self.root}/contributions")
        out.message = f"Ingest {patch.document}\n\nCreated: {count_text(out.created)}\nMerged: {count_text(out.merged)}\nSource-Id: {patch.document}"
        self._commit(seq, f"Ingest {patch.document}", patch.document, out.message)
        return out

    def apply_schema(self, text: str) -> definitions.Changes:
        """Merge a patch of definitions into the schema, store what it changed and commit it; InvalidSchema for any bad one, and then nothing is."""
        merged, done = definitions.apply(self.schema, text)
        seq = self._next()
        changed = [("predicate", n, merged.predicates[n]) if n in merged.predicates and self.schema.predicates.get(n) != merged.predicates[n] else ("type", n, merged.types[n]) for n in (*done.created, *done.updated)]
        if changed:
            rows = [(seq, kind, name, json.dumps(asdict(body))) for kind, name, body in changed]
            self.spark.createDataFrame(rows, DEFINITIONS).write.mode("append").parquet(f"{self.root}/definitions")
            self._commit(seq, done.message.splitlines()[0], "", done.message)
        self.schema.predicates.update(merged.predicates)
        self.schema.types.update(merged.types)
        return done

    def revert(self, document: str, now: dt.datetime) -> Outcome:
        """Take a document's contribution back; GraphError for one never ingested, skipped if it is out already."""
        out = Outcome(document)
        if self.commits.where(F.col("source_id") == document).isEmpty():
            raise GraphError(f"{document} was never ingested")
        if self.active().where(F.col("document") == document).isEmpty():
            out.skipped = True
            return out
        before = self.live().where("live")
        mine = before.where(F.col("document") == document)
        touched = before.join(mine.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("type").alias("type"), F.count_distinct("document").alias("n"), F.max("seq").alias("last"))
        own = mine.agg(F.max("seq")).first()[0]
        rows = touched.groupBy((F.col("n") == 1).alias("exclusive"), "type").agg(F.count("*").alias("n"), F.bool_and(F.col("last") == own).alias("newest")).collect()  # by type
        for r in rows:
            (out.removed if r["exclusive"] else out.reconciled)[r["type"]] = r["n"]
        out.approach = "whole commit" if all(r["newest"] for r in rows) else "per node"
        gone = touched.where("n = 1").select(F.col("id").alias("target"))
        out.links_removed = before.where((F.col("kind") == "edge") & (F.col("document") != document)).join(gone, "target", "left_semi").count()
        seq = self._next()
        self.spark.createDataFrame([(seq, document)], RETRACTIONS).write.mode("append").parquet(f"{self.root}/retractions")
        out.message = f"Revert {document}\n\nRemoved: {count_text(out.removed)}\nReconciled: {count_text(out.reconciled)}\nLinks removed: {out.links_removed}"
        self._commit(seq, f"Revert {document}", "", out.message)
        return out


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


_TABLES = {"nodes": model.NODES, "attrs": model.ATTRS, "texts": model.TEXTS, "edges": model.EDGES, "hrefs": model.EDGES, "gone": "id string", "log": CONTRIBUTIONS}


def _count_text(column: str) -> Column:
    """``count_text`` of an array of struct(type, n)."""
    inner = F.array_join(F.transform(column, lambda x: F.concat(x["type"], F.lit(": "), x["n"].cast("string"))), ", ")
    total = F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.concat(total.cast("string"), F.lit(" ("), inner, F.lit(")"))).otherwise("0")


def parse(patches: DataFrame, schema: Schema) -> DataFrame:
    """Contributions of a table of patches (seq long, at timestamp, raw string), with ``err`` for those that are refused.

    Further rows name the document of each patch (kind ``document``) and its
    predicates as they were met (kind ``used``).  Patches are parsed where they
    lie, once, and written by kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in CONTRIBUTIONS.split(", ")] + ["err"]
        kinds = {"seq": pa.int64(), "node_seq": pa.int32(), "pos": pa.int32()}
        for batch in batches:
            stamps = batch.column(1)
            kinds["at"] = stamps.type
            rows: list[tuple] = []
            for seq, at, raw in zip(batch.column(0).to_pylist(), stamps.cast(pa.int64()).to_pylist(), batch.column(2).to_pylist()):
                try:
                    patch = codec.parse_patch(raw, schema)
                    bad = next((n.id for n in patch.nodes if not n.id or "/" in n.id or n.id in (".", "..")), None)
                    if bad is not None:
                        raise InvalidDocument(f"bad id {bad!r}")
                    rows += [(*x, None) for x in rows_of(patch, seq, at)]
                    rows.append((seq, patch.document, None, None, None, "document", None, None, None, None, None, at, None))
                    for i, n in enumerate(patch.nodes):
                        if n.type != "Timeline":
                            rows += [(seq, patch.document, i, n.id, n.type, "used", k, p, seen, None, n.labels.get(k, ""), at, None) for p, (k, seen) in enumerate(observed(n).items())]
                except (GraphError, ValueError) as e:
                    rows.append((seq, *[None] * 10, at, str(e) or type(e).__name__))
                if len(rows) >= ROWS_AT_ONCE:
                    yield _batch(rows, names, kinds)
                    rows = []
            yield _batch(rows, names, kinds)

    return cut(patches.select(F.col("seq").cast("long"), F.col("at").cast("timestamp"), "raw").mapInArrow(run, f"{CONTRIBUTIONS}, err string"), "kind")


def _batch(rows: list[tuple], names: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    # times are counts of microseconds until here
    made = [pa.array(c, pa.int64()).cast(kinds[n]) if n == "at" else pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns)]
    return pa.RecordBatch.from_arrays(made, names=names)


def ingest(patches: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Contributions of a table of patches (seq long, at timestamp, raw string), and (seq, err) of those that are refused.

    Of patches of one document the first by seq counts.  Nothing is collected,
    so the table may have any size.
    """
    parsed = parse(patches, schema)
    good = parsed.where("err is null and kind not in ('document', 'used')").drop("err")
    first = good.groupBy("document").agg(F.min("seq").alias("seq"))
    return good.join(first, ["document", "seq"], "left_semi"), parsed.where("err is not null").select("seq", "err")


def counts(contributions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(document, type, created, merged): nodes of each ingestion by type; a node is created by the first that names it, unless it is known (column id)."""
    heads = contributions.where("kind = 'node'").select("document", "type", "id", F.struct("seq", "node_seq").alias("o"))
    first = heads.groupBy("id").agg(F.min("o").alias("first"))
    there = F.lit(False)
    if known is not None:
        first = first.join(known.select("id", F.lit(True).alias("_known")), "id", "left")
        there = F.coalesce("_known", F.lit(False))
    made = (F.col("o") == F.col("first")) & ~there
    return heads.join(first, "id").groupBy("document", "type").agg(F.count_if(made).alias("created"), F.count_if(~made).alias("merged"))


def retracted(contributions: DataFrame, documents: DataFrame) -> DataFrame:
    """Contributions with ``live``: false for those of some documents (column document)."""
    out = documents.select("document").distinct().withColumn("_out", F.lit(True))
    return contributions.join(out, "document", "left").withColumn("live", F.col("_out").isNull()).drop("_out")


def observed(node: codec.Node) -> dict[str, str]:
    """Predicates of a node's links and named prose, by how they were first seen."""
    seen: dict[str, str] = {}
    for e in node.edges:
        if e.predicate:
            seen.setdefault(e.predicate, "edge")
    slots = {codec.LEADING.get(node.type, "text"), codec.TRAILING}
    for key in node.texts:
        if key not in slots:
            seen.setdefault(key, "text")
    return seen


def _merged_texts(texts: DataFrame) -> DataFrame:
    """(id, key, value, seq): prose under its policies, and the seq of the last contribution that changed it.

    ``texts`` has id, key, op, seq, value and source.  Texts that more than HUB
    documents add to are merged in joins, all others within a row.
    """
    some = F.coalesce("value", F.lit("")) != ""
    first = texts.where(F.col("op").isin(*merge.FREEZE)).groupBy("id", "key").agg(F.coalesce(F.min_by("value", F.when(some, F.col("seq"))), F.lit("")).alias("value"), F.min(F.when(some, F.col("seq"))).alias("seq"))
    over = texts.where(F.col("op").isin(*merge.OVERWRITE) & some).withColumn("_was", F.lag("value").over(Window.partitionBy("id", "key").orderBy("seq")))
    last = over.groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"), F.expr("max(seq) filter (where _was is null or _was <> value)").alias("seq"))
    flags = merge.changes(texts.where(F.col("op").isin(*merge.FLAG) & some), F.col("value")).select("id", "key", merge.flagged(F.col("c")).alias("value"), F.element_at("c", -1)["seq"].alias("seq"))
    added = texts.where(~F.col("op").isin(*merge.FREEZE, *merge.OVERWRITE, *merge.FLAG))
    hubs = cut(added.groupBy("id", "key").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("id", "key"))
    parts = [first, last, flags]
    if not hubs.isEmpty():
        parts.append(merge.merge_paragraph_rows(cut(added.join(hubs, ["id", "key"], "left_semi").select("id", "key", "seq", "value"))))
        added = added.join(hubs, ["id", "key"], "left_anti")

    def step(state: Column, x: Column) -> Column:
        new = F.coalesce(merge.merge_paragraphs(state["s"], x["value"]), F.lit(""))
        return F.struct(new.alias("s"), F.when(new == state["s"], state["at"]).otherwise(x["seq"]).alias("at"))

    gathered = added.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("c"))
    folded = gathered.select("id", "key", F.aggregate("c", F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at")), step).alias("x"))
    parts.append(folded.select("id", "key", F.col("x.s").alias("value"), F.nullif(F.col("x.at"), F.lit(0)).alias("seq")))
    return reduce(DataFrame.unionByName, parts)


def fold(live: DataFrame, schema: Schema, sweep: bool = True) -> Graph:
    """The graph that a log (with ``live``) amounts to; without sweep, links to nodes that are gone stay."""
    spark = live.sparkSession
    ops = spark.createDataFrame([(p.name, p.merge) for p in schema.predicates.values()] or [("published", "immutable")], "key string, op string")
    heads = live.where("kind = 'node'")
    alive = heads.where("live").select("id").distinct()
    order = F.struct("seq", "node_seq")
    kept = live.join(alive, "id", "left_semi")
    # a date is never flagged or united: only an overwriting policy changes it
    which = "max_by" if schema.merge_of("published") in merge.OVERWRITE else "min_by"
    first = kept.where("kind = 'node'").groupBy("id").agg(
        F.min_by("type", order).alias("type"),
        F.expr(f"{which}(value, struct(seq, node_seq)) filter (where value is not null)").alias("published"),
        F.expr("min_by(struct(seq * 1048576L + node_seq as seq, at), struct(seq, node_seq)) filter (where key = 'full')").alias("_made"),
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    nodes = first.select("id", "type", F.to_timestamp("published").alias("published"), node_path(F.col("type"), F.col("id")).alias("path"), F.lit(None).cast("string").alias("raw"))
    seq = F.col("seq") * F.lit(1 << 20) + F.col("node_seq")
    with_op = lambda c: c.join(F.broadcast(ops), "key", "left").withColumn("op", F.coalesce("op", F.lit("union")))  # noqa: E731  the schema is small

    # attributes: lists of one contribution are compared whole
    attrs = with_op(kept.where("kind = 'attr'").withColumn("seq", seq))
    sets = attrs.groupBy("id", "key", "op", "seq", "document").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"]).alias("list"))
    scalars = sets.where(F.col("op").isin(*merge.FREEZE, *merge.OVERWRITE) & (F.array_join("list", "") != ""))
    runs = scalars.withColumn("_was", F.lag("list").over(Window.partitionBy("id", "key").orderBy("seq")))
    pick = runs.groupBy("id", "key", "op").agg(F.min_by("list", "seq").alias("a"), F.max_by("list", "seq").alias("b"), F.min("seq").alias("from"), F.expr("max(seq) filter (where _was is null or _was <> list)").alias("since"))
    chosen = pick.select("id", "key", F.when(F.col("op").isin(*merge.OVERWRITE), F.col("b")).otherwise(F.col("a")).alias("list"))
    changes = merge.changes(sets.where(F.col("op").isin(*merge.FLAG) & (F.array_join("list", "") != "")).withColumnRenamed("document", "source"), F.array_join("list", ", "))
    flagged = changes.select("id", "key", F.when(F.size("c") == 1, F.col("c")[0]["list"]).otherwise(F.array(merge.flagged(F.col("c")))).alias("list"))
    lists = attrs.where(~F.col("op").isin(*merge.FREEZE, *merge.OVERWRITE, *merge.FLAG) & F.col("value").isNotNull())
    united = lists.groupBy("id", "key", "value").agg(F.min(F.struct("seq", "pos")).alias("o")).groupBy("id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]).alias("list"))
    # prose: only what is not taken back
    texts = _merged_texts(with_op(kept.where("kind = 'text' and live").withColumn("seq", seq)).select("id", "key", "op", "seq", "value", F.col("document").alias("source")))
    # when a contribution has last changed anything, by what first brought each thing that is there
    at_of = kept.where("kind = 'node'").select("id", seq.alias("seq"), "at")
    changed = [
        pick.select("id", F.when(F.col("op").isin(*merge.OVERWRITE), F.col("since")).otherwise(F.col("from")).alias("seq")),
        changes.select("id", F.element_at("c", -1)["seq"].alias("seq")),
        lists.groupBy("id", "key", "value").agg(F.min("seq").alias("seq")).select("id", "seq"),
        kept.where("kind in ('edge', 'href')").groupBy("id", "kind", "key", "target").agg(F.min(seq).alias("seq")).select("id", "seq"),
        texts.where("seq is not null").select("id", "seq"),
    ]
    last = reduce(DataFrame.union, changed).groupBy("id").agg(F.max("seq").alias("seq"))
    updated = last.join(first.where("_made is not null").select("id", F.col("_made.seq").alias("_from")), "id").where(F.col("seq") > F.col("_from")).join(at_of, ["id", "seq"]).groupBy("id").agg(F.max("at").alias("at"))
    dates = [first.where("_made is not null").select("id", F.lit("indexed").alias("key"), F.array(stamp("_made.at")).alias("list")), updated.select("id", F.lit("updated").alias("key"), F.array(stamp("at")).alias("list"))]
    made = reduce(DataFrame.unionByName, [chosen, flagged, united, *dates])
    none = F.lit(None).cast("string")
    out_attrs = made.select("id", "key", F.posexplode("list").alias("pos", "value_str")).select("id", "key", "pos", "value_str", F.lit("string").alias("vtype"), none.alias("target"), none.alias("alias"))

    # links: none to nodes that are gone
    gone = heads.select("id").distinct().join(alive, "id", "left_anti").select(F.col("id").alias("dst"))

    def links(kind: str) -> DataFrame:
        rows = kept.where(F.col("kind") == kind).select(F.col("id").alias("src"), F.col("key").alias("predicate"), F.col("target").alias("dst"), "alias", seq.alias("seq"), "pos")
        one = rows.groupBy("src", "predicate", "dst").agg(F.min_by("alias", F.struct("seq", "pos")).alias("alias"), F.min(F.struct("seq", "pos")).alias("o"))
        if kind == "edge" and sweep:
            one = one.join(gone, "dst", "left_anti")
        # a sorted window spills; no node's links are gathered into one row
        return one.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("o", "predicate", "dst")) - 1).alias("pos"), "predicate", "dst", "alias")

    return Graph(nodes, out_attrs, texts.select("id", "key", "value"), links("edge"), links("href"))
