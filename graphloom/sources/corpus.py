"""Reading folders of documents into the tables of a graph.

Paths of a local folder are listed by the driver, since file sources hide names
that begin with a dot or an underscore; those of a path with a scheme by Spark.
Contents are read and parsed by the executors, and documents written by them:
one file each, or many in packs, as a file takes a block of the file system
however short it is.  Packs are Parquet tables (path, raw) under the marker; of
one path the last pack counts, and a file beside them, which people edit, before all.
"""

from __future__ import annotations

import os
import shutil
import urllib.request
import uuid
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import parse_date
from ..model import Graph, GraphError, InvalidSchema
from ..operators.schema import Predicate, Schema, Type
from . import codec

MARKER, SCHEMA, PACKS = ".graph", "_schema", "packs"
#: the folders of a new graph
FOLDERS = ("sources", "entities", "resources", "timeline/yearly", "timeline/monthly", "_schema/types", "_schema/predicates")

_LINK = "array<struct<predicate: string, target: string, alias: string>>"
PARSED = (
    "path string, raw string, err string, id string, type string, published string, "
    "attrs array<struct<key: string, pos: int, value_str: string, vtype: string>>, "
    f"texts array<struct<key: string, value: string>>, edges {_LINK}, hrefs {_LINK}"
)


def guard(root: str) -> None:
    """GraphError where the folder holds no graph."""
    if not os.path.isdir(os.path.join(root, MARKER)):
        raise GraphError(f"{root} holds no graph")


def walk(root: str) -> list[str]:
    """Relative paths of all documents, in order; only the top-level marker and schema folders are left out."""
    found = []
    for folder, folders, files in os.walk(root):
        at = os.path.relpath(folder, root)
        if at == ".":
            folders[:] = [f for f in folders if f not in (MARKER, SCHEMA)]
        found += [os.path.normpath(os.path.join(at, f)) for f in files if f.endswith(".md")]
    return sorted(found)


def _row(path: str, raw: str | None, err: str | None, node: codec.Node | None) -> tuple:
    if node is None:
        return (path, raw, err, None, None, None, [], [], [], [])
    kind = {bool: "bool", int: "int", float: "float", str: "string"}
    attrs = [(k, i, None if v is None else codec.show(v), kind.get(type(v), "json")) for k, vs in node.attrs.items() for i, v in enumerate(vs)]
    link = lambda ls: [(x.predicate, x.target, x.alias) for x in ls]
    published = node.published.strftime("%Y-%m-%dT%H:%M:%SZ") if node.published else None
    return (path, raw, None, node.id, node.type, published, attrs, list(node.texts.items()), link(node.edges), link(node.hrefs))


def parse_text(path: str, raw: str, schema: Schema | None = None) -> tuple:
    try:
        return _row(path, raw, None, codec.parse_node(raw, schema))
    except (GraphError, ValueError) as e:
        return _row(path, raw, str(e) or type(e).__name__, None)


def parse(texts: DataFrame, schema: Schema | None = None) -> DataFrame:
    """Parsed documents from (path, raw); those that can't be read have err."""

    def run(frames):
        for frame in frames:
            yield _frame([parse_text(p, r, schema) for p, r in zip(frame["path"], frame["raw"])])

    return texts.select("path", "raw").mapInPandas(run, PARSED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in ("path", "raw", "err", "id", "type", "published", "attrs", "texts", "edges", "hrefs")]
    frame = pd.DataFrame(rows, columns=names)
    for name, fields in (("attrs", ("key", "pos", "value_str", "vtype")), ("texts", ("key", "value")), ("edges", ("predicate", "target", "alias")), ("hrefs", ("predicate", "target", "alias"))):
        frame[name] = [[dict(zip(fields, x)) for x in cell] for cell in frame[name]]
    return frame


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, raw, err) of all documents under a path of any file system that Spark reads.

    Folders are listed by Spark, in jobs where there are many, and contents read by
    the executors.  Left out are the marker and schema folders, and names that
    Spark's sources hide (those that begin with a dot or an underscore).
    """
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(conf)
    if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, MARKER)):
        raise GraphError(f"{root} holds no graph")
    top = files.makeQualified(at).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    local = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    relative = F.substring(local, len(top) + 2, 1 << 20)
    good = F.expr("is_valid_utf8(content)")
    return rows.select(relative.alias("path"), F.when(good, F.decode("content", "UTF-8")).alias("raw"), F.when(~good, "not UTF-8").alias("err"))


def _pack_paths(spark: SparkSession, root: str) -> list[str]:
    """The packs of a graph that were written to their end, in order."""
    base = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = make(f"{base}/{MARKER}/{PACKS}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []
    return [f"{base}/{MARKER}/{PACKS}/{n}" for n in names if files.exists(make(f"{base}/{MARKER}/{PACKS}/{n}/_SUCCESS"))]


def packed(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, raw) of the documents in packs, of each path the last; None where there are no packs."""
    packs = [spark.read.schema("path string, raw string").parquet(p) for p in _pack_paths(spark, root)]
    if len(packs) < 2:
        return packs[0] if packs else None
    every = reduce(DataFrame.unionByName, [p.withColumn("_pack", F.lit(i)) for i, p in enumerate(packs)])
    return every.groupBy("path").agg(F.max_by("raw", "_pack").alias("raw"))


def read(spark: SparkSession, root: str, schema: Schema | None = None) -> DataFrame:
    """Parsed documents of a folder, or of a path with a scheme on any file system, packed ones among them."""
    files, more = _read_files(spark, root, schema), packed(spark, root)
    if more is None:
        return files
    return files.unionByName(parse(more.join(_paths(spark, root), "path", "left_anti"), schema))


def _paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the documents that are files."""
    if "://" in root or root.startswith("file:"):
        return listed(spark, root).select("path")
    return spark.createDataFrame([(p,) for p in walk(root)], "path string")


def _read_files(spark: SparkSession, root: str, schema: Schema | None) -> DataFrame:
    if "://" in root or root.startswith("file:"):
        found = listed(spark, root)
        bad = found.where("err is not null").select("path", "err").mapInPandas(lambda frames: (_frame([_row(p, None, e, None) for p, e in zip(f["path"], f["err"])]) for f in frames), PARSED)
        return parse(found.where("err is null"), schema).unionByName(bad)
    guard(root)
    paths = walk(root)

    def run(frames):
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    with open(os.path.join(root, path), encoding="utf-8") as f:
                        rows.append(parse_text(path, f.read(), schema))
                except (OSError, UnicodeDecodeError) as e:
                    rows.append(_row(path, None, str(e), None))
            yield _frame(rows)

    parts = max(1, min(len(paths) // 64 + 1, 10_000))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(parts).mapInPandas(run, PARSED)


def graph(parsed: DataFrame) -> Graph:
    """The tables of readable documents; of one id the greatest path counts."""
    good = parsed.where("err is null")
    # one pass over the documents: a join with the greatest paths would parse them twice
    good = good.where("path is not null").withColumn("_place", F.rank().over(Window.partitionBy("id").orderBy(F.desc("path")))).where("_place = 1").drop("_place")
    nodes = good.select("id", "type", parse_date(F.col("published")).alias("published"), "path", "raw")
    attrs = good.select("id", F.explode("attrs").alias("a")).select("id", "a.*", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("alias"))
    texts = good.select("id", F.explode("texts").alias("t")).select("id", "t.*")
    links = lambda c: good.select(F.col("id").alias("src"), F.posexplode(c).alias("pos", "e")).select("src", "pos", "e.predicate", F.col("e.target").alias("dst"), "e.alias")
    return Graph(nodes, attrs, texts, links("edges"), links("hrefs"))


def unreadable(parsed: DataFrame) -> DataFrame:
    """(path, err) of documents that can't be read, in order."""
    return parsed.where("err is not null").select("path", "err").orderBy("path")


def require_readable(parsed: DataFrame) -> None:
    """GraphError naming the first document, by path, that can't be read: nothing may be written beside such."""
    bad = unreadable(parsed).limit(1).collect()
    if bad:
        raise GraphError(f"{bad[0]['path']}: {bad[0]['err']}")


def read_schema(root: str) -> Schema:
    """The schema kept as documents; InvalidSchema where its folders are missing or a document is bad."""
    out = Schema()
    for kind in ("predicates", "types"):
        folder = os.path.join(root, SCHEMA, kind)
        if not os.path.isdir(folder):
            raise InvalidSchema(f"no folder {SCHEMA}/{kind}")
        for name in sorted(os.listdir(folder)):
            if name.endswith(".md"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    add_definition(out, codec.parse_node(f.read(), META))
    out.check()
    return out


def _meta() -> Schema:
    from ..operators.schema import seed

    full = seed()
    names = ("role", "merge", "label", "aligned", "description", "required", "optional", "subClassOf")
    return Schema({n: full.predicates[n] for n in names}, {})


META = _meta()


def add_definition(schema: Schema, node: codec.Node) -> None:
    """Add a schema document's predicate or type."""
    first = lambda k: codec.show((node.attrs.get(k) or [""])[0])
    targets = lambda p: tuple(e.target for e in node.edges if e.predicate == p)
    about = node.texts.get("description") or node.texts.get("text", "")
    if node.type == "Property":
        schema.predicates[node.id] = Predicate(node.id, first("role"), first("merge"), first("label"), first("aligned"), about)
    elif node.type == "Class":
        schema.types[node.id] = Type(node.id, first("merge"), targets("required"), targets("optional"), targets("subClassOf"), about)
    else:
        raise InvalidSchema(f"{node.id}: {node.type} is neither Property nor Class")


def definition(schema: Schema, name: str) -> codec.Node:
    """The document of a predicate or type."""
    if name in schema.predicates:
        p = schema.predicates[name]
        attrs = {k: [v] for k, v in (("role", p.role), ("merge", p.merge), ("label", p.label), ("aligned", p.aligned)) if v}
        return codec.Node(name, "Property", attrs=attrs, texts={"text": p.description})
    t = schema.types[name]
    edges = [codec.Link(k, x) for k, xs in (("subClassOf", t.bases), ("optional", t.optional), ("required", t.required)) for x in xs]
    return codec.Node(name, "Class", attrs={"merge": [t.merge]} if t.merge else {}, texts={"text": t.description}, edges=edges)


def init(root: str, schema: Schema) -> list[str]:
    """A new graph's folders and schema documents; GraphError where the folder isn't empty."""
    if os.path.isdir(os.path.join(root, MARKER)):
        raise GraphError(f"{root} holds a graph already")
    if os.path.exists(root) and (not os.path.isdir(root) or os.listdir(root)):
        raise GraphError(f"{root} isn't an empty folder")
    made = []
    for folder in (MARKER, *FOLDERS):
        os.makedirs(os.path.join(root, folder), exist_ok=True)
    for kind, names in (("predicates", schema.predicates), ("types", schema.types)):
        for name in names:
            path = os.path.join(root, SCHEMA, kind, f"{name}.md")
            with open(path, "w", encoding="utf-8") as f:
                f.write(codec.render_node(definition(schema, name), META))
            made.append(path)
    return made


def _inner(path: str) -> str:
    """A document's path within the graph; GraphError for one outside."""
    made = os.path.normpath(path)
    if os.path.isabs(made) or made.startswith("..") or made.split(os.sep)[0] == MARKER:
        raise GraphError(f"{path} is outside the graph")
    return made


class Documents(DataSource):
    """A sink of documents (path, raw) as files of a folder that the driver and all executors share.

    Tasks write into a folder of their own under the marker; when all are done, the
    driver moves the files to their places.  If one fails, nothing is there.
    """

    @classmethod
    def name(cls) -> str:
        return "graphloom-documents"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        made = _Writer(self.options["path"], uuid.uuid4().hex)
        os.makedirs(made.pending)
        return made


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    paths: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.pending = root.removeprefix("file://"), os.path.join(root.removeprefix("file://"), MARKER, f"pending-{job}")

    def write(self, rows) -> WriterCommitMessage:
        folder, paths = os.path.join(self.pending, uuid.uuid4().hex), []
        os.mkdir(folder)  # fails once the job is aborted
        for row in rows:
            path = _inner(row["path"])
            _write_under(folder, os.path.dirname(path))
            with open(os.path.join(folder, path), "w", encoding="utf-8") as f:
                f.write(row["raw"])
            paths.append(path)
        return _Written(folder, paths)

    def commit(self, messages) -> None:
        for done in messages:
            for path in done.paths if done else ():
                full = os.path.join(self.root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                os.replace(os.path.join(done.folder, path), full)
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages) -> None:
        # tasks that still run find their folder gone, and can't make it anew
        gone = os.path.join(self.root, MARKER, f"aborted-{uuid.uuid4().hex}")
        os.rename(self.pending, gone)
        shutil.rmtree(gone, ignore_errors=True)


def _write_under(folder: str, inner: str) -> None:
    """Make the folders of ``inner`` in a folder that has to be there."""
    at = folder
    for name in inner.split(os.sep) if inner else ():
        at = os.path.join(at, name)
        try:
            os.mkdir(at)
        except FileExistsError:
            pass


def write(documents: DataFrame, root: str, packs: bool = False) -> None:
    """Write documents (path, raw) into a graph's folder, from the executors, all or none: as files, or as one more pack.

    GraphError, and nothing written, where a document of the graph can't be read
    or is of an older form, or where one for a pack is there as a file; null
    texts are empty documents.
    """
    spark = documents.sparkSession
    require_readable(read(spark, root))
    if packs:
        _write_pack(documents, root)
        return
    spark.dataSource.register(Documents)
    documents.select("path", F.coalesce("raw", F.lit("")).alias("raw")).write.format(Documents.name()).mode("append").save(root)


def _write_pack(documents: DataFrame, root: str) -> None:
    spark = documents.sparkSession

    def inside(frames):
        for frame in frames:
            yield frame.assign(path=[_inner(p) for p in frame["path"]])

    rows = documents.select("path", F.coalesce("raw", F.lit("")).alias("raw")).mapInPandas(inside, "path string, raw string")
    files = _paths(spark, root)
    there = None if files.isEmpty() else rows.join(files, "path", "left_semi").agg(F.min("path")).first()[0]
    if there is not None:
        raise GraphError(f"{there} is a file of the graph already")
    done = _pack_paths(spark, root)
    number = int(done[-1].rpartition("/")[2]) + 1 if done else 0
    base = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
    kept = rows.dropDuplicates(["path"]).sortWithinPartitions("path")
    kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{MARKER}/{PACKS}/{number:08d}")  # over what an aborted write has left


def write_node(root: str, path: str, text: str) -> None:
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(text)


def classify(source: str, catalog: str = "") -> tuple[str, str]:
    """(file, http or catalog; where it is) of a schema patch's source."""
    if source.startswith(("http://", "https://")):
        return "http", source
    name, found, rest = source.partition(":")
    if found and name == "catalog":
        return "catalog", catalog.rstrip("/") + "/" + rest
    return "file", source


def fetch(source: str, catalog: str = "", timeout: float = 30.0) -> str:
    """A schema patch's text."""
    kind, where = classify(source, catalog)
    if kind == "file":
        with open(where, encoding="utf-8") as f:
            return f.read()
    with urllib.request.urlopen(where, timeout=timeout) as answer:
        if not 200 <= answer.status < 300:
            raise GraphError(f"{where}: status {answer.status}")
        return answer.read().decode("utf-8")
