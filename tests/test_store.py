import datetime as dt

import pytest

from graphloom.model import GraphError, NodeNotFound
from graphloom.operators import lint
from graphloom.operators.filters import Filter
from graphloom.operators.schema import contract, seed
from graphloom.operators.store import GraphStore
from graphloom.plans import service
from graphloom.sources import codec, config, corpus

from .test_codec import PATCH

NOW, LATER = dt.datetime(2031, 6, 1, 12), dt.datetime(2031, 7, 1, 12)
SECOND = """---
kind: patch
document: wen-2030
published: 2030-04-01
---
# Source

## wen-2030
```yaml
title: Older reefs
```

About reefs.

# Entity

## Staghorn Coral
```yaml
aliases: [Acropora]
```

It was seen in many other warm waters before.

## Only Here
```yaml
```
"""


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"file://{tmp_path}/g", seed())


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def test_apply_revert(spark, store):
    first = store.apply(PATCH, NOW)
    assert first.created == {"Source": 1, "Entity": 1} and "Source-Id: okafor-2031-reefs" in first.message
    assert store.apply(PATCH, NOW).skipped
    second = store.apply(SECOND, LATER)
    assert second.created == {"Source": 1, "Entity": 1} and second.merged == {"Entity": 1}
    g = store.graph()
    assert ids(g.nodes) == {"okafor-2031-reefs", "wen-2030", "Staghorn Coral", "Only Here"}
    text = {(r["id"], r["key"]): r["value"] for r in g.texts.collect()}
    assert text["Staghorn Coral", "definition"].startswith("A branching coral.") and "warm waters" in text["Staghorn Coral", "definition"]
    attrs = {(r["id"], r["key"]) for r in g.attrs.collect()}
    assert ("Staghorn Coral", "updated") in attrs and ("Only Here", "indexed") not in attrs
    assert [(r["period"], r["doc_id"], r["pos"]) for r in store.timeline().orderBy("period").collect()] == [("2030", "wen-2030", 1), ("2030-04", "wen-2030", 1), ("2031", "okafor-2031-reefs", 1), ("2031-05", "okafor-2031-reefs", 1)]
    back = store.revert("okafor-2031-reefs", LATER)
    assert back.removed == {"Source": 1} and back.reconciled == {"Entity": 1} and back.approach == "per node"
    g = store.graph()
    assert ids(g.nodes) == {"wen-2030", "Staghorn Coral", "Only Here"}
    assert {r["key"]: r["value"] for r in g.texts.where("id = 'Staghorn Coral'").collect()} == {"definition": "It was seen in many other warm waters before."}
    assert store.revert("okafor-2031-reefs", LATER).skipped
    assert not store.apply(PATCH, LATER).skipped
    assert store.revert("okafor-2031-reefs", LATER).removed == {"Source": 1}
    with pytest.raises(GraphError):
        store.revert("okafor-2031", LATER)


def test_whole_commit_revert_and_sweep(spark, store):
    store.apply(PATCH, NOW)
    other = SECOND.replace("Staghorn Coral", "Other").replace("It was seen", "- related:: [[okafor-2031-reefs]]\n\nIt was seen")
    store.apply(other, NOW)
    assert store.graph().edges.where("dst = 'okafor-2031-reefs'").count() == 1
    out = store.revert("okafor-2031-reefs", NOW)
    assert out.approach == "whole commit" and out.links_removed == 1
    assert store.graph().edges.where("dst = 'okafor-2031-reefs'").count() == 0


def test_conflict_dissolves_with_its_source(spark, store):
    doc = lambda name, words: f"---\nkind: patch\ndocument: {name}\npublished: 2031-01-01\n---\n# Source\n\n## {name}\n```yaml\ntitle: {name}\n```\n\n# Entity\n\n## E\n```yaml\nheading: {words}\n```\n\n**Slogan**\n- {words}\n"
    store.schema.register_predicate("slogan", "text", "Slogan")
    from dataclasses import replace

    store.schema.predicates["slogan"] = replace(store.schema.predicates["slogan"], merge="firstWriteWin")
    store.apply(doc("d1", "one"), NOW)
    store.apply(doc("d2", "two"), NOW)
    value = lambda: store.graph().texts.where("id = 'E' and key = 'slogan'").first()["value"]
    assert value().startswith("<<<<<<< existing\n- one\n=======")
    store.revert("d1", NOW)
    assert value() == "- two"


@pytest.fixture
def folder(tmp_path):
    root = str(tmp_path / "kb")
    corpus.init(root, seed())
    for n in codec.parse_patch(PATCH, seed()).nodes:
        n.published, n.attrs["created"] = dt.datetime(2031, 5, 9), ["2031-06-01T00:00:00Z"]
        if n.type == "Entity":
            n.edges += [codec.Link("mentionedIn", "okafor-2031-reefs")]
        path = {"Source": "sources", "Entity": "entities"}[n.type] + f"/{n.id}.md"
        corpus.write_node(root, path, codec.render_node(n, seed()))
    return root


def run_lint(spark, root, commits=None):
    schema = corpus.read_schema(root)
    parsed = corpus.read(spark, root, schema).cache()
    preds, types = schema.frames(spark)
    found = lint.lint(parsed, corpus.graph(parsed), preds, types, contract(spark, schema.types), commits)
    return parsed, {(r["rule"], r["id"]) for r in found.collect()}, found


def test_folder_and_service(spark, folder):
    with pytest.raises(GraphError):
        corpus.init(folder, seed())
    schema = corpus.read_schema(folder)
    assert len(schema.predicates) == 54 and schema.types["Entity"].required == ("category", "definition", "mentionedIn")
    corpus.write_node(folder, "broken.md", "nothing")
    parsed = corpus.read(spark, folder, schema)
    assert [r["path"] for r in corpus.unreadable(parsed).collect()] == ["broken.md"]
    g = corpus.graph(parsed)
    rows = service.search(g, "coral", Filter(types=("Entity",))).collect()
    assert [(r["id"], r["text"]) for r in rows] == [("Staghorn Coral", "A branching coral.")]
    assert "| Entity | Staghorn Coral |" in service.node_grep(g, "coral", {"attrs": {"category": "OBJECT"}})
    assert "A branching coral." in service.node_get(g, "Staghorn Coral", schema)
    with pytest.raises(NodeNotFound):
        service.node_get(g, "none")
    text = service.subgraph_get(g, "Staghorn Coral", NOW, schema=schema)
    again = codec.parse_patch(text, schema)
    assert {n.id for n in again.nodes} == {"Staghorn Coral", "okafor-2031-reefs"} and again.stats["reachableBacklinks"] == 1
    assert config.load(folder) == config.Config()
    config.save(folder, config.Config(max_line_width=80))
    assert config.load(folder).max_line_width == 80
    assert corpus.classify("catalog:x/y", "https://e/c") == ("catalog", "https://e/c/x/y") and corpus.classify("http://a")[0] == "http"


def test_lint(spark, folder):
    commits = spark.createDataFrame([("okafor-2031-reefs",)], "source_id string")
    parsed, found, rows = run_lint(spark, folder, commits)
    assert found == {("linkResolves", "Staghorn Coral")}
    assert tuple(lint.summary(parsed, rows).first()) == (2, 1, 1)
    put = lambda path, head, body="": corpus.write_node(folder, path, f"---\n{head}\n---\n{body}")
    put("entities/Coral.md", '"@id": Coral\n"@type": Entity\npublished: 2031-01-01\ncreated: x\ncategory: [a, b, c, d]\nodd_Name: 1', "\nIt is [critiques:: [[Staghorn Coral]]] and [related:: [[Staghorn Coral]]].\n")
    put("x/Coral.md", '"@id": Coral\n"@type": lower')
    put("y/wrong.md", '"@id": other\n"@type": Entity')
    put("y/open.md", '"@id": open\n"@type": Entity', "\n<<<<<<< existing\n")
    put("y/bare.md", "@id: bare\n@type: Entity")
    put("sources/lone.md", '"@id": lone\n"@type": Source\ntitle: t', "\n- abstract:: [[Coral]]\n")
    rules = run_lint(spark, folder, commits)[1]
    for want in [("uniqueBasename", "Coral"), ("frontMatter", "wrong"), ("mergeConflict", "open"), ("identityQuoting", "bare"), ("frontMatter", "bare"), ("ingestCommit", "lone"), ("predicateRole", "lone"), ("typeRequires", "lone"), ("typeCase", "Coral"), ("unrecognizedKind", "Coral"), ("derivedProvenance", "Coral")]:
        assert want in rules, want
    assert not any(i == "open" and r != "mergeConflict" for r, i in rules)


def test_a_write_without_its_commit_counts_for_nothing(spark, tmp_path):
    from graphloom.operators import store as module

    store = GraphStore(spark, f"file://{tmp_path}/g", seed())
    store.apply(PATCH, NOW)
    patch = codec.parse_patch(SECOND, seed())
    rows = module.rows_of(patch, 2, LATER)
    spark.createDataFrame(rows, module.CONTRIBUTIONS).write.mode("append").parquet(f"{store.root}/contributions")
    assert ids(store.graph().nodes) == {"okafor-2031-reefs", "Staghorn Coral"}  # stopped before the commit
    assert not store.apply(SECOND, LATER).skipped and store.commits.where("source_id = 'wen-2030'").first()["seq"] == 3
    assert store.contributions.where("document = 'wen-2030'").count() == len(rows)


def test_a_reopened_store_knows_its_definitions(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    first = GraphStore(spark, root, seed())
    text = SECOND.replace("# Entity", "# Creature").replace("It was seen", "**Seen near**\n- seenNear:: [[Reef]]\n\nIt was seen")
    assert "type Creature is new" in first.apply(text, NOW).warnings
    again = GraphStore(spark, root, seed())
    assert again.schema.types["Creature"] == first.schema.types["Creature"] and again.schema.predicates["seenNear"] == first.schema.predicates["seenNear"]
    assert "Creature" not in seed().types


def test_updated_only_by_a_change(spark, store):
    doc = lambda name, extra="": f"---\nkind: patch\ndocument: {name}\npublished: 2031-01-01\n---\n# Source\n\n## {name}\n```yaml\ntitle: {name}\n```\n\n# Entity\n\n## E\n```yaml\naliases: [a{extra}]\n```\n\nThe same words for all of them here.\n\n- broader:: [[B]]\n"
    stamps = lambda: {r["key"]: r["value_str"] for r in store.graph().attrs.where("id = 'E'").collect() if r["key"] in ("indexed", "updated")}
    store.apply(doc("d1"), NOW)
    store.apply(doc("d2"), LATER)
    assert stamps() == {"indexed": "2031-06-01T12:00:00Z"}
    store.apply(doc("d3", ", b"), LATER)
    assert stamps() == {"indexed": "2031-06-01T12:00:00Z", "updated": "2031-07-01T12:00:00Z"}


def test_published_follows_its_policy(spark, store):
    from dataclasses import replace

    doc = lambda name, day: f'---\nkind: patch\ndocument: {name}\npublished: 2031-01-01\n---\n# Entity\n\n## E\n```yaml\npublished: {day}\nheading: x\n```\n'
    store.apply(doc("d1", "2030-01-01"), NOW)
    store.apply(doc("d2", "2030-05-05"), NOW)
    value = lambda: f"{store.graph().nodes.where('id = ' + repr('E')).first()['published']:%Y-%m-%d}"
    assert value() == "2030-01-01"
    store.schema.predicates["published"] = replace(store.schema.predicates["published"], merge="lastWriteWin")
    assert value() == "2030-05-05"


def test_schema_patches_last(spark, store):
    from graphloom.model import InvalidSchema

    text = "---\nkind: patch\ndocument: more\npublished: 2031-01-01\n---\n# Property\n\n## habitat\n```yaml\nrole: edge\nmerge: union\nlabel: Lives in\n```\n\nWhere it lives.\n"
    done = store.apply_schema(text)
    assert done.created == ["habitat"] and store.commits.count() == 1
    assert store.apply_schema(text).unchanged == ["habitat"] and store.commits.count() == 1
    grown = text.replace("Where it lives.", "Where it lives.\n\nThe waters in which the animal can be met.")
    assert store.apply_schema(grown).updated == ["habitat"]
    with pytest.raises(InvalidSchema):
        store.apply_schema(text.replace("role: edge", "role: odd").replace("habitat", "other"))
    again = GraphStore(spark, store.root, seed())
    assert again.schema.predicates["habitat"] == store.schema.predicates["habitat"] and "animal" in again.schema.predicates["habitat"].description and "other" not in again.schema.predicates


def test_documents_written_by_executors(spark, folder):
    docs = [(f"entities/N{i} ü+%20.md", f'---\n"@id": "N{i} ü+%20"\n"@type": Entity\n---\n\n# N\n\nText {i}.\n') for i in range(40)] + [("deep/er/X.md", '---\n"@id": X\n"@type": Entity\n---\n')]
    corpus.write(spark.createDataFrame(docs, "path string, raw string").repartition(4), f"file://{folder}")
    for root in (folder, f"file://{folder}"):
        got = {r["path"]: r["raw"] for r in corpus.read(spark, root).collect()}
        assert got.items() >= dict(docs).items() and len(got) == 43
    with pytest.raises(Exception, match="outside"):  # one task fails, so nothing of the others is there
        corpus.write(spark.createDataFrame([(f"new/A{i}.md", "x") for i in range(20)] + [("../out.md", "x")], "path string, raw string").repartition(5), folder)
    assert not (set(corpus.walk(folder)) ^ set(got)) and not [f for f in __import__("os").listdir(f"{folder}/{corpus.MARKER}") if f.startswith("pending")]
    corpus.write_node(folder, "broken.md", "nothing")
    with pytest.raises(GraphError, match="broken.md"):
        corpus.write(spark.createDataFrame(docs[:1], "path string, raw string"), folder)
    with pytest.raises(GraphError):
        corpus.read(spark, f"file://{folder}/entities")


def test_an_aborted_write_leaves_no_folder_that_a_late_task_could_fill(folder):
    import os

    sink = corpus.Documents({"path": str(folder)}).writer(None, False)
    assert os.path.isdir(sink.pending)
    sink.abort([])
    with pytest.raises(FileNotFoundError):
        sink.write([{"path": "late/A.md", "raw": "x"}])
    assert not [f for f in os.listdir(f"{folder}/{corpus.MARKER}") if f.startswith(("pending", "aborted"))]


def test_documents_in_packs(spark, folder):
    import os

    doc = lambda i, text: (f"many/N{i}.md", f'---\n"@id": N{i}\n"@type": Entity\n---\n\n# N\n\n{text} {i}.\n')
    table = lambda rows: spark.createDataFrame(rows, "path string, raw string").repartition(3)
    files = corpus.walk(folder)
    corpus.write(table([doc(i, "Old") for i in range(30)]), folder, packs=True)
    corpus.write(table([doc(i, "New") for i in range(20, 40)]), f"file://{folder}", packs=True)
    corpus.write(table([doc(0, "Edited")]), folder)
    assert corpus.walk(folder) == sorted([*files, "many/N0.md"])  # packs take no file for each document
    want = dict([*(doc(i, "Old") for i in range(20)), *(doc(i, "New") for i in range(20, 40)), doc(0, "Edited")])
    for root in (folder, f"file://{folder}"):
        rows = corpus.read(spark, root).collect()
        assert {r["path"]: r["raw"] for r in rows if r["path"].startswith("many/")} == want and len(rows) == len(files) + 40
    with pytest.raises(GraphError, match="many/N0.md"):
        corpus.write(table([doc(0, "Hidden")]), folder, packs=True)
    with pytest.raises(Exception, match="outside"):
        corpus.write(table([("../out.md", "x")]), folder, packs=True)
    assert len(os.listdir(f"{folder}/{corpus.MARKER}/{corpus.PACKS}")) == 2


def test_grep_text(spark, folder):
    g = corpus.graph(corpus.read(spark, folder, corpus.read_schema(folder)))
    assert "branching \x1b[1mcoral\x1b[0m" in service.grep_text(g, "coral", color=True) and "\x1b" not in service.grep_text(g, "coral")
