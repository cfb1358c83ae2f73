"""Tables of patches in a store: as one by one, over snapshots, and stopped midway."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import merge
from graphloom.operators import store as module
from graphloom.operators.schema import seed
from graphloom.operators.store import GraphStore

NOW = dt.datetime(2031, 6, 1, 12)


def patch(name: str, r: random.Random) -> str:
    node = r.choice(["A", "B", "C", "D"])
    more = r.choice(["", "\n**Seen near**\n- seenNear:: [[Reef]]\n", "\n- broader:: [[doc-1]]\n", "\n**Colour**\nIt is bright.\n"])
    kind = r.choice(["Entity", "Entity", "Creature"])
    return f"---\nkind: patch\ndocument: {name}\npublished: 2031-0{r.randrange(1, 9)}-01\n---\n# Source\n\n## {name}\n```yaml\ntitle: {name}\ntags: [{r.choice('xyz')}]\n```\n\nAbout [[{node}]].\n\n# {kind}\n\n## {node}\n```yaml\naliases: [{r.choice('pqrs')}]\ncategory: [{r.choice('uv')}]\n```\n\nWords {r.choice('klm')} of it that are long enough to count.\n{more}"


def patches(seed_: int, n: int = 12) -> list[str]:
    r = random.Random(seed_)
    return [patch(f"doc-{r.randrange(9)}", r) for _ in range(n)] + ["nothing", patch("a/b", r).replace("## a/b", "## a/b", 1)]


def table(spark, texts, at=NOW):
    return spark.createDataFrame([(i, at, t) for i, t in enumerate(texts)], "seq long, at timestamp, raw string").repartition(3)


def content(g):
    return [sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())) for df in (g.nodes.select("id", "type", "published", "path"), g.attrs, g.texts, g.edges, g.hrefs)]


def one_by_one(store, texts):
    out = []
    for i, t in enumerate(texts):
        try:
            done = store.apply(t, NOW)
            out.append((i, "skipped" if done.skipped else "done", done.document, done.created, done.merged))
        except ValueError:
            out.append((i, "refused", None, {}, {}))
        except module.GraphError:
            out.append((i, "refused", None, {}, {}))
    return out


def test_as_one_by_one(spark, tmp_path):
    first, second = patches(1), patches(2)
    plain, bulk = GraphStore(spark, f"file://{tmp_path}/a", seed()), GraphStore(spark, f"file://{tmp_path}/b", seed())
    for texts in (first, second):
        want = one_by_one(plain, texts)
        done = bulk.apply_all(table(spark, texts))
        assert {r["seq"] for r in done.refused.collect()} == {i for i, what, *_ in want if what == "refused"}
        assert {(r["seq"], r["document"]) for r in done.skipped.collect()} == {(i, d) for i, what, d, *_ in want if what == "skipped"}
        counts = {(r["document"], r["type"]): (r["created"], r["merged"]) for r in done.counts.collect()}
        assert counts == {(d, t): (c.get(t, 0), m.get(t, 0)) for _, what, d, c, m in want if what == "done" for t in c | m}
    assert bulk.schema.types.keys() == plain.schema.types.keys() and bulk.schema.predicates == plain.schema.predicates
    messages = lambda s: {r["source_id"]: r["message"] for r in s.commits.collect()}
    assert messages(bulk) == messages(plain)
    assert GraphStore(spark, bulk.root, seed()).schema.predicates == plain.schema.predicates
    assert content(bulk.graph()) == content(plain.graph())


def test_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "BUCKETS", 8)
    store = GraphStore(spark, f"file://{tmp_path}/a", seed())
    assert store.compact() == []
    store.apply_all(table(spark, patches(3)))
    assert store.compact() and store.compact() == []
    whole = lambda: content(module.fold(store.live(), store.schema))
    assert content(store.graph()) == whole()
    store.apply_all(table(spark, patches(4)))
    assert content(store.graph()) == whole()
    store.revert("doc-1", NOW)  # others link to it
    assert content(store.graph()) == whole()
    one = store.compact()
    assert one and content(store.graph()) == whole()
    store.apply(patch("late", random.Random(8)), NOW)
    touched = {r[0] for r in store.contributions.where("document = 'late'").select(module._bucket("id")).collect()}
    assert set(store.compact()) == touched and len(touched) < 8  # the others stay as they are
    assert content(store.graph()) == whole() and content(GraphStore(spark, store.root, seed()).graph()) == whole()
    from dataclasses import replace

    store.schema.predicates["aliases"] = replace(store.schema.predicates["aliases"], merge="lastWriteWin")
    assert content(store.graph()) == whole()  # a snapshot under other policies counts for nothing


def test_a_stopped_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, f"file://{tmp_path}/a", seed())
    store.apply_all(table(spark, patches(5)))
    before, commits = content(store.graph()), store.commits.count()
    monkeypatch.setattr(module, "BATCHES", "batch string")  # the last write fails
    with pytest.raises(Exception):  # noqa: B017
        store.apply_all(table(spark, patches(6)))
    monkeypatch.undo()
    store = GraphStore(spark, store.root, seed())
    assert content(store.graph()) == before and store.commits.count() == commits
    assert store.apply_all(table(spark, patches(6))).counts.count() > 0
    assert store.apply_all(table(spark, [])).counts.count() == 0


def fold_paragraphs(rows):
    """The plain fold over (seq, value)."""
    import re

    runs = lambda p: (lambda w: {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))})(p.split())
    split = lambda t: [p for p in (re.sub(r"^\s+|\s+$", "", p) for p in t.split("\n\n")) if p]
    text, last = "", None
    for seq, value in sorted(rows):
        if not value.strip(" "):
            continue
        if not text.strip(" "):
            text, last = value, seq
            continue
        old = split(text)
        near = lambda p: any(len(runs(p) & runs(o)) > 0.8 * len(runs(p) | runs(o)) for o in old)
        new = "\n\n".join(old + [p for p in split(value) if not near(p)])
        if new != text:
            text, last = new, seq
    return text, last


def test_paragraphs_of_a_hub(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(30)}" for _ in range(r.choice([1, 2, 8, 20, 21]))] for _ in range(12)]

    def paragraph():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = f"w{r.randrange(30)}"
        return " ".join(w)

    rows = [(f"n{i % 3}", "k", i, "\n\n".join(paragraph() for _ in range(r.choice([1, 1, 2, 4]))) if r.random() < 0.95 else r.choice(["", "  "])) for i in range(240)]
    rows += [("m", "k", 1, " one \n\n\n two "), ("m", "k", 2, "one"), ("o", "k", 5, " raw \n\n stays "), ("p", "k", 1, "")]
    got = {r["id"]: (r["value"], r["seq"]) for r in merge.merge_paragraph_rows(spark.createDataFrame(rows, "id string, key string, seq long, value string")).collect()}
    assert got == {i: fold_paragraphs([x[2:] for x in rows if x[0] == i]) for i in ("n0", "n1", "n2", "m", "o")}


def test_a_hub_in_the_fold(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, f"file://{tmp_path}/a", seed())
    store.apply_all(table(spark, patches(7, 30)))
    small = content(store.graph())
    monkeypatch.setattr(module, "HUB", 1)
    assert content(store.graph()) == small


def test_many_contributions_to_one_node(spark):
    rows = spark.range(200_000).select(F.lit("hub").alias("id"), F.lit("k").alias("key"), F.col("id").alias("seq"), F.concat(F.lit("the same words for all of them here "), (F.col("id") % 50).cast("string"), F.lit(" and on")).alias("value"), F.lit("d").alias("source"))
    out = merge.merge_paragraph_rows(rows.select("id", "key", "seq", "value")).first()
    assert len(out["value"].split("\n\n")) == 50 and out["seq"] == 49
    flags = merge.merge_scalars(rows.where("seq < 2000"), "firstWriteWin").first()
    assert flags["conflict"] and flags["value"].count(">>>>>>> ") == 1999


def test_patches_of_a_small_file_are_read_by_many_tasks(spark):
    from graphloom.plans import documents

    patches = documents._patches(spark, "/root/testdata/sf0.1")
    per_task = [r["count"] for r in patches.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 15_000 and max(per_task) < 8_000


def test_parsed_patches_keep_their_times(spark):
    texts = [patch(f"doc-{i}", random.Random(i)) for i in range(3)] + ["nothing"]
    at = [dt.datetime(2031, 6, 1, 12, 0, i, 7) for i in range(4)]
    given = spark.createDataFrame(list(zip(range(4), at, texts)), "seq int, at timestamp, raw string")
    rows = module.parse(given, seed()).select("seq", "at", "err").distinct().collect()
    assert {(r["seq"], r["at"]) for r in rows} == set(enumerate(at)) and [r["seq"] for r in rows if r["err"]] == [3]
