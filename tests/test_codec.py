import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.model import InvalidDocument
from graphloom.operators.schema import seed
from graphloom.sources import codec

PATCH = """---
kind: patch
document: okafor-2031-reefs
published: 2031-05-09
title: "Reef recovery"
---
# Source

## okafor-2031-reefs
```yaml
title: "Reef recovery"
authors: [Ada Okafor, Li Wen]
tags: [ocean, Biology]
```

Survey of [[Staghorn Coral|staghorn]] regrowth.

**Mentions**
- mentions:: [[Staghorn Coral]]

# Entity

## Staghorn Coral
```yaml
category: [independent, physical, continuant, object]
```

A branching coral.

- broader:: [[Coral]]
- grows fast
"""


def test_patch():
    p = codec.parse_patch(PATCH, seed())
    a, b = p.nodes
    assert (p.document, p.published, p.title) == ("okafor-2031-reefs", dt.datetime(2031, 5, 9), "Reef recovery")
    assert a.texts == {"abstract": "Survey of staghorn regrowth."}
    assert a.hrefs == [codec.Link("", "Staghorn Coral", "staghorn")]
    assert a.edges == [codec.Link("mentions", "Staghorn Coral")]
    assert a.attrs["authors"] == ["Ada Okafor", "Li Wen"]
    assert b.texts == {"definition": "A branching coral.\n\n* grows fast"}
    assert b.edges == [codec.Link("broader", "Coral")]


def test_patch_round_trip():
    p = codec.parse_patch(PATCH, seed())
    text = codec.render_patch(p, seed())
    again = codec.parse_patch(text, seed())
    assert sorted(again.nodes, key=lambda n: n.id) == sorted(p.nodes, key=lambda n: n.id)
    assert codec.render_patch(again, seed()) == text


@pytest.mark.parametrize(
    "head",
    ["kind: patch", '"@type": Source', '"@id": x', '"@id": x\n"@type": Source\nkind: old', "[a", '"@id": 5\n"@type": Source'],
)
def test_bad_nodes(head):
    with pytest.raises(InvalidDocument):
        codec.parse_node(f"---\n{head}\n---\n")


@pytest.mark.parametrize("text", [PATCH.replace("kind: patch", "kind: note"), PATCH.replace("# Source\n", "", 1), PATCH.replace("# Entity", "# entity"), PATCH.replace("published: 2031-05-09", "published: soon")])
def test_bad_patches(text):
    with pytest.raises(InvalidDocument):
        codec.parse_patch(text, seed())


def test_unknown_label_keeps_its_heading():
    n = codec.parse_node('---\n"@id": x\n"@type": Note\n---\n\nlead\n\n## Related Aporias\n- [[A]]\n- plain\n\n> quoted\n')
    assert n.edges == [codec.Link("relatedAporias", "A")] and n.texts["relatedAporias"] == "- plain"
    assert n.labels == {"relatedAporias": "Related Aporias"} and n.texts["notes"] == "> quoted"


def test_typed_inline_link_round_trip():
    n = codec.Node("x", "Source", texts={"abstract": "It supports growth of corals."}, hrefs=[codec.Link("supports", "growth"), codec.Link("", "coral")])
    text = codec.render_node(n, seed())
    assert "[supports:: [[growth]]]" in text and "[[coral|corals]]" in text
    back = codec.parse_node(text, seed())
    assert back.texts == n.texts and [h.target for h in back.hrefs] == ["growth", "coral"]


words = st.text("abcdeé ", min_size=1, max_size=12).map(lambda s: " ".join(s.split())).filter(bool)
names = st.text("abcXYZ", min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(
    attrs=st.dictionaries(names, st.lists(st.one_of(words, st.integers(), st.booleans()), min_size=1, max_size=3), max_size=3),
    lead=words,
    edges=st.lists(st.builds(codec.Link, st.sampled_from(["broader", "cites", ""]), words, st.one_of(st.just(""), words)), max_size=4),
    date=st.one_of(st.none(), st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2040, 1, 1)).map(lambda d: d.replace(hour=0, minute=0, second=0, microsecond=0))),
)
def test_node_round_trip(attrs, lead, edges, date):
    attrs.pop("published", None)
    n = codec.Node("a b", "Entity", date, attrs, {"definition": lead}, [], edges)
    text = codec.render_node(n, seed())
    back = codec.parse_node(text, seed())
    assert (back.id, back.type, back.published, back.attrs, back.texts) == (n.id, n.type, n.published, n.attrs, n.texts)
    key = lambda e: (e.predicate, e.target, e.alias)
    assert sorted(map(key, back.edges)) == sorted(map(key, edges))
    assert codec.render_node(back, seed()) == text


@pytest.mark.parametrize(("value", "shown"), [(None, ""), (True, "true"), (1.0, "1"), (2.5, "2.5"), ([1, "a"], "[1 a]"), ({"b": 1, "a": 2}, "map[a:2 b:1]")])
def test_show(value, shown):
    assert codec.show(value) == shown


HEADS = ["a: 1\nb: [x, 2.5, true]\n", "a: !x", "a: >#b", "a: |\n  b\n", "[b ?c]", "a: 'b", "a:\t1", "a: \x85b", "a: 2031-02-03\n\"@id\": P1", "{a: b, c: ~}", "a: b: c", "x: \ue000"]


@pytest.mark.parametrize("head", HEADS)
def test_compiled_yaml_reads_as_the_plain_one(head):
    def read(load):
        try:
            return repr(load(head))
        except codec.yaml.YAMLError as e:
            return str(e)

    assert read(codec._load) == read(codec.yaml.safe_load)


@pytest.mark.parametrize("value", ["a b", "a  b", "yes", "Null", "n", "a_1", "1a", "", "a ", True, ["a", "b c"], ["a", "no"], [], ["a", 1], 1])
def test_values_written_without_the_emitter(value):
    plain = codec.yaml.safe_dump(value, default_flow_style=True, allow_unicode=True, width=1 << 20).strip().removesuffix("\n...").strip()
    assert codec._dump(value) == plain


def test_documents_are_parsed_once_and_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from graphloom.session import spread
    from graphloom.sources import corpus

    doc = F.concat(F.lit('---\n"@id": P'), (F.col("id") % 7).cast("string"), F.lit('\n"@type": Entity\n---\nWords ['), F.lit("[X]].\n"))
    docs = spread(spark.range(20, numPartitions=1), 5).select(F.concat(F.lit("a/"), "id").alias("path"), doc.alias("raw"))
    assert docs.select(F.spark_partition_id()).distinct().count() == 4
    g = corpus.graph(corpus.parse(docs, seed()))
    for table in (g.nodes, g.texts, g.hrefs):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {r["path"] for r in g.nodes.collect()} == {f"a/{max((i for i in range(20) if i % 7 == k), key=str)}" for k in range(7)}


def test_labels_are_gathered_only_where_a_title_needs_them(monkeypatch):
    from graphloom.operators.schema import Schema, seed

    asked = []
    real = Schema.by_label
    monkeypatch.setattr(Schema, "by_label", lambda self: asked.append(1) or real(self))
    patch = "---\nkind: patch\ndocument: d\npublished: 2031-01-01\n---\n# Entity\n\n## A\n\nPlain words.\n\n- broader:: [[B]]\n\n## C\n```yaml\ntitle: c\n```\n\nMore.\n\n# Source\n\n## d\n```yaml\ntitle: d\n```\n\n**Mentions**\n- mentions:: [[C]]\n"
    made = codec.parse_patch(patch, seed())
    assert [n.id for n in made.nodes] == ["C", "d"] and made.nodes[1].edges[0].target == "C" and len(asked) == 1
