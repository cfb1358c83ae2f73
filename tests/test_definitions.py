import pytest

from graphloom.model import InvalidSchema
from graphloom.operators import definitions
from graphloom.operators.schema import seed
from graphloom.streaming import ingest

PATCH = """---
kind: patch
document: more
published: 2031-01-01
---
# Property

## habitat
```yaml
role: meta
merge: union
label: Habitat
```

Where it lives.

# Class

## Species
```yaml
merge: union
```

A kind of animal.

- subClassOf:: [[Entity]]
- required:: [[habitat]]
"""


def test_apply():
    made, done = definitions.apply(seed(), PATCH)
    assert done.created == ["habitat", "Species"] and made.role_of("habitat") == "meta"
    assert "Species" in definitions.usage(made)["definition"]
    again, done = definitions.apply(made, PATCH)
    assert done.unchanged == ["habitat", "Species"] and again == made
    more = PATCH.replace("Where it lives.", "The waters in which the animal can be met.").replace("label: Habitat", "label: Place")
    third, done = definitions.apply(made, more)
    assert done.updated == ["habitat"] and done.conflicts == ["habitat.label"]
    assert third.predicates["habitat"].description == "Where it lives.\n\nThe waters in which the animal can be met." and third.label_of("habitat") == "Habitat"


@pytest.mark.parametrize("change", [("role: meta", "role: odd"), ("# Class", "# Entity"), ("[[Entity]]", "[[Nothing]]"), ("[[Entity]]", "[[Species]]"), ("Where it lives.\n", "")])
def test_all_or_nothing(change):
    with pytest.raises(InvalidSchema):
        definitions.apply(seed(), PATCH.replace(*change, 1))


def test_stream(spark, tmp_path):
    rows = [("a", "k", 1, "d1", "x"), ("a", "k", 2, "d2", "y"), ("b", "k", 3, "d1", "z")]
    schema = "id string, key string, seq long, source string, value string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    ingest.append_log(stream(), f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3


def test_tables_of_types(spark):
    from graphloom.operators import schema as schemas

    table = lambda rows: spark.createDataFrame([(n, [f"r{n}"], [f"o{n}"], b) for n, b in rows], "name string, required array<string>, optional array<string>, bases array<string>")
    line = [("Node", [])] + [(f"T{i}", [f"T{i - 1}"] if i else []) for i in range(20)]
    got = {(r["type"], r["predicate"]): r["required"] for r in schemas.contract_frame(table(line)).collect()}
    own = {n: schemas.Type(n, "", (f"r{n}",), (f"o{n}",), tuple(b)) for n, b in line}
    assert got == {(t.name, p): p in t.required for t in schemas.effective(own).values() for p in t.required + t.optional}
    with pytest.raises(InvalidSchema, match="T1: cycle T1.*T9: no base U"):
        schemas.contract_frame(table([("Node", []), ("T1", ["T2"]), ("T2", ["T1"]), ("T9", ["U"])]))
    assert not [t.name for t in spark.catalog.listTables()]
