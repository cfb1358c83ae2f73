"""The schema: predicates with role and merge policy, types with their contracts, and inheritance."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PREDICATES, TYPES, InvalidSchema
from ..session import cut
from .merge import OPS

ROLES = ("meta", "text", "href", "edge", "link")
ROOT, EXEMPT = "Node", ("Node", "Property", "Class")  # every other type extends the root

PREFIX = "graph"  # of the terms that no public vocabulary has

#: The seeded predicates, as name, role, merge policy, aligned term and label.
SEED_PREDICATES = (
    ("tags", "meta", "union", "", ""),
    ("text", "text", "append", "schema:text", ""),
    ("published", "meta", "immutable", "", ""),
    ("created", "meta", "immutable", "", ""),
    ("updated", "meta", "lastWriteWin", "", ""),
    ("indexed", "meta", "immutable", PREFIX + ":indexed", ""),
    ("scoreZ", "meta", "validatedOverwrite", PREFIX + ":scoreZ", ""),
    ("scoreC", "meta", "validatedOverwrite", PREFIX + ":scoreC", ""),
    ("mentions", "link", "union", "schema:mentions", ""),
    ("mentionedIn", "link", "union", "schema:subjectOf", ""),
    ("broader", "edge", "union", "skos:broader", ""),
    ("narrower", "edge", "union", "skos:narrower", ""),
    ("isPartOf", "edge", "union", "dcterms:isPartOf", ""),
    ("hasPart", "edge", "union", "schema:hasPart", ""),
    ("requires", "edge", "union", "dcterms:requires", ""),
    ("replaces", "edge", "union", "dcterms:replaces", ""),
    ("isReplacedBy", "edge", "union", "dcterms:isReplacedBy", ""),
    ("conformsTo", "edge", "union", "dcterms:conformsTo", ""),
    ("related", "edge", "union", "skos:related", ""),
    ("referencedBy", "edge", "union", "", ""),
    ("cites", "link", "append", "cito:cites", ""),
    ("citesAsEvidence", "edge", "union", "cito:citesAsEvidence", ""),
    ("citesAsAuthority", "edge", "union", "cito:citesAsAuthority", ""),
    ("supports", "edge", "union", "cito:supports", ""),
    ("confirms", "edge", "union", "cito:confirms", ""),
    ("extends", "edge", "union", "cito:extends", ""),
    ("critiques", "edge", "union", "cito:critiques", ""),
    ("disputes", "edge", "union", "cito:disputes", ""),
    ("refutes", "edge", "union", "cito:refutes", ""),
    ("isCitedBy", "link", "union", "cito:isCitedBy", ""),
    ("title", "meta", "immutable", "", ""),
    ("abstract", "text", "append", "", ""),
    ("authors", "meta", "union", "", ""),
    ("url", "meta", "fillIfEmpty", "", ""),
    ("doi", "meta", "fillIfEmpty", "", ""),
    ("category", "meta", "firstWriteWin", "", ""),
    ("aliases", "meta", "union", "", ""),
    ("definition", "text", "append", "", ""),
    ("notes", "text", "append", "", ""),
    ("ref", "meta", "immutable", "", ""),
    ("year", "meta", "fillIfEmpty", "", ""),
    ("status", "meta", "lastWriteWin", "", ""),
    ("relevance", "text", "append", "", ""),
    ("granularity", "meta", "immutable", "", ""),
    ("heading", "meta", "firstWriteWin", "", ""),
    ("period", "meta", "immutable", PREFIX + ":period", ""),
    ("role", "meta", "immutable", "", ""),
    ("merge", "meta", "immutable", "", ""),
    ("label", "meta", "firstWriteWin", "", ""),
    ("aligned", "meta", "firstWriteWin", "", ""),
    ("description", "text", "append", "", ""),
    ("required", "link", "union", "", "Requires"),
    ("optional", "link", "union", "", ""),
    ("subClassOf", "edge", "union", "rdfs:subClassOf", ""),
)
RELATIONS = ("broader", "narrower", "isPartOf", "hasPart", "requires", "replaces", "isReplacedBy", "conformsTo", "related", "referencedBy")
#: The seeded types, as name, merge policy, required and optional predicates, and bases.
SEED_TYPES = (
    ("Source", "immutable", ("title", "abstract", "mentions"), ("authors", "url", "cites", "doi", "indexed"), ("Node",)),
    ("Entity", "union", ("category", "definition", "mentionedIn"), ("aliases", "notes", "indexed", "mentions", *RELATIONS), ("Node",)),
    ("Resource", "firstWriteWin", ("ref", "relevance"), ("url", "isCitedBy", "authors", "year", "doi", "status", "notes", "indexed", "mentions", "mentionedIn", *RELATIONS), ("Node",)),
    ("Timeline", "append", ("granularity", "cites", "period"), ("heading", "indexed", "mentions", "mentionedIn"), ("Node",)),
    ("Node", "union", ("published", "created"), ("tags", "text", "updated", "scoreZ", "scoreC"), ()),
    ("Property", "union", ("role", "merge", "description"), ("label", "aligned"), ()),
    ("Class", "union", (), ("required", "optional", "description"), ()),
)


@dataclass(frozen=True)
class Predicate:
    name: str
    role: str
    merge: str
    label: str = ""
    aligned: str = ""
    description: str = ""


@dataclass(frozen=True)
class Type:
    name: str
    merge: str = ""
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    bases: tuple[str, ...] = ()
    description: str = ""


@dataclass
class Schema:
    """Predicates and types by name; small by nature, and held by the driver."""

    predicates: dict[str, Predicate] = field(default_factory=dict)
    types: dict[str, Type] = field(default_factory=dict)

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        rows = [(p.name, p.role, p.merge, p.label, p.aligned, p.description) for p in self.predicates.values()]
        kinds = [(t.name, t.merge, list(t.required), list(t.optional), list(t.bases), t.description) for t in self.types.values()]
        return spark.createDataFrame(rows, PREDICATES), spark.createDataFrame(kinds, TYPES)

    def check(self) -> None:
        """InvalidSchema for a bad role or policy, or a missing description."""
        for p in self.predicates.values():
            bad = "role" if p.role not in ROLES else "merge" if p.merge not in OPS else "description" if not p.description else ""
            if bad:
                raise InvalidSchema(f"predicate {p.name}: bad {bad}")
        for t in self.types.values():
            if not t.description:
                raise InvalidSchema(f"type {t.name}: bad description")

    def register_type(self, name: str) -> bool:
        """Add a type met for the first time; false if it is known."""
        if name in self.types:
            return False
        self.types[name] = Type(name, "union", description=f"Type {name}, met in a document.")
        return True

    def register_predicate(self, name: str, seen_as: str, label: str = "") -> bool:
        """Add a predicate met as a text, an edge, or an edge under a label; false if it is known."""
        if name in self.predicates:
            return False
        role = "text" if seen_as == "text" else "link" if label else "edge"
        self.predicates[name] = Predicate(name, role, "append" if role == "text" else "union", label, description=f"Predicate {name}, met in a document.")
        return True

    def merge_of(self, predicate: str) -> str:
        p = self.predicates.get(predicate)
        return p.merge if p else "union"

    def role_of(self, predicate: str) -> str:
        p = self.predicates.get(predicate)
        return p.role if p else ""

    def label_of(self, predicate: str) -> str:
        p = self.predicates.get(predicate)
        return p.label if p and p.label else predicate[:1].upper() + predicate[1:]

    def by_label(self) -> dict[str, str]:
        """Predicates by display label; of equal labels the least name counts."""
        out: dict[str, str] = {}
        for name in sorted(self.predicates):
            out.setdefault(self.label_of(name), name)
        return out


def seed() -> Schema:
    """The schema of a new graph."""
    out = Schema()
    for name, role, merge, aligned, label in SEED_PREDICATES:
        out.predicates[name] = Predicate(name, role, merge, label, aligned, f"The predicate {name}, of role {role}.")
    for name, merge, required, optional, bases in SEED_TYPES:
        out.types[name] = Type(name, merge, required, optional, bases, f"The type {name}.")
    return out


def effective(types: dict[str, Type]) -> dict[str, Type]:
    """Types with what they inherit; their own predicates first, required before optional.

    InvalidSchema for a cycle and for a base (the root included) that isn't there.
    """
    bases = {n: tuple(dict.fromkeys((*t.bases, *(() if n in EXEMPT else (ROOT,))))) for n, t in types.items()}
    for name, of in bases.items():
        for base in of:
            if base not in types:
                raise InvalidSchema(f"type {name}: no base {base}")
    try:
        order = list(TopologicalSorter(bases).static_order())
    except CycleError as e:
        raise InvalidSchema(f"types inherit from each other: {' '.join(e.args[1])}") from None
    out: dict[str, Type] = {}
    for name in order:
        line = [types[name], *(out[b] for b in bases[name])]
        required = tuple(dict.fromkeys(p for t in line for p in t.required))
        optional = tuple(p for p in dict.fromkeys(p for t in line for p in t.optional) if p not in required)
        out[name] = Type(name, types[name].merge, required, optional, types[name].bases, types[name].description)
    return out


def contract(spark: SparkSession, types: dict[str, Type]) -> DataFrame:
    """(type, predicate, required) of the effective types."""
    rows = [(t.name, p, True) for t in effective(types).values() for p in t.required] + [(t.name, p, False) for t in effective(types).values() for p in t.optional]
    return spark.createDataFrame(rows, "type string, predicate string, required boolean")


def _bases(types: DataFrame) -> DataFrame:
    """(name, base): what each type extends, the root included."""
    own = F.coalesce("bases", F.array().cast("array<string>"))
    root = F.when(F.col("name").isin(*EXEMPT), F.array().cast("array<string>")).otherwise(F.array(F.lit(ROOT)))
    return types.select("name", F.explode(F.array_distinct(F.concat(own, root))).alias("base"))


def closure(types: DataFrame) -> DataFrame:
    """(name, base): all that a type extends over any number of steps; a type in a cycle extends itself.

    Paths double in each round, so the rounds grow with the logarithm of the
    longest line of descent; each is a join, and its result is written once.
    """
    known = cut(_bases(types).distinct())
    n = known.count()
    while True:
        two = known.select("name", F.col("base").alias("mid")).join(known.select(F.col("name").alias("mid"), "base"), "mid").select("name", "base")
        known = cut(known.union(two).distinct())
        if (more := known.count()) == n:
            return known
        n = more


def problems(types: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(name, problem, detail) of a table of types: bases that aren't there, and types that extend themselves."""
    missing = _bases(types).join(types.select(F.col("name").alias("base")), "base", "left_anti")
    closed = closure(types) if closed is None else closed
    return missing.select("name", F.lit("no base").alias("problem"), F.col("base").alias("detail")).union(closed.where("name = base").select("name", F.lit("cycle"), "base"))


def contract_frame(types: DataFrame) -> DataFrame:
    """``contract`` of a table of types of any size; InvalidSchema that names the first types with a problem."""
    closed = closure(types)
    bad = problems(types, closed).orderBy("problem", "name").limit(5).collect()
    if bad:
        raise InvalidSchema("; ".join(f"type {r['name']}: {r['problem']} {r['detail']}" for r in bad))
    line = closed.union(types.select("name", "name"))
    held = line.join(types.select(F.col("name").alias("base"), "required", "optional"), "base")
    part = lambda c, r: held.select(F.col("name").alias("type"), F.explode(c).alias("predicate"), F.lit(r).alias("required"))
    return part("required", True).unionByName(part("optional", False)).groupBy("type", "predicate").agg(F.max("required").alias("required"))
