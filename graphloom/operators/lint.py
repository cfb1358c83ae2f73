"""Conformance checks: each rule is a plan that gives its violations.

A violation is (rule, id, path, detail).  Rules never stop each other; the
schema's tables are small by nature and their joins are left to the optimizer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .grep import lines

RULES = (
    "frontMatter",
    "uniqueBasename",
    "linkResolves",
    "sourceCitekey",
    "entityCategory",
    "derivedProvenance",
    "predicateCase",
    "predicateRegistered",
    "citationPredicate",
    "unrecognizedKind",
    "ingestCommit",
    "mergeConflict",
    "typeRequires",
    "typeOptional",
    "identityQuoting",
    "predicateRole",
    "typeCase",
)

#: The words of a category, by place.
CATEGORY = (
    ("independent", "relative", "mediating"),
    ("physical", "abstract"),
    ("continuant", "occurrent"),
    ("object", "process", "schema", "script", "juncture", "participation", "description", "history", "structure", "situation", "reason", "purpose"),
)
#: Name shapes and conflict lines.
PREDICATE_NAME, TYPE_NAME = r"^[a-z][a-zA-Z0-9]*\z", r"^[A-Z][a-zA-Z0-9]*\z"
CONFLICT_LINE = r"^<{7}|^={7}\z|^>{7}"


def basename(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.md\z", "")


def _out(df: DataFrame, rule: str, id_: str = "id", detail: Column | None = None) -> DataFrame:
    path = F.col("path") if "path" in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(rule).alias("rule"), F.col(id_).alias("id"), path.alias("path"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def front_matter(parsed: DataFrame) -> DataFrame:
    """Documents (path, id, err) that can't be read, or whose id isn't the basename."""
    bad = parsed.where(F.col("err").isNotNull() | (F.col("id") != basename(F.col("path"))))
    return _out(bad.withColumn("id", basename(F.col("path"))), "frontMatter", detail=F.coalesce("err", F.lit("id is not the basename")))


def unique_basename(paths: DataFrame) -> DataFrame:
    """Basenames on several paths."""
    groups = paths.select(basename(F.col("path")).alias("id"), "path").distinct().groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return _out(groups.where(F.size("paths") > 1), "uniqueBasename", detail=F.array_join("paths", ", "))


def link_resolves(links: DataFrame, basenames: DataFrame) -> DataFrame:
    """Distinct targets (src, dst) that are no basename (column id)."""
    missing = links.where("coalesce(dst, '') <> ''").select("src", "dst").distinct().join(basenames.select(F.col("id").alias("dst")), "dst", "left_anti")
    return _out(missing, "linkResolves", "src", F.col("dst"))


def source_citekey(nodes: DataFrame) -> DataFrame:
    return _out(nodes.where((F.col("type") == "Source") & (F.col("id") != basename(F.col("path")))), "sourceCitekey")


def category_error(words: Column) -> Column:
    """What is wrong with a category; null if nothing is."""
    out = F.when(words.isNull() | (F.size(words) != 4), F.concat(F.lit("four words wanted, found "), F.greatest(F.coalesce(F.size(words), F.lit(0)), F.lit(0))))
    for i, allowed in enumerate(CATEGORY):
        out = out.when(~F.coalesce(F.get(words, i).isin(*allowed), F.lit(False)), F.concat(F.lit(f"word {i + 1} is not allowed: "), F.coalesce(F.get(words, i), F.lit(""))))
    return out


def entity_category(nodes: DataFrame) -> DataFrame:
    """Entities (id, type, category array) with a bad category."""
    checked = nodes.where("type = 'Entity'").withColumn("_e", category_error(F.col("category")))
    return _out(checked.where("_e is not null"), "entityCategory", detail=F.col("_e"))


def derived_provenance(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes other than sources and timelines without a link to a source."""
    sources = nodes.where("type = 'Source'").select(F.col("id").alias("dst"))
    linked = links.select("src", "dst").join(sources, "dst", "left_semi").select(F.col("src").alias("id"))
    return _out(nodes.where(~F.col("type").isin("Source", "Timeline")).join(linked, "id", "left_anti"), "derivedProvenance")


def predicate_case(occurrences: DataFrame) -> DataFrame:
    bad = occurrences.select("id", "predicate").distinct().where(~F.col("predicate").rlike(PREDICATE_NAME))
    return _out(bad, "predicateCase", detail=F.col("predicate"))


def predicate_registered(occurrences: DataFrame, predicates: DataFrame) -> DataFrame:
    known = predicates.select(F.col("name").alias("predicate"))
    return _out(occurrences.select("id", "predicate").distinct().join(known, "predicate", "left_anti"), "predicateRegistered", detail=F.col("predicate"))


def citation_predicate(hrefs: DataFrame, predicates: DataFrame) -> DataFrame:
    """Tagged citations whose predicate isn't aligned with the citation vocabulary, each of them."""
    tagged = hrefs.where("coalesce(predicate, '') <> ''")
    known = predicates.select(F.col("name").alias("predicate"), "aligned")
    bad = tagged.join(known, "predicate", "left").where(~F.coalesce(F.col("aligned").startswith("cito:"), F.lit(False)))
    return _out(bad, "citationPredicate", "src", F.col("predicate"))


def unrecognized_kind(nodes: DataFrame, types: DataFrame) -> DataFrame:
    return _out(nodes.join(types.select(F.col("name").alias("type")), "type", "left_anti"), "unrecognizedKind", detail=F.col("type"))


def ingest_commit(nodes: DataFrame, commits: DataFrame) -> DataFrame:
    """Sources without exactly one commit (source_id) that brought them in."""
    counts = commits.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    found = nodes.where("type = 'Source'").join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _out(found.where("n <> 1"), "ingestCommit", detail=F.col("n"))


def merge_conflict(docs: DataFrame) -> DataFrame:
    """Documents (id, path, raw) with an open conflict, and its first line."""
    hits = lines(docs.where(F.col("raw").rlike(r"(?m)^(<{7}|={7}$|>{7})")).select("id", "path", "raw")).where(F.col("text").rlike(CONFLICT_LINE))
    return _out(hits.groupBy("id", "path").agg(F.min("line").alias("line")), "mergeConflict", detail=F.col("line"))


def type_requires(nodes: DataFrame, occurrences: DataFrame, contract: DataFrame) -> DataFrame:
    """Predicates that a node's type requires and the node lacks; contract is (type, predicate, required)."""
    wanted = nodes.select("id", "type").join(contract.where("required").select("type", "predicate"), "type")
    return _out(wanted.join(occurrences.select("id", "predicate").distinct(), ["id", "predicate"], "left_anti"), "typeRequires", detail=F.col("predicate"))


def type_optional(nodes: DataFrame, occurrences: DataFrame, contract: DataFrame, types: DataFrame) -> DataFrame:
    """Predicates of nodes of registered types that the type neither requires nor permits."""
    known = nodes.select("id", "type").join(types.select(F.col("name").alias("type")), "type", "left_semi")
    used = known.join(occurrences.select("id", "predicate").distinct(), "id")
    return _out(used.join(contract.select("type", "predicate").distinct(), ["type", "predicate"], "left_anti"), "typeOptional", detail=F.col("predicate"))


def identity_quoting(docs: DataFrame) -> DataFrame:
    """Documents with an identity key that isn't quoted."""
    hits = lines(docs.where(F.col("raw").rlike(r"(?m)^\s*@(id|type)\s*:")).select("id", "path", "raw")).where(F.trim("text").rlike(r"^@(id|type)\s*:"))
    return _out(hits, "identityQuoting", detail=F.concat_ws(" ", F.regexp_extract(F.trim("text"), r"^(@\w+)", 1), "line"))


def role_fits(role: Column, category: Column) -> Column:
    """Whether an occurrence's category (meta, text, edge, href) is what a role allows."""
    return F.when(category == "edge", role.isin("edge", "link")).otherwise(role == category)


def predicate_role(occurrences: DataFrame, predicates: DataFrame) -> DataFrame:
    """Occurrences (id, predicate, category) in another place than the schema says; citations are exempt."""
    known = predicates.select(F.col("name").alias("predicate"), "role")
    bad = occurrences.where("category <> 'href'").select("id", "predicate", "category").distinct().join(known, "predicate").where(~role_fits(F.col("role"), F.col("category")))
    return _out(bad, "predicateRole", detail=F.concat_ws(" ", "predicate", "category"))


def type_case(nodes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    bad = nodes.select("id", "type") if types is None else nodes.select("id", "type").unionByName(types.select(F.col("name").alias("id"), F.col("name").alias("type")))
    return _out(bad.where(~F.col("type").rlike(TYPE_NAME)), "typeCase", detail=F.col("type"))


def occurrences(nodes: DataFrame, attrs: DataFrame, texts: DataFrame, edges: DataFrame, hrefs: DataFrame) -> DataFrame:
    """(id, predicate, category) of every use of a predicate."""
    part = lambda df, id_, p, c: df.select(F.col(id_).alias("id"), p.alias("predicate"), F.lit(c).alias("category"))
    parts = [
        part(nodes.where("published is not null"), "id", F.lit("published"), "meta"),
        part(attrs, "id", F.col("key"), "meta"),
        part(texts, "id", F.col("key"), "text"),
        part(edges.where("coalesce(predicate, '') <> ''"), "src", F.col("predicate"), "edge"),
        part(hrefs.where("coalesce(predicate, '') <> ''"), "src", F.col("predicate"), "href"),
    ]
    return reduce(DataFrame.unionByName, parts)


def locate(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, line): the first line of each document that a pattern matches, 0 without one."""
    hits = lines(docs.select("id", "raw")).where(F.col("text").rlike(pattern)).groupBy("id").agg(F.min("line").alias("line"))
    return docs.select("id").join(hits, "id", "left").select("id", F.coalesce("line", F.lit(0)).alias("line"))


def located(violations: DataFrame, docs: DataFrame) -> DataFrame:
    """The violations with line: where in the document (id, raw) they show, 1 where nothing does.

    Sought are, in this order, what the rule is about: a link's target, a
    predicate before a link, a field, a group's title, and the detail itself.
    """
    d = F.coalesce(F.col("detail"), F.lit(""))
    title = F.concat(F.lit("**"), F.upper(F.substring(d, 1, 1)), d.substr(F.lit(2), F.length(d)), F.lit("**"))
    needles = [F.concat(F.lit("[["), d, F.lit("]]")), F.concat(F.lit("[["), d, F.lit("|")), F.concat(d, F.lit(":: ")), F.concat(d, F.lit(":")), title, d]
    by_rule = F.when(F.col("rule") == "mergeConflict", F.lit("<<<<<<<")).when(F.col("rule") == "entityCategory", F.lit("category:")).when(F.col("rule").isin("typeCase", "unrecognizedKind"), F.lit("@type")).when(F.col("rule").isin("sourceCitekey", "identityQuoting"), F.lit("@id"))
    at = lambda needle: F.when(~needle.contains("\n"), F.nullif(F.position(needle, F.col("_raw")), F.lit(0)))
    place = F.coalesce(F.when(by_rule.isNotNull(), at(by_rule)), F.when(d != "", F.coalesce(*map(at, needles))))
    before = F.substring(F.col("_raw"), F.lit(1), F.col("_place") - 1)
    line = F.coalesce(F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1, F.lit(1))
    text = docs.select("id", F.col("raw").alias("_raw"))
    return violations.join(text, "id", "left").withColumn("_place", place).withColumn("line", line.cast("int")).drop("_raw", "_place")


def lint(parsed: DataFrame, graph, predicates: DataFrame, types: DataFrame, contract: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """All violations of a graph, each with the line that it shows in.  ``parsed`` is (path, id, type, raw, err) of every document, readable or not.

    A document with an open conflict is checked for nothing else of its own; one
    that can't be read is only reported as such.  What several rules read is
    written once, without texts: else each rule would lay the documents out anew.
    """
    conflicts = cut(merge_conflict(parsed.withColumn("id", basename(F.col("path")))))
    clean = parsed.join(conflicts.select("path"), "path", "left_anti")
    nodes = cut(graph.nodes.join(conflicts.select("path"), "path", "left_anti").where(F.col("id") == basename(F.col("path"))).select("id", "type", "published", "path"))
    ids = nodes.select("id")
    own = lambda df, c, *more: cut(df.join(ids.withColumnRenamed("id", c), c, "left_semi").select(c, *more))
    attrs, texts = own(graph.attrs, "id", "key", "pos", "value_str"), own(graph.texts, "id", "key")
    edges, hrefs = own(graph.edges, "src", "predicate", "dst"), own(graph.hrefs, "src", "predicate", "dst")
    used = cut(occurrences(nodes, attrs, texts, edges, hrefs).distinct())
    links = hrefs.unionByName(edges)
    words = attrs.where("key = 'category'").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value_str"))), lambda x: x["value_str"]).alias("category"))
    found = [
        unique_basename(parsed), front_matter(clean), conflicts, identity_quoting(clean.withColumn("id", basename(F.col("path")))),
        link_resolves(links, parsed.select(basename(F.col("path")).alias("id"))), source_citekey(nodes), entity_category(nodes.join(words, "id", "left")),
        derived_provenance(nodes, links), predicate_case(used), predicate_registered(used, predicates), citation_predicate(hrefs, predicates),
        unrecognized_kind(nodes, types), type_requires(nodes, used, contract), type_optional(nodes, used, contract, types), predicate_role(used, predicates), type_case(nodes, types),
    ]
    if commits is not None:
        found.append(ingest_commit(nodes, commits))
    docs = parsed.groupBy(basename(F.col("path")).alias("id")).agg(F.max_by("raw", "path").alias("raw"))
    return located(reduce(DataFrame.unionByName, found), docs).orderBy(F.col("rule") != "uniqueBasename", "id", "rule", "detail")


def summary(parsed: DataFrame, violations: DataFrame) -> DataFrame:
    """(checked, passing, failing) documents."""
    bad = violations.where("rule <> 'uniqueBasename'").select("id").distinct()
    names = parsed.select(basename(F.col("path")).alias("id")).join(bad.withColumn("_bad", F.lit(1)), "id", "left")
    return names.agg(F.count("*").alias("checked"), F.count_if(F.col("_bad").isNull()).alias("passing"), F.count_if(F.col("_bad").isNotNull()).alias("failing"))
