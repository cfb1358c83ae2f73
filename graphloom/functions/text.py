"""String functions of the graph's text forms, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of links in list items and in prose.
LIST_LINK = r"^(?:(\w+)::\s*)?\[\[([^\]|]+)(?:\|([^\]]+))?\]\](?:\s.*)?$"
INLINE_LINK = r"\[(\w+)::\s*\[\[([^\]|]+)(?:\|([^\]]+))?\]\]\]|\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"


def slugify(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def camelize(c: Column) -> Column:
    """Words joined, the first starting in lower case and the others in upper case; other letters stay."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    first = lambda w, fn: F.concat(fn(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, first(w, F.lower)).otherwise(first(w, F.upper))), "")


def title_case(c: Column) -> Column:
    """The first character in upper case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def is_camel_case(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def list_link(line: Column) -> Column:
    """struct(predicate, target, alias) of a list item that is a link; null if it isn't one."""
    part = lambda i: F.regexp_extract(line, LIST_LINK, i)
    return F.when(line.rlike(LIST_LINK), F.struct(part(1).alias("predicate"), F.trim(part(2)).alias("target"), F.trim(part(3)).alias("alias")))


def inline_links(text: Column) -> Column:
    """array of struct(predicate, target, alias) of the links in prose, in order."""
    all_ = lambda i: F.regexp_extract_all(text, F.lit(INLINE_LINK), F.lit(i))
    return F.transform(
        F.arrays_zip(all_(1).alias("p"), all_(2).alias("a"), all_(3).alias("b"), all_(4).alias("c"), all_(5).alias("d")),
        lambda x: F.struct(x["p"].alias("predicate"), F.when(x["p"] != "", x["a"]).otherwise(x["c"]).alias("target"), F.when(x["p"] != "", x["b"]).otherwise(x["d"]).alias("alias")),
    )


def strip_links(text: Column) -> Column:
    """Prose with each link replaced by its alias, or its target without one."""
    # the alias's group takes part only if there is one, and a missing group is replaced by nothing
    with_alias = F.regexp_replace(text, r"\[(?:\w+)::\s*\[\[[^\]|]+\|([^\]]+)\]\]\]|\[\[[^\]|]+\|([^\]]+)\]\]", "$1$2")
    return F.regexp_replace(with_alias, r"\[(?:\w+)::\s*\[\[([^\]|]+)\]\]\]|\[\[([^\]|]+)\]\]", "$1$2")


def link_markup(predicate: Column, target: Column, alias: Column) -> Column:
    link = F.concat(F.lit("[["), target, F.when(F.coalesce(alias, F.lit("")) != "", F.concat(F.lit("|"), alias)).otherwise(""), F.lit("]]"))
    return F.concat(F.when(F.coalesce(predicate, F.lit("")) != "", F.concat(predicate, F.lit(":: "))).otherwise(""), link)


def node_folder(type_: Column) -> Column:
    """The folder of a type's documents."""
    fixed = {"Source": "sources", "Entity": "entities", "Resource": "resources"}
    out = F.when(F.endswith(type_, F.lit("s")), type_).otherwise(F.concat(type_, F.lit("s")))
    for name, folder in fixed.items():
        out = F.when(type_ == name, F.lit(folder)).otherwise(out)
    return out


def node_path(type_: Column, id_: Column) -> Column:
    return F.concat(node_folder(type_), F.lit("/"), id_, F.lit(".md"))


def referrer_path(type_: Column, id_: Column) -> Column:
    """Where a node's document is, periods of the timeline by their granularity."""
    period = F.when(id_.rlike(r"^\d{4}$"), "yearly").otherwise("monthly")
    return F.when(type_ == "Timeline", F.concat(F.lit("timeline/"), period, F.lit("/"), id_, F.lit(".md"))).otherwise(node_path(type_, id_))


def parse_date(c: Column) -> Column:
    """A timestamp of one of the three accepted layouts; null otherwise."""
    layouts = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$", None))
    out = F.lit(None).cast("timestamp")
    for shape, layout in layouts:
        made = F.try_to_timestamp(c, F.lit(layout)) if layout else F.try_to_timestamp(c)
        out = F.when(c.rlike(shape), made).otherwise(out)
    return out


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones."""
    trimmed = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, within lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n words; a shorter text is one run."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return let(words, lambda ws: F.array_distinct(runs(ws)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets held as arrays."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)))


def set_value(attrs: Column, key: str, value: Column) -> Column:
    """A map of lists with one value under a key, whatever the key had."""
    return F.map_concat(F.map_filter(attrs, lambda k, _: k != key), F.create_map(F.lit(key), F.array(value)))
