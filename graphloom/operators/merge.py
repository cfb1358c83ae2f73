"""The merge algebra: contributions to one predicate of one node, in arrival order.

Contributions are rows (id, key, seq, source, value) with seq unique within a
key.  Policies that keep the first or last value are partial aggregations;
list policies deduplicate before they gather; the flagging ones gather changes of
value and write their nested markers in one go.  Prose that many documents add
to is merged paragraph by paragraph, in rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, let, paragraphs, word_shingles
from ..session import cut

FREEZE = ("immutable", "validatedOverwrite")
FLAG = ("firstWriteWin", "fillIfEmpty")
OVERWRITE = ("lastWriteWin",)
LIST = ("union", "append")
OPS = FREEZE + FLAG + OVERWRITE + LIST

SIMILARITY = 0.8  # a paragraph more similar than this is there already
SHINGLE_WORDS = 3

#: The conflict marker's lines.
OPEN, MIDDLE, CLOSE = "<<<<<<< existing\n", "\n=======\n", "\n>>>>>>> "


def marker(existing: Column, incoming: Column, source: Column) -> Column:
    """Both values of a conflict, in one."""
    return F.concat(F.lit(OPEN), existing, F.lit(MIDDLE), incoming, F.lit(CLOSE), source)


def is_marker(value: Column) -> Column:
    return value.startswith(OPEN) & value.contains(MIDDLE) & value.contains(CLOSE)


def marker_incoming(value: Column) -> Column:
    """The incoming side of a marker: what stands after its last divider."""
    tail = F.element_at(F.split(value, "\n=======\n", -1), -1)
    return F.substring_index(tail, CLOSE, 1)


def marker_existing(value: Column) -> Column:
    """The existing side of a marker."""
    inner = value.substr(F.lit(len(OPEN) + 1), F.length(value))
    return F.regexp_extract(inner, r"(?s)\A(.*)\n=======\n", 1)


def fold_flagging(contributions: Column) -> Column:
    """Fold of an ordered array of struct(value, source): the first value, or nested markers of what differed later.

    A value equal to the state, or to the incoming side of its outermost
    marker, changes nothing; an empty value neither.
    """

    def step(state: Column, c: Column) -> Column:
        value = F.coalesce(c["value"], F.lit(""))
        same = (value == "") | (value == state) | (is_marker(state) & (marker_incoming(state) == value))
        return F.when(same, state).when(state == "", value).otherwise(marker(state, value, c["source"]))

    return F.aggregate(contributions, F.lit(""), step)


def flagged(c: Column) -> Column:
    """fold_flagging of an ordered array of struct(value, source) without two equal values in a row.

    Unless a value or source holds a part of a marker, every change opens one
    more marker around what is there, so the result is written in one go and
    its cost is its length.
    """
    plain = ~F.exists(c, lambda x: F.concat_ws("\n", x["value"], x["source"]).rlike(r"<<<<<<< existing|\n=======\n|\n>>>>>>> "))
    parts = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x: F.concat(F.lit(MIDDLE), x["value"], F.lit(CLOSE), x["source"]))
    nested = F.concat(F.repeat(F.lit(OPEN), F.size(c) - 1), c[0]["value"], F.array_join(parts, ""))
    return F.when(plain, nested).otherwise(fold_flagging(c))


def changes(contributions: DataFrame, value: Column) -> DataFrame:
    """(id, key, c): the contributions whose value isn't that of the one before, as an array by seq."""
    w = Window.partitionBy("id", "key").orderBy("seq")
    rows = contributions.withColumn("_v", value).withColumn("_was", F.lag("_v").over(w)).where("_was is null or _was <> _v")
    extra = [c for c in ("list",) if c in contributions.columns]
    return rows.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("_v").alias("value"), F.coalesce("source", F.lit("")).alias("source"), *extra))).alias("c"))


def merge_scalars(contributions: DataFrame, op: str) -> DataFrame:
    """(id, key, value, conflict) of scalar contributions under one policy; empty values never win."""
    by = contributions.withColumn("value", F.nullif(F.col("value"), F.lit(""))).groupBy("id", "key")
    if op in FREEZE:
        return by.agg(F.coalesce(F.expr("min_by(value, seq) filter (where value is not null)"), F.lit("")).alias("value"), F.lit(False).alias("conflict"))
    if op in OVERWRITE:
        return by.agg(F.coalesce(F.expr("max_by(value, seq) filter (where value is not null)"), F.lit("")).alias("value"), F.lit(False).alias("conflict"))
    if op in FLAG:
        rows = changes(contributions.where("coalesce(value, '') <> ''"), F.col("value"))
        return rows.select("id", "key", flagged(F.col("c")).alias("value")).withColumn("conflict", is_marker(F.col("value")))
    raise ValueError(f"not a scalar policy: {op}")


def merge_lists(contributions: DataFrame) -> DataFrame:
    """(id, key, values): the distinct values in order of their first arrival."""
    first = contributions.where("value is not null").groupBy("id", "key", "value").agg(F.min("seq").alias("seq"))
    return first.groupBy("id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("values"))


def union_links(links: DataFrame, order: tuple[str, ...] = ("seq", "pos")) -> DataFrame:
    """Links with the first alias of each (src, predicate, dst)."""
    return links.groupBy("src", "predicate", "dst").agg(F.min_by("alias", F.struct(*order)).alias("alias"))


def merge_paragraphs(existing: Column, incoming: Column, similarity: float = SIMILARITY, split=paragraphs, joint: str = "\n\n") -> Column:
    """Text with the incoming paragraphs that aren't near any existing one; empty existing text takes the incoming one as it is."""
    with_shingles = lambda text: F.transform(split(text), lambda p: F.struct(p.alias("p"), word_shingles(p, SHINGLE_WORDS).alias("s")))
    near = lambda p, old: F.exists(old, lambda o: jaccard(o["s"], p["s"]) > similarity)
    kept = lambda old: F.concat(old, F.filter(with_shingles(incoming), lambda p: ~near(p, old)))
    both = let(with_shingles(existing), lambda old: F.array_join(F.transform(kept(old), lambda x: x["p"]), joint))
    empty = F.coalesce(F.trim(existing), F.lit("")) == ""
    return F.when(empty, F.coalesce(incoming, F.lit(""))).when(F.coalesce(F.trim(incoming), F.lit("")) == "", existing).otherwise(both)


def near_paragraphs(items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, key, a, b): pairs of paragraphs of one text more similar than that, b from a later contribution.

    ``items`` has id, key, item, seq and s, the distinct runs of words.  Two such sets
    share one of their rarest runs: with n runs, the first n - ceil(similarity * n) + 1
    by how many paragraphs of the text have them.
    """
    runs = items.select("id", "key", "item", "seq", F.size("s").alias("n"), F.explode("s").alias("run"))
    often = runs.groupBy("id", "key", "run").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("id", "key", "item").orderBy("often", "run"))
    prefix = runs.join(often, ["id", "key", "run"]).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n")) + 1).where("often > 1")
    side = lambda x: prefix.select("id", "key", "run", *(F.col(c).alias(f"{c}_{x}") for c in ("item", "seq", "n")))
    sized = (F.col("n_a") >= similarity * F.col("n_b")) & (F.col("n_b") >= similarity * F.col("n_a"))
    pairs = side("a").join(side("b"), ["id", "key", "run"]).where((F.col("seq_a") < F.col("seq_b")) & sized).select("id", "key", "item_a", "item_b").distinct()
    sets = lambda x: items.select("id", "key", F.col("item").alias(f"item_{x}"), F.col("s").alias(f"s_{x}"))
    both = pairs.join(sets("a"), ["id", "key", "item_a"]).join(sets("b"), ["id", "key", "item_b"])
    return both.where(jaccard(F.col("s_a"), F.col("s_b")) > similarity).select("id", "key", F.col("item_a").alias("a"), F.col("item_b").alias("b"))


def merge_paragraph_rows(contributions: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, key, value, seq): merge_paragraphs over any number of contributions to each text, and the seq of the last that changed it.

    A paragraph stays unless it is near one that stays and came in an earlier
    contribution.  Equal paragraphs are one item; items that nothing earlier is
    near stay, those near an item that stays go, and so on in rounds until all
    are settled.  No text's paragraphs are compared in one row: what is gathered
    is the result alone.
    """
    given = contributions.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    heads = given.groupBy("id", "key").agg(F.count("*").alias("n"), F.min_by("value", "seq").alias("raw"), F.min("seq").alias("first"))
    parts = given.select("id", "key", "seq", F.posexplode(paragraphs(F.col("value"))).alias("pos", "p"))
    parts = cut(parts.withColumn("s", F.array_sort(word_shingles(F.col("p"), SHINGLE_WORDS))).withColumn("item", F.sha2(F.to_json("s"), 256)))
    items = cut(parts.groupBy("id", "key", "item").agg(F.min("seq").alias("seq"), F.any_value("s").alias("s")))
    links = cut(near_paragraphs(items, similarity))
    gone, left = None, links
    while not left.isEmpty():
        later = left.select("id", "key", F.col("b").alias("item")).distinct()
        stay = left.select("id", "key", F.col("a").alias("item")).distinct().join(later, ["id", "key", "item"], "left_anti")  # nothing that is left is before them
        more = cut(left.join(stay.withColumnRenamed("item", "a"), ["id", "key", "a"], "left_semi").select("id", "key", F.col("b").alias("item")).distinct())
        gone = more if gone is None else gone.unionByName(more)
        for side in ("a", "b"):
            left = left.join(more.withColumnRenamed("item", side), ["id", "key", side], "left_anti")
        left = cut(left.join(stay.withColumnRenamed("item", "a"), ["id", "key", "a"], "left_anti"))
    kept = items if gone is None else items.join(gone, ["id", "key", "item"], "left_anti")
    rows = parts.join(kept.select("id", "key", "item", "seq"), ["id", "key", "item", "seq"], "left_semi")
    joined = rows.groupBy("id", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "pos", "p"))), lambda x: x["p"]), "\n\n").alias("value"), F.max("seq").alias("seq"))
    second = given.join(heads.select("id", "key", "first"), ["id", "key"]).where("seq > first").groupBy("id", "key").agg(F.min("seq").alias("second"))
    out = heads.join(joined, ["id", "key"], "left").join(second, ["id", "key"], "left")
    tidied = F.array_join(paragraphs(F.col("raw")), "\n\n") != F.col("raw")  # the second contribution sets the paragraphs apart evenly
    value = F.when(F.col("n") == 1, F.col("raw")).otherwise(F.coalesce("value", F.lit("")))
    return out.select("id", "key", value.alias("value"), F.greatest(F.coalesce("seq", "first"), F.when(tidied, F.col("second"))).alias("seq"))


def merge_text(op: Column | str, existing: Column, incoming: Column, source: Column) -> Column:
    """One text under its policy, given as a name or a column of names."""
    op = F.lit(op) if isinstance(op, str) else op
    pair = F.array(F.struct(F.coalesce(existing, F.lit("")).alias("value"), F.lit("").alias("source")), F.struct(F.coalesce(incoming, F.lit("")).alias("value"), source.alias("source")))
    fill = F.when(F.coalesce(existing, F.lit("")) == "", incoming).otherwise(existing)
    return F.when(op.isin(*FREEZE), fill).when(op.isin(*FLAG), fold_flagging(pair)).when(op.isin(*OVERWRITE), F.when(F.coalesce(incoming, F.lit("")) == "", existing).otherwise(incoming)).otherwise(merge_paragraphs(existing, incoming))


def merge_values(op: Column | str, existing: Column, incoming: Column, source: Column) -> Column:
    """One attribute, an array of strings, under its policy."""
    op = F.lit(op) if isinstance(op, str) else op
    none = F.array().cast("array<string>")
    e, i = F.coalesce(existing, none), F.coalesce(incoming, none)
    empty = lambda a: F.array_join(a, "") == ""
    union = F.array_distinct(F.concat(e, i))
    show = lambda a: F.array_join(a, ", ")
    pair = F.array(F.struct(show(e).alias("value"), F.lit("").alias("source")), F.struct(show(i).alias("value"), source.alias("source")))
    flagged = F.when(empty(e), i).when(empty(i) | (e == i), e).otherwise(F.array(fold_flagging(pair)))
    return F.when(op.isin(*FREEZE), F.when(empty(e), i).otherwise(e)).when(op.isin(*FLAG), flagged).when(op.isin(*OVERWRITE), F.when(empty(i), e).otherwise(i)).otherwise(union)


def outcome(op: Column | str, existing: Column, incoming: Column, merged: Column) -> Column:
    """created, unchanged, filled, overwritten, appended or flagged; existing is null where the key was absent."""
    op = F.lit(op) if isinstance(op, str) else op
    text = lambda c: c.cast("string")
    flagged = op.isin(*FLAG) & text(merged).contains(OPEN)
    return (
        F.when(existing.isNull(), "created")
        .when(incoming.isNull(), "unchanged")
        .when(flagged, "flagged")
        .when(merged == existing, "unchanged")
        .when(op.isin(*FREEZE, *FLAG), "filled")
        .when(op.isin(*OVERWRITE), "overwritten")
        .otherwise("appended")
    )


def merge_labels(existing: Column, incoming: Column) -> Column:
    """Maps of labels by predicate: what comes in overrides."""
    none = F.create_map().cast("map<string,string>")
    e, i = F.coalesce(existing, none), F.coalesce(incoming, none)
    return F.map_concat(F.map_filter(e, lambda k, _: ~F.map_contains_key(i, k)), i)


def merge_attrs(existing: DataFrame, incoming: DataFrame, ops: DataFrame, source: Column) -> DataFrame:
    """(id, key, values, outcome) of two tables of attributes (id, key, values), each key under its policy (key, op; union without one).

    A key that only comes in is created, one that doesn't come in is unchanged.
    """
    both = existing.withColumnRenamed("values", "_e").join(incoming.withColumnRenamed("values", "_i"), ["id", "key"], "full_outer").join(ops, "key", "left")
    op = F.coalesce("op", F.lit("union"))
    merged = F.when(F.col("_i").isNull(), F.col("_e")).when(F.col("_e").isNull(), F.col("_i")).otherwise(merge_values(op, F.col("_e"), F.col("_i"), source))
    return both.select("id", "key", merged.alias("values"), outcome(op, F.col("_e"), F.col("_i"), merged).alias("outcome"))
