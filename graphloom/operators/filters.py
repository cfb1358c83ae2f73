"""Node filters as column predicates.

Attributes are a map column ``attrs`` of arrays of strings (their canonical
strings); a filter is a conjunction of four groups, and an empty one matches all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import to_jvm


@dataclass(frozen=True)
class Filter:
    """Types (any of), tags (all of), attribute values and attribute patterns (all of)."""

    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    attrs: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_options(cls, types=(), tags=(), attrs=()) -> Filter:
        """From command options; of ``key~=pattern`` and ``key=value`` the last of a key counts."""
        values, patterns = {}, {}
        for option in attrs:
            sign = "~=" if "~=" in option else "="
            key, found, value = option.partition(sign)
            if not found or not key:
                raise ValueError(f"neither key=value nor key~=pattern: {option}")
            (patterns if sign == "~=" else values)[key] = value
        return cls(tuple(types), tuple(tags), values, patterns)

    @classmethod
    def from_json(cls, spec: dict | None) -> Filter:
        """From a tool call's object."""
        spec = spec or {}
        type_ = spec.get("type") or ()
        return cls((type_,) if isinstance(type_, str) else tuple(type_), tuple(spec.get("tags") or ()), dict(spec.get("attrs") or {}), dict(spec.get("attrPatterns") or {}))

    def column(self, type_: Column | None = None, attrs: Column | None = None) -> Column:
        """The predicate; never null."""
        type_ = F.col("type") if type_ is None else type_
        attrs = F.col("attrs") if attrs is None else attrs
        parts = [type_.isin(*self.types)] if self.types else []
        parts += [has_value(attrs, "tags", t) for t in self.tags]
        parts += [has_value(attrs, k, v) for k, v in sorted(self.attrs.items())]
        parts += [has_pattern(attrs, k, p) for k, p in sorted(self.patterns.items())]
        return reduce(and_, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(True))


def has_value(attrs: Column, key: str, value: str) -> Column:
    """Whether any element of an attribute equals a value, case aside; false without the key, nulls skipped."""
    return F.coalesce(F.exists(attrs[key], lambda v: F.coalesce(F.lower(v) == value.lower(), F.lit(False))), F.lit(False))


def has_pattern(attrs: Column, key: str, pattern: str) -> Column:
    """Whether a pattern is found in any element of an attribute."""
    made = to_jvm(pattern)
    return F.coalesce(F.exists(attrs[key], lambda v: F.coalesce(v.rlike(made), F.lit(False))), F.lit(False))


def with_attrs(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """Nodes with the map column that filters read; ``published`` can be filtered as a date string."""
    lists = attrs.where("value_str is not null").groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("pos", "value_str"))).alias("v"))
    maps = lists.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("v.value_str")))).alias("attrs"))
    date = F.when(F.col("published").isNotNull(), F.create_map(F.lit("published"), F.array(F.date_format("published", "yyyy-MM-dd"))))
    empty = F.create_map().cast("map<string,array<string>>")
    own = F.map_filter(F.coalesce("attrs", empty), lambda k, _: k != "published")
    return nodes.join(maps, "id", "left").withColumn("attrs", F.map_concat(own, F.coalesce(date, empty)))


def matching(nodes: DataFrame, attrs: DataFrame, filter_: Filter) -> DataFrame:
    """Nodes with ``matches``, from attributes in their long form.

    One partial aggregation over the rows of the keys that the filter names, so
    a node with any number of attributes never has them gathered.
    """
    of_type = F.coalesce(F.col("type").isin(*filter_.types), F.lit(False)) if filter_.types else F.lit(True)
    value = F.col("value_str")
    wanted = [("tags", F.lower(value) == t.lower()) for t in filter_.tags]
    wanted += [(k, F.lower(value) == v.lower()) for k, v in sorted(filter_.attrs.items())]
    wanted += [(k, value.rlike(to_jvm(p))) for k, p in sorted(filter_.patterns.items())]
    if not wanted:
        return nodes.withColumn("matches", of_type)
    keys = sorted({k for k, _ in wanted})
    rows = attrs.where(F.col("key").isin(*keys)).select("id", "key", "value_str")
    if "published" in keys:
        dates = nodes.where("published is not null").select("id", F.lit("published").alias("key"), F.date_format("published", "yyyy-MM-dd").alias("value_str"))
        rows = rows.where("key <> 'published'").unionByName(dates)
    found = rows.groupBy("id").agg(*(F.bool_or(F.coalesce((F.col("key") == k) & c, F.lit(False))).alias(f"_m{i}") for i, (k, c) in enumerate(wanted)))
    every = reduce(and_, (F.col(f"_m{i}") for i in range(len(wanted))))
    hits = found.where(every).select("id", F.lit(True).alias("_hit"))
    return nodes.join(hits, "id", "left").withColumn("matches", of_type & F.coalesce("_hit", F.lit(False))).drop("_hit")


def is_stub(nodes: DataFrame, *tables: DataFrame) -> DataFrame:
    """Nodes of which no table (keyed by id or src) has a row."""
    out = nodes
    for t in tables:
        key = "id" if "id" in t.columns else "src"
        out = out.join(t.select(F.col(key).alias("id")), "id", "left_anti")
    return out
