"""Ranked lexical search over term-bucketed postings.

A term is a maximal run of ASCII letters and digits and of characters beyond
ASCII, with A-Z lower-cased.  Postings are a table of (bucket, term, row,
key, tf, impact), made in one pass over the texts.  Terms that more than one document in
COMMON_SHARE holds are in bucket 0, whose rows stay as the documents lie, so
that a task which reads them adds up a document's matches before the shuffle;
all other terms are dealt by their hash, in slices of documents.

A search joins the items' terms by bucket and term, gives each match its integer
score, sums by item and document, and numbers each item's documents.  Items are
taken in blocks of TERMS_AT_ONCE terms, so what is broadcast has a bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .workspace import store

TOP = 10
BUCKETS = 15  # besides bucket 0
SLICES = 64
COMMON_SHARE = 200
TERMS_AT_ONCE = 500_000
WANTED_AT_ONCE = 2_000_000

_BETWEEN = np.zeros(256, bool)  # bytes that no term holds
_BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def count_terms(texts: DataFrame, wanted: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """The columns besides the text, with term, tf and n (terms of the text, repeats included).

    Each row gives the term '' once, which no text holds, so its n is known even
    if it has no term; then a row for each distinct term, or those whose
    fingerprints are wanted.  One pass, no shuffle; memory follows the longest text.
    """
    names = [c for c in texts.columns if c != text]
    kinds = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names), "term string", "tf bigint", "n bigint"])
    found = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def run(rows, block):
        block.between = _BETWEEN
        h, of, n = block.words, block.word_text, block.n_words
        place = np.arange(len(h))
        if found is not None:
            at = np.minimum(np.searchsorted(found.value, h), max(len(found.value) - 1, 0))
            place = np.flatnonzero(found.value[at] == h) if len(found.value) else place[:0]
        order = place[np.lexsort((h[place], of[place]))]
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
        heads = np.flatnonzero(new)
        tf = np.diff(np.append(heads, len(order)))
        first = order[heads]
        terms = pa.concat_arrays([pa.array([""] * block.n, pa.string()), block.spell(block.starts[first], block.ends[first])])
        owner = np.concatenate([np.arange(block.n), of[first]])
        columns = [rows.column(rows.schema.get_field_index(c)).take(pa.array(owner)) for c in names]
        tfs = np.concatenate([np.ones(block.n, np.int64), tf])
        return pa.RecordBatch.from_arrays([*columns, terms, pa.array(tfs), pa.array(n[owner].astype(np.int64))], names=[*names, "term", "tf", "n"])

    return tk.map_blocks(texts, run, kinds, text)


@dataclass
class Index:
    """Postings of a table of documents; ``documents`` is the number of those with a term."""

    postings: DataFrame  # bucket, term, row, key, tf, impact
    terms: DataFrame  # bucket, term, df
    documents: int


def index(docs: DataFrame, items: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Index:
    """Postings of every document, or only those of the items' terms; statistics cover all documents.

    Every row is a document of its own, whatever its key; null and empty texts
    have no terms and count in no statistic.
    """
    wanted = None
    if items is not None:
        own = count_terms(items.select(F.col(text).alias("text"))).where("term <> ''").select("term").distinct()
        some = own.limit(WANTED_AT_ONCE + 1).collect()
        if len(some) <= WANTED_AT_ONCE:  # else all terms are indexed
            wanted = np.unique(tk.hash_words([r[0] for r in some], fold=False)) if some else np.empty(0, np.uint64)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    raw = store(count_terms(texts, wanted), "terms")
    documents, length = raw.where("term = ''").agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    terms = raw.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    is_common = F.col("df") > max(1, documents // COMMON_SHARE)
    terms = store(terms.select(F.when(is_common, 0).otherwise(1 + F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int").alias("bucket"), "term", "df"), "frequencies")
    norm = f"(25 + (75 * n * {documents}L) div {max(length, 1)}L)"
    made = raw.where("term <> ''").withColumn("impact", F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {norm})")).select("term", "row", "key", "tf", "impact")
    common = F.broadcast(terms.where("bucket = 0").select("term").withColumn("bucket", F.lit(0)))  # few: each is held by one document in COMMON_SHARE
    placed = made.join(common, "term", "left")
    rare = placed.where("bucket is null").withColumn("bucket", (1 + F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int"))
    dealt = rare.repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(SLICES)))
    columns = ("bucket", "term", "row", "key", "tf", "impact")
    postings = store(placed.where("bucket = 0").select(*columns), "common").unionByName(store(dealt.select(*columns), "rare"))
    return Index(postings, terms, documents)


def search(found: Index, items: DataFrame, top: int = TOP, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, rank (1, 2, ...), key and score of each item's ``top`` best documents with a score above 0.

    Equal scores rank by ascending key (null first), then in the order of the
    table.  A row of items is an item of its own, repeated rows too; items
    without a term that some document holds give no rows.
    """
    asked = count_terms(items.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"), F.col(text).alias("text"))).where("term <> ''")
    weight = F.expr(f"tf * cast(floor(1000 * ln({2.0 * found.documents + 2} / (2 * df + 1))) as bigint)")
    own = store(asked.join(found.terms, "term").select("q", "item", "bucket", "term", weight.alias("weight")).where("weight > 0"), "asked")
    own_terms = own.select("q", "bucket", "term", "weight")
    buckets = [r[0] for r in own.select("bucket").distinct().collect()]
    postings = found.postings.where(F.col("bucket").isin(buckets))
    blocks = max(1, math.ceil(own.where("bucket = 0").count() / TERMS_AT_ONCE))
    matches = postings.where("bucket > 0").join(own_terms.where("bucket > 0"), ["bucket", "term"])
    for i in range(blocks):
        some = own_terms.where((F.col("bucket") == 0) & (F.pmod(F.xxhash64("q", "term"), F.lit(blocks)) == i))
        matches = matches.unionByName(postings.where("bucket = 0").join(F.broadcast(some), ["bucket", "term"]))
    scores = matches.groupBy("q", "row", "key").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")).where("score > 0")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("key").asc_nulls_first(), "row")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(own.select("q", "item").distinct(), "q").select(F.col("item").alias(item), "rank", "key", "score")
