"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets, doubling from one
partition to the next.  For each partition, documents are read as windows of one
and a half times its greatest size, every half size, so that a passage of an
item lies within a window whatever the length of the document, and containment
of 0.8 means a similarity of a quarter with the window at least.  MINHASHES
bands of one row then miss such a passage with a probability below 0.75 to that
power (1e-5).  Items of at most FEW shingles are
looked up by their shingles instead, without any miss.  Every hit is verified by
exact containment of the item's shingles in the whole document.

One map over the documents, without a shuffle.  The items are broadcast in
blocks of ITEMS_AT_ONCE and ITEM_BYTES_AT_ONCE at most, with a pass over the
documents for each block, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

PERCENT = 80
MINHASHES = 40
SMALLEST = 8
FEW = 3
ITEMS_AT_ONCE = 50_000
ITEM_BYTES_AT_ONCE = 32 << 20

_FACTORS = tk.mix(np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


class Items:
    """MinHash index of some items, by size partition."""

    def __init__(self, ids: list, texts: list[str]):
        h, of = [], []
        for i, _, block in tk.blocks(pa.array(texts, pa.string())):
            a, b = block.shingle_sets()
            h.append(a)
            of.append(b + i)
        self.ids = ids
        self.h = np.concatenate(h) if h else np.empty(0, np.uint64)
        of = np.concatenate(of) if of else np.empty(0, np.int64)
        self.first = np.searchsorted(of, np.arange(len(ids) + 1))
        size = np.diff(self.first)
        top = np.maximum(SMALLEST, 2 ** np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        self.parts = []
        few = np.flatnonzero((size > 0) & (size <= FEW))
        keys = np.concatenate([np.empty(0, np.uint64), *(self.h[self.first[m] : self.first[m + 1]] for m in few)])
        owner = np.repeat(few, size[few])
        order = np.argsort(keys, kind="stable")
        self.few, self.few_keys = owner[order], keys[order]
        self.few_flags = np.zeros(1 << 16, bool)
        self.few_flags[keys >> np.uint64(48)] = True
        for most in np.unique(top[size > FEW]):
            members = np.flatnonzero((top == most) & (size > FEW))
            bands = []
            for factor in _FACTORS:
                least = np.array([(self.h[self.first[m] : self.first[m + 1]] * factor).min() for m in members])
                order = np.argsort(least)
                flags = np.zeros(1 << 16, bool)
                flags[least >> np.uint64(48)] = True
                bands.append((least[order], members[order], flags))
            self.parts.append((int(most), bands))

    def hits(self, block: tk.TextBlock, percent: int) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, of them in the text), by text and item."""
        h, text = block.all_shingles()
        if not len(h) or not (self.parts or len(self.few)):
            return []
        first = np.searchsorted(text, np.arange(block.n + 1))
        place = np.arange(len(h)) - first[text]
        found = set()
        if len(self.few):
            maybe = np.flatnonzero(self.few_flags[h >> np.uint64(48)])
            i, j = np.searchsorted(self.few_keys, h[maybe], "left"), np.searchsorted(self.few_keys, h[maybe], "right")
            for w, a, b in zip(maybe[j > i], i[j > i], j[j > i]):
                found.update((int(text[w]), int(m)) for m in self.few[a:b])
        grids = []
        for most, bands in self.parts:
            starts = np.flatnonzero(place % (most // 2) == 0)
            owner = text[starts]
            one, two = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
            one[:-1] = owner[1:] == owner[:-1]
            two[:-2] = owner[2:] == owner[:-2]
            grids.append((starts, owner, one, two, bands))
        for k, factor in enumerate(_FACTORS if grids else ()):
            g = h * factor
            for starts, owner, one, two, bands in grids:
                low = np.minimum.reduceat(g, starts)
                least = low.copy()
                least[:-1][one[:-1]] = np.minimum(low[:-1], low[1:])[one[:-1]]
                if len(low) > 2:
                    least[:-2][two[:-2]] = np.minimum(least[:-2], low[2:])[two[:-2]]
                keys, members, flags = bands[k]
                maybe = np.flatnonzero(flags[least >> np.uint64(48)])
                i, j = np.searchsorted(keys, least[maybe], "left"), np.searchsorted(keys, least[maybe], "right")
                for w, a, b in zip(maybe[j > i], i[j > i], j[j > i]):
                    found.update((int(owner[w]), int(m)) for m in members[a:b])
        out, last, own = [], -1, None
        for t, m in sorted(found):
            if t != last:
                last, own = t, np.unique(h[first[t] : first[t + 1]])
            item = self.h[self.first[m] : self.first[m + 1]]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[at] == item).sum())
            if 100 * shared >= percent * len(item):
                out.append((t, m, len(item), shared))
        return out


def flag(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The documents, each with ``leaks``: (item_id, n_item, n_shared) of every item found in it.

    Null and empty texts, and items without words, have no leaks; an item of
    fewer than five words is found where it is a document's whole word sequence;
    very long texts are searched whole; a column leaks is replaced; repeated items count as often as they come; all other columns and repeated
    rows stay as they are.  Without items nothing is found.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_text is not null")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    parts = max(1, math.ceil(2 * n / ITEMS_AT_ONCE), math.ceil(2 * size / ITEM_BYTES_AT_ONCE))
    shape = f"array<struct<item_id: {kind}, n_item: int, n_shared: int>>"
    out = docs.withColumn("leaks", F.array().cast(shape))
    for part in range(parts if n else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == part).collect()
        index = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))

        def run(rows, block, index=index):
            found = index.value
            hits = found.hits(block, percent)
            ends = np.searchsorted(np.array([t for t, *_ in hits], np.int64), np.arange(block.n + 1))
            at = rows.schema.get_field_index("leaks")
            kind = rows.schema.field("leaks").type
            old = rows.column(at).to_pylist()
            new = [old[t] + [{"item_id": found.ids[m], "n_item": n, "n_shared": k} for _, m, n, k in hits[ends[t] : ends[t + 1]]] for t in range(block.n)] if hits else old
            return rows.set_column(at, rows.schema.field(at), pa.array(new, kind))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
        out = tk.map_blocks(out, run, schema, text)
    return out
