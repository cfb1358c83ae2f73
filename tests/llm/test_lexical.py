"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from graphloom.llm import lexical
from graphloom.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=10):
    """Rows (item, rank, doc, score) of docs and items as (id, text)."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, words = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for place, (i, c) in enumerate(found):
            m = 25 + 75 * sum(c.values()) * n_docs // max(words, 1)
            s = sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, place))
        out += [(item, k + 1, i if known else None, -s) for k, (s, known, i, _) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["key"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("whole", [True, False])
def test_search(spark, docs, texts, whole):
    r = random.Random(2)
    items = [(1, "w5x5 W6X6 the idiot"), (2, "ünï 漢字 漢字 three"), (3, None), (4, "..."), (5, "nowhere"), (6, " ".join(f"w{r.randrange(97)}x{r.randrange(89)}" for _ in range(300))), (6, "one"), (6, "one"), (None, "one two")]
    asked = spark.createDataFrame([(*x, 1) for x in items], f"{ITEMS}, score int")
    index = lexical.index(docs, None if whole else asked)
    assert rows(lexical.search(index, asked)) == plain(texts, items)
    assert rows(lexical.search(index, asked, top=2)) == plain(texts, items, 2)


def test_common_terms_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 7)
    monkeypatch.setattr(lexical, "COMMON_SHARE", 10)
    r = random.Random(4)
    words = [f"v{k}" for k in range(60)]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.choice([3, 20, 80])))) for i in range(150)]
    docs += [(1000 - i, "same words v3 v59") for i in range(60)]
    items = [(k, " ".join(r.choices(words, k=12))) for k in range(12)]
    index = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, ITEMS))
    assert index.terms.where("bucket = 0").count() > 5 and index.terms.where("bucket > 0").count() > 5
    assert rows(lexical.search(index, spark.createDataFrame(items, ITEMS))) == plain(docs, items)


def test_odd_tables(spark, docs, none):
    items = spark.createDataFrame([(1, "one")], ITEMS)
    assert lexical.search(lexical.index(none, items), items).count() == 0 and lexical.search(lexical.index(none), items).count() == 0
    assert lexical.search(lexical.index(docs, items.limit(0)), items.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = QUERIES["op13_lexical_search"](spark, folder).withColumnRenamed("doc_id", "key")
    assert rows(got) == plain(docs, items)
