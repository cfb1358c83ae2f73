"""Vector codes against a plain version."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import vector_codes
from graphloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks by whole loops; rows of (vec_id, vector)."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in sorted(kept)[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((dist(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        made = []
        for p in range(parts):
            groups = {}
            for _, v in kept:
                groups.setdefault(near(v, p)[1], []).append(cut(v, p))
            made.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = made
    out = {}
    for i, v in kept:
        found = [near(v, p) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors(n, seed, dims=32):
    r = random.Random(seed)
    rows = [(i, [r.choice([-0.5, -0.25, 0.0, 0.125, 0.25, 0.5]) + r.choice([0, r.random() / 8]) for _ in range(dims)]) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, None), (n + 2, [None] * dims), (n + 3, [float("nan")] * dims), (n + 4, [float("inf")] + [0.0] * (dims - 1)), (n + 5, [1.0] * (dims + 16)), (n + 6, [])]


@pytest.mark.parametrize(("n", "entries"), [(300, 64), (90, 7), (20, 64)])
def test_codes_against_loops(spark, n, entries):
    rows = vectors(n, n)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, i % 3 or None) for i, v in rows], SCHEMA).repartition(5).withColumn("code", F.lit("old"))
    books = vector_codes.fit(df, entries=entries)
    got = vector_codes.with_label_error(vector_codes.encode(df, books)).collect()
    want, digest = plain([x for x in rows if x[0] != n + 5 and x[1] != []], entries=entries)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and books.sha256() == digest and len(got) == n + 1
    sums = {}
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got)


def test_tree_keeps_lower_index_of_ties():
    r = np.random.default_rng(3)
    entries = r.integers(-3, 4, (64, 4))
    points = r.integers(-4, 5, (2000, 4))
    where, best = vector_codes.KdTree(entries).nearest(points)
    d = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (where == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    books = vector_codes.fit(none)
    assert vector_codes.with_label_error(vector_codes.encode(none, books)).count() == 0 and books.books[0].size == 0
    rows = [(None, [0.5] * 5, 1), (2, [3e38] * 5, 1), (2, [-1.0] * 5, None), (2, [-1.0] * 5, None)]  # no whole parts, great values, repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    books = vector_codes.fit(df, entries=2)
    got = vector_codes.encode(df, books).collect()
    assert len(got) == 4 and books.books[0].tolist() == [[-256], [-256]] or books.dims == 5
    with pytest.raises(ValueError):
        vector_codes.fit(df, entries=257)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want, digest = plain([(r["vec_id"], r["embedding"]) for r in rows])
    got = QUERIES["op11_vector_codes"](spark, "/root/testdata/sf0.001").collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {digest}
