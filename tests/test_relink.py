"""Proposed links against a plain search."""

import random
import re
import string

from graphloom.operators import relink

AFTER = set("\t\n\f\r " + string.punctuation)


def plain(text, names, own):
    """Leftmost-longest mentions of (id, name), by trying all places."""
    text, out, at = text or "", [], 0
    spans = [m.span() for m in re.finditer(r"\[+[^\[\]]*\]+", text)]
    while at < len(text):
        best = 0
        for _, name in (x for x in names if x[0] != own):
            end = at + len(name)
            if name and text.startswith(name, at) and (not at or text[at - 1] in "\t\n\f\r ") and (end == len(text) or text[end] in AFTER) and not any(s < end and at < e for s, e in spans):
                best = max(best, end)
        if best:
            out.append((at, best, sorted(i for i, n in names if n == text[at:best] and i != own)))
        at = best or at + 1
    return out


def test_proposals(spark):
    r = random.Random(1)
    words = ["a", "coral", "reef", "warm", "sea", "ü", "漢字"]
    names = [("1", "coral"), ("2", "coral reef"), ("3", "coral reef"), ("4", "reef warm sea"), ("5", "ü 漢字"), ("6", ""), ("7", None), ("8", "a.b")]
    texts = [(str(i), "".join(r.choice(words) + r.choice([" ", " ", ", ", "\n", ".", "-"]) for _ in range(40))) for i in range(30)]
    texts += [("90", None), ("91", ""), ("92", "[[coral reef]] coral [coral] coral reef[x] a.b coral"), ("93", "coral"), ("1", "coral coral reef")]
    docs, known = spark.createDataFrame(texts, "id string, raw string").repartition(3), spark.createDataFrame(names, "id string, name string")
    usable = [(i, n) for i, n in names if n]
    want = sorted((i, *m) for i, t in texts for m in plain(t, usable, i))
    for size in (relink.BLOCK_BYTES, 20):  # one automaton and many
        found = relink.proposals(docs, known, size)
        assert sorted((x["id"], x["start"], x["end"], x["targets"]) for x in found.collect()) == want
    assert relink.proposals(docs, known.limit(0)).count() == 0 and relink.proposals(docs.limit(0), known).count() == 0


def test_nodes_of_one_name_are_joined_to_its_places(spark):
    names = spark.createDataFrame([(str(i), "coral reef") for i in range(300)] + [("n", "sea")], "id string, name string")
    docs = spark.createDataFrame([("7", "coral reef, coral reef sea"), ("x", "the coral reef")], "id string, raw string")
    found = relink.places(docs, names)
    assert sorted(tuple(r) for r in found.collect()) == [("7", 0, 10, "coral reef"), ("7", 12, 22, "coral reef"), ("7", 23, 26, "sea"), ("x", 4, 14, "coral reef")]
    assert relink.mentions(docs, names).count() == 2 * 299 + 1 + 300
    got = sorted(tuple(r) for r in relink.mentioned(docs, names).collect())
    assert got == sorted([("7", str(i)) for i in range(300) if i != 7] + [("7", "n")] + [("x", str(i)) for i in range(300)])


def test_documents_of_a_common_name_are_dealt_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(relink, "ROWS", 1000)
    names = spark.createDataFrame([(str(i), "coral reef") for i in range(100)] + [("n", "sea")], "id string, name string")
    docs = spark.createDataFrame([(f"d{i}", "a coral reef") for i in range(400)] + [("3", "coral reef"), ("s", "sea")], "id string, raw string")
    found = relink.mentioned(docs, names)
    assert found.count() == found.distinct().count() == 400 * 100 + 99 + 1
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 30_000
