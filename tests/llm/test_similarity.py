import itertools
import random
import re

import numpy as np
import pytest

from graphloom.llm import decontaminate, jaccard, passages
from graphloom.llm import textkernel as tk
from graphloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared lines, passages and short texts."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    line = " ".join(rng.choices(vocab, k=13))
    passage = rng.choices(vocab, k=70)
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.5:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        elif kind < 0.6:
            w = rng.choices(vocab, k=60)
            w[20:20] = passage[: rng.choice([55, 70])]
            out.append(" ".join(w))
        else:
            out.append((line + "\n" if kind < 0.8 else "") + " ".join(rng.choices(vocab, k=rng.choice([2, 6, 40, 90, 200]))))
    return list(enumerate(out, 100))


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(spark):
    texts = corpus()
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    want = brute_components(texts)
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 10


def test_jaccard_join_of_odd_texts(docs, none):
    rows = jaccard.join(docs).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 16 and got[None] is None
    assert [got[i] for i in (1, 2, 10, 14)] == [1, 1, 1, 1] and all(got[i] == i for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, 13))
    assert jaccard.join(none).count() == 0


def test_jaccard_join_with_a_null_row_before_a_copy(spark):
    t = " ".join(f"n{i}" for i in range(100))
    rows = [(None, t), (5, t), (6, t + " tail"), (7, "other words than those of the rest")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {None: None, 5: 5, 6: 5, 7: 7}


def test_prefixes_keep_every_link():
    for n in range(1, 400):
        for m in range(-(-4 * n // 5), n + 1):
            both = -(-80 * (n + m) // 180)
            if both <= m:
                assert both >= jaccard.needed(np.array([n]), 80)[0]
                assert m - -(-160 * m // 180) + 1 >= m - both + 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 9), (5, 6), *((20, i) for i in range(21, 60)), *((i, i + 1) for i in range(100, 130))]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[9] == 1 and got[6] == 5 and got[59] == 20 and got[130] == 100 and len(got) == 6 + 40 + 31


def test_passages(spark):
    texts = corpus(5)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = passages.find(df).collect()
    words = {i: WORD.findall(fold(t)) for i, t in texts}
    seen, want = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 50):
            run = tuple(words[i][k : k + 51])
            if run in seen:
                want.setdefault(i, set()).update(range(k, k + 51))
        for k in range(len(words[i]) - 50):
            seen.setdefault(tuple(words[i][k : k + 51]), i)
    covered = {}
    for r in rows:
        assert r["ref_doc_id"] < r["doc_id"] and r["n_same"] >= 0.8 * r["n_words"] and r["n_words"] >= passages.MIN_WORDS
        a, b = words[r["doc_id"]][r["start"] : r["end"]], words[r["ref_doc_id"]][r["ref_start"] : r["ref_end"]]
        assert len(set(a) & set(b)) >= 0.7 * len(set(a))
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert want
    for i, places in want.items():
        assert len(places - covered.get(i, set())) <= 2, i
    left = {r["doc_id"]: r["text"] for r in passages.remove(df, passages.find(df)).collect()}
    for i, t in texts:
        if i not in covered:
            assert left[i] == t
        elif i in left:
            assert len(WORD.findall(left[i])) == len(words[i]) - len(covered[i])
        else:
            assert len(covered[i]) == len(words[i])


def test_passages_of_odd_texts(docs, none):
    found = passages.find(docs).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} == {(2, 1), (10, 1), (14, 1)} or {r["doc_id"] for r in found} == {2, 10, 14}
    kept = passages.remove(docs, passages.find(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 3, 4, 5, 9, 11, 12}
    assert passages.find(none).count() == 0 and passages.remove(none, passages.find(none)).count() == 0


def test_passages_whose_pieces_occur_earlier(spark):
    rng = random.Random(8)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    texts, whole = [], {}
    for k, pieces in enumerate([((0, 30), (30, 60)), ((0, 40), (20, 60)), ((0, 44), (16, 60), (8, 52)), ((0, 23), (15, 45))]):
        p = [f"p{k}x{i}" for i in range(60 if k < 3 else 45)]
        for n, (i, j) in enumerate(pieces):
            texts.append((100 * k + n, " ".join(fill(20) + p[i:j] + fill(20))))
        for n in (10, 11):
            texts.append((100 * k + n, " ".join(fill(25 + n) + p + fill(20))))
        whole[100 * k + 11] = (36, 36 + len(p))
    texts += [(900, "same " * 80), (901, "same " * 80)]  # seeds that are all equal
    found = passages.find(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    for i, (start, end) in whole.items():
        covered = {w for r in found if r["doc_id"] == i for w in range(r["start"], r["end"])}
        assert covered >= set(range(start, end)), i
    assert {r["doc_id"] for r in found} >= {11, 111, 211, 311, 901}
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} >= {(11, 10), (111, 110), (311, 310), (901, 900)}


@pytest.mark.parametrize("parts", [1, 4, 10])
def test_passages_however_rows_are_split(spark, parts):
    rng = random.Random(11)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    p = [f"p{i}" for i in range(112)]
    texts = [(k, " ".join(fill(20) + p[at : at + 28 + k] + fill(20))) for k, at in enumerate((0, 14, 28, 42, 56, 70, 84))]
    texts += [(100, " ".join(fill(9) + p + fill(20))), (101, " ".join(fill(30) + p + fill(5)))]
    rows = passages.find(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)).collect()
    covered = {w for r in rows if r["doc_id"] == 101 for w in range(r["start"], r["end"])}
    assert covered >= set(range(30, 142))
    assert not {r["doc_id"] for r in rows} & set(range(7))


def test_recall_of_changed_passages(spark):
    rng = random.Random(5)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    for share, size, least in ((0.15, 60, 0.9), (0.1, 60, 0.95), (0.2, 100, 0.9)):
        texts = []
        for k in range(60):
            p = fill(size)
            changed = list(p)
            for i in rng.sample(range(size), round(share * size)):
                changed[i] = f"z{rng.randrange(10**9)}"
            texts += [(k, " ".join(fill(30) + p + fill(30))), (1000 + k, " ".join(fill(25) + changed + fill(40)))]
        found = {(r["doc_id"], r["ref_doc_id"]) for r in passages.find(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
        assert found <= {(1000 + k, k) for k in range(60)} and len(found) >= least * 60, (share, size, len(found))


@pytest.mark.parametrize(("size", "share", "pieces"), [(45, 0.15, 0), (45, 0.2, 0), (50, 0.2, 0), (60, 0.2, 0), (100, 0.1, 3), (100, 0.15, 3)])
def test_recall_at_the_edge_and_with_earlier_pieces(spark, size, share, pieces):
    rng = random.Random(11)
    fill = lambda n: [f"f{rng.randrange(50_000)}" for _ in range(n)]
    texts = []
    for k in range(100):
        p = fill(size)
        changed = list(p)
        for i in rng.sample(range(size), round(share * size)):
            changed[i] = f"z{rng.randrange(10**9)}"
        for i in range(pieces):  # of 32 to 36 words, in documents before the source
            at = i * (size - 36) // (pieces - 1)
            texts.append((20 * k + i, " ".join(fill(50) + p[at : at + rng.randrange(32, 37)] + fill(50))))
        texts += [(20 * k + 10, " ".join(fill(60) + p + fill(60))), (20 * k + 12, " ".join(fill(80) + changed + fill(70)))]
    rng.shuffle(texts)
    found = {(r["doc_id"], r["ref_doc_id"]) for r in passages.find(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    assert sum((20 * k + 12, 20 * k + 10) in found for k in range(100)) >= 90
    assert all(a // 20 == b // 20 for a, b in found)


def test_long_gaps_are_aligned_like_short_ones():
    for gap in (62, 66, 400):
        a = np.arange(gap)
        b = np.concatenate([a[: gap // 2], [10**6], a[gap // 2 :]])
        assert passages._same_between(a, b) == gap and passages._same_between(b[::-1], a) >= 1


def brute_chain(d, r):
    order = sorted(range(len(d)), key=lambda i: (d[i], r[i]))
    best = {}
    for j in order:
        gains = [best[i] - passages.GAP * (d[j] - d[i] + r[j] - r[i]) for i in best if d[i] < d[j] and r[i] < r[j]]
        best[j] = passages.K + max([0.0, *gains])
    return max(best.values())


def test_chains_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 14))
        d, r = rng.integers(0, 40, n), rng.integers(0, 40, n)
        path = passages.chain(d, r)[0]
        score = float(passages.K)
        for i, j in zip(path, path[1:]):
            assert d[i] < d[j] and r[i] < r[j]
            score += passages.K - passages.GAP * float(d[j] - d[i] + r[j] - r[i])
        assert score == pytest.approx(brute_chain(d.tolist(), r.tolist()))


def test_decontamination(spark, docs, none):
    rng = random.Random(1)
    vocab = [f"q{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 8, 20, 45, 70])))) for i in range(40)] + [(99, None), (98, "")]
    texts = []
    for i in range(40):
        w = rng.choices(vocab, k=rng.choice([5, 300, 4000]))
        if i % 2 and len(items[i][1].split()) > 3:
            part = items[i][1].split()
            if i % 4 == 1:
                part[-1] = "changed"
            w[3:3] = part
        texts.append((i, " ".join(w)))
    texts.append((77, items[0][1].upper()))
    want = set()
    for (i, t), (k, x) in itertools.product(texts, items):
        item = shingle_set(x)
        if item and 100 * len(item & shingle_set(t)) >= 80 * len(item):
            want.add((i, k, len(item), len(item & shingle_set(t))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.flag(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    got = {(r["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for r in rows for x in r["leaks"]}
    assert got == want and len(want) > 8 and len(rows) == len(texts)
    odd = decontaminate.flag(docs, bench)
    assert odd.columns == [*docs.columns, "leaks"] and odd.where("size(leaks) > 0").count() == 0 and odd.count() == 16
    assert decontaminate.flag(docs, bench.limit(0)).count() == 16 and decontaminate.flag(none, bench).count() == 0


def test_words_are_those_of_the_pattern():
    for text in ["", " a\x0bb\x1cc  d\n", "Éé A\tb", "x" * 9, "\n\n"]:
        import pyarrow as pa

        _, _, block = next(tk.blocks(pa.array([text, "z"])))
        assert block.n_words.tolist() == [len(WORD.findall(text)), 1]
        assert [bytes(block.data[a:b]).decode() for a, b in zip(block.starts, block.ends)] == [*WORD.findall(text), "z"]


@pytest.mark.parametrize("name", ["op5_jaccard_join", "op8_decontamination"])
def test_sql(spark, name):
    import duckdb

    from graphloom.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, data)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


def test_a_group_of_near_copies_is_met_about_once_a_document(spark, monkeypatch):
    import random

    from graphloom.llm import jaccard as module

    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]

    def text():
        words = list(base)
        for i in r.sample(range(200), 2):
            words[i] = f"z{r.randrange(10**6)}"
        return " ".join(words)

    docs = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string").repartition(8, "doc_id")
    real, met = module._bounded, []
    monkeypatch.setattr(module, "_bounded", lambda pairs, *more: (met.append(pairs.count()), real(pairs, *more))[1])
    assert module.join(docs).select("component_id").distinct().count() == 1 and sum(met) < 2000


def test_a_repeated_pair_of_words_is_looked_up_at_few_places(spark, monkeypatch):
    texts = [(i, " ".join([f"h{i}x{k}" for k in range(7 * i)] + ["ping", "pong"] * 300 + [f"t{i}x{k}" for k in range(9)])) for i in range(6)]
    real, looked = passages._uncovered, []
    monkeypatch.setattr(passages, "_uncovered", lambda *x: (looked.append(real(*x).count()), real(*x))[1])
    rows = passages.find(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    for i in range(1, 6):
        assert {w for r in rows if r["doc_id"] == i for w in range(r["start"], r["end"])} == set(range(7 * i, 7 * i + 600))
    assert 0 < looked[0] < 6 * 100  # of 556 places in each text


def test_a_passage_whose_seeds_first_stand_in_many_other_documents(spark):
    rng = random.Random(21)
    fill = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    line, texts = fill(14), []
    for i in range(300):  # the line alone, before, between and after
        texts.append((10 * i, " ".join(fill(50) + line + fill(50))))
    pairs = []
    for k in range(20):
        before, after = fill(18), fill(22)
        a, b = 503 + 100 * k, 1503 + 61 * k
        changed = [fill(1)[0] if i % 4 == 0 else w for i, w in enumerate(before)], [fill(1)[0] if i % 5 == 1 else w for i, w in enumerate(after)]
        texts += [(min(a, b), " ".join(fill(30) + before + line + after + fill(40))), (max(a, b) + 1, " ".join(fill(35) + changed[0] + line + changed[1] + fill(20)))]
        pairs.append((max(a, b) + 1, min(a, b)))
    rng.shuffle(texts)
    rows = passages.find(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in rows} == set(pairs)
    assert all(r["n_same"] >= 0.8 * r["n_words"] and r["n_words"] >= passages.MIN_WORDS for r in rows)


def test_first_occurrence_with_enough_same_words_against_brute_force():
    r = np.random.default_rng(0)
    n = 700
    words = r.integers(8, 1 << 16, (n, 2 * passages.REACH), dtype=np.uint16)
    words[r.random(words.shape) < 0.8] = 7
    words[::9, 70:] = 0  # where a text ends
    words[::7, 20:40] = 0
    doc, none = r.permutation(n) // 2, np.zeros(n, np.int64)
    order = np.argsort(doc, kind="stable")

    def score(a, b):
        same = [-99 if 0 in (p, q) else int(p == q) for p, q in zip(a.tolist(), b.tolist())]
        return passages.K + max(sum(same[:x]) + sum(same[passages.REACH : 2 * passages.REACH - x]) for x in range(passages.REACH + 1))

    for after in (np.full(n, -1), doc // 2):
        got = passages._first_of(doc, words, (after, none), doc, none, words)
        want = [next((j for j in order.tolist() if after[i] < doc[j] < doc[i] and score(words[i], words[j]) >= 36), -1) for i in range(150)]
        assert [doc[j] if j >= 0 else -1 for j in got[:150]] == [doc[j] if j >= 0 else -1 for j in want] and any(j >= 0 for j in want) and any(j < 0 for j in want)


def test_occurrences_of_a_common_line_are_compared_by_groups_of_words(monkeypatch):
    r = np.random.default_rng(1)
    n, reach = 3000, passages.REACH
    words = r.integers(8, 1 << 16, (n, 2 * reach), dtype=np.uint16)
    words[:, [0, 1, 2, 3, *range(reach, reach + 4)]] = np.arange(2, 10)  # the line around the seed
    words[r.random(n) < 0.1, 60:] = 0  # where a text ends
    for i in range(1000, n, 10):  # copies with a fifth of the words changed, at most
        words[i] = words[i - 1000]
        words[i, r.choice([*range(4, reach), *range(reach + 4, 2 * reach)], r.integers(4, 22), replace=False)] = 1
    doc, none, of = np.arange(n) // 2, np.zeros(n, np.int64), np.arange(n) // 1500
    want = passages._first_of_all(doc, words, (none - 1, none), doc, np.arange(n), words)
    halves = [passages._first_of_all(doc[x], words[x], (none[x] - 1, none[x]), doc[x], np.arange(1500), words[x]) for x in (slice(1500), slice(1500, n))]
    own = np.concatenate([halves[0], np.where(halves[1] < 0, -1, halves[1] + 1500)])
    compared, whole = [], passages._first_of_all
    monkeypatch.setattr(passages, "_first_of_all", lambda *x: (compared.append(len(x[0]) * len(x[3])), whole(*x))[1])
    for size in (passages.ROWS_AT_ONCE, 700):
        monkeypatch.setattr(passages, "ROWS_AT_ONCE", size)
        assert (passages._first_of(doc, words, (none - 1, none), doc, np.arange(n), words) == want).all()
        assert (passages._first_of(doc, words, (none - 1, none), doc, np.arange(n), words, of, of) == own).all()
        assert size == 700 or not compared  # 4.5 million pairs before
    assert 20 < (want >= 0).sum() < 250


def test_a_row_is_sent_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(passages, "LIST", 10)
    places = spark.range(5000).selectExpr("id % 2 * (id % 50) as key", "id as doc", "0 as pos")
    blocks = {r["key"]: r["g"] for r in passages._blocks(places, "g").collect()}
    assert blocks[0] == passages.MOST_BLOCKS and blocks[1] == passages.MOST_BLOCKS and len(blocks) == 26


def test_shuffle_files_go_with_the_step_that_wrote_them(spark):
    import os
    import time

    from graphloom.llm.workspace import store

    files = lambda: sum(n.startswith("shuffle_") for p in folders for _, _, names in os.walk(p) for n in names)
    folders = list(spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    before = files()
    out = store(spark.range(1000).repartition(7, "id").groupBy("id").count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 1000
    assert store(out.repartition(3, "id"), "again").count() == 1000
