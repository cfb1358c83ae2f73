"""The corpus pipeline: each stage against a plain version, the whole, odd rows and empty tables."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality_model

from .test_similarity import WORD, brute_components, fold, shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(17)
    passage, item = prose(rng, 70), prose(rng, 20)
    texts = [(i, prose(rng, rng.choice([40, 80, 150]))) for i in range(40)]
    texts += [(100 + i, t) for i, t in texts[:5]]  # copies
    texts += [(110 + i, t + " one more word") for i, t in texts[5:10] if len(t.split()) > 60]
    texts += [(120 + i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for i in range(3)]
    texts += [(130, f"{prose(rng, 90)} {item.upper()} {prose(rng, 30)}"), (131, item)]
    texts += [(140 + i, "| # | % | x " * 30) for i in range(30)]  # junk
    texts += [(200, None), (201, ""), (202, " \n"), (203, "one"), (None, prose(rng, 50)), (204, "word " * 3000), (205, texts[20][1]), (205, texts[20][1])]
    root = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in texts]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(not 140 <= i < 170), 0) for i, _ in texts if i is not None and i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 30)), (3, None)], "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    return root, texts, item, passage


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{folder[0]}/labels.parquet"))
    stats = quality_model.statistics(docs).select("doc_id", "text", "_stats.*").collect()
    want = sorted(((r[0], r[1]) for r in stats if model.score(np.array([r[2:]], float))[0] >= 0.3), key=str)
    kept = corpus_pipeline.quality(spark, docs, folder[0])
    assert rows_of(kept) == want and kept.columns == docs.columns
    assert not any(i is not None and 140 <= i < 170 for i, _ in want) and {i for i, _ in want} >= set(range(40))


def test_near_duplicates_stage(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    label = {i: c for i, (_, c) in brute_components([(i, t) for i, t in folder[1] if i is not None]).items()}
    want = sorted(((i, t) for i, t in folder[1] if i is None or label[i] == i), key=str)
    kept = corpus_pipeline.near_duplicates(spark, docs, folder[0])
    assert rows_of(kept) == want and sorted(kept.columns) == sorted(docs.columns) and len(want) < len(folder[1]) - 30


def test_copied_passages_stage(spark, folder):
    root, texts, _, passage = folder
    some = [(i, t) for i, t in texts if i is None or i < 100 or 120 <= i < 131 or i >= 200]
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in some], DOCS)
    kept = corpus_pipeline.copied_passages(spark, docs, root)
    assert sorted(kept.columns) == sorted(docs.columns)
    left = {r["doc_id"]: r for r in kept.collect()}
    for i, t in some:
        if i in (121, 122):
            w = WORD.findall(t)
            assert passage not in left[i]["text"] and left[i]["n_chars"] == len(left[i]["text"]) and len(w) - 76 <= len(WORD.findall(left[i]["text"])) <= len(w) - 70
        elif i == 205:
            assert i not in left  # the whole text stands in an earlier document
        elif i is not None:
            assert left[i]["text"] == t


def test_benchmark_leaks_stage(spark, folder):
    root, texts, item, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    sought = shingle_set(item)
    want = sorted(((i, t) for i, t in texts if 100 * len(sought & shingle_set(t)) < 80 * len(sought)), key=str)
    kept = corpus_pipeline.benchmark_leaks(spark, docs, root)
    assert rows_of(kept) == want and {i for i, _ in texts} - {i for i, _ in want} == {130, 131} and kept.columns == docs.columns and fold(item) == item


def test_token_ids_stage(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in folder[1]), key=str)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.token_ids(spark, docs, folder[0]).collect()), key=str) == want


def test_run_is_its_stages_one_after_the_other(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "copied_passages", "benchmark_leaks", "token_ids"]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder[0]).select("doc_id", "text", "lang", "source", "n_chars").collect(), DOCS)
    want = sorted(((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.token_ids(spark, docs, folder[0]).collect()), key=str)
    got = sorted(((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, folder[0]).collect()), key=str)
    assert got == want and {i for i, _ in got} >= set(range(5)) and not {100, 101, 130, 131, 140, 205} & {i for i, _ in got}


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_columns_whatever_their_names(spark, folder):
    from pyspark.sql import functions as F

    odd = ("_may", "score", "Predicted", "leaks", "_stats", "_word", "_bits", "_p", "seq", "part")
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for i, name in enumerate(odd):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs.drop(*odd), folder[0])
        kept = stage(spark, docs, folder[0])
        assert sorted(kept.columns) == sorted(docs.columns), name
        assert rows_of(kept) == rows_of(plain), name
        assert all(r[c] == f"{i} {'' if r['doc_id'] is None else r['doc_id']}" for r in kept.collect() for i, c in enumerate(odd)), name
    assert rows_of(kept)
