"""The corpus pipeline: quality, near duplicates, copied passages, benchmark leaks, token ids.

All stages take rows with a null doc_id, null, empty and very long texts, ties,
repeated rows and empty tables, and return the columns that documents has (the
last one ids instead), whatever further columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, jaccard, passages, quality_model
from graphloom.llm.bitset import mark
from graphloom.llm.queries import WORD_BPE
from graphloom.llm.workspace import free_name, store, table


def _beside(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, list]:
    """The table with other names for the columns that an operator would replace, and the columns that give it back."""
    names, given = [], docs
    for name in docs.columns:
        names.append(free_name(given, f"_{name}") if name.lower() in made else name)
        if names[-1] != name:
            given = given.withColumnRenamed(name, names[-1])
    return given, [F.col(f"`{new}`").alias(old) for new, old in zip(names, docs.columns)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    The model is learnt from the whole table of documents; each row is scored by
    itself, null texts as the empty text, and stays as it is or goes.
    """
    model = quality_model.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    given, back = _beside(docs, ("score", "predicted"))
    return quality_model.score(given, model).where("predicted = 1").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of similar ones.

    Texts without words and rows with a null doc_id are in no group and stay;
    rows that share a doc_id are one document, and stay or go together.
    """
    found = jaccard.join(docs)
    others = store(found.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    may = free_name(docs, "_may")
    marked = mark(docs, others, may)
    return marked.where(~F.col(may)).drop(may).unionByName(marked.where(may).drop(may).join(others, "doc_id", "left_anti").select(*docs.columns))


def copied_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has.

    n_chars is counted anew for a text that was cut; a document of which no word
    is left goes; null and empty texts and rows with a null doc_id stay as they are.
    """
    return passages.remove(docs, passages.find(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; items without words are held by none;
    without items all rows stay.
    """
    given, back = _beside(docs, ("leaks",))
    return decontaminate.flag(given, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*back)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every row that is left; null and empty texts have no ids."""
    return bpe.encode(docs, WORD_BPE)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("copied_passages", copied_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: None: the quality model is learnt, and neither alignment nor merges are SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
