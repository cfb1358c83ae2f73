import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts that every operator must bear, as (doc_id, text)."""
    prose = " ".join(f"w{i % 97}x{i % 89}" for i in range(400))
    return [
        (1, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "ONE two\nthree four"), (8, "ünï ☃ 漢字 \U0001f600 x\x00y"),
        (9, "the " * 3000), (10, prose.upper()), (11, "a" * 50_000), (12, "same line here\n" * 40), (13, "idiot you are <|endoftext|> İΣ"), (None, prose), (14, prose + " tail words that differ a bit"),
        (14, prose),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those texts with columns whose names clash with those of the operators."""
    rows = [(i, t, "en", "s", 0 if t is None else len(t), 1.5, "x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, label string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
