import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, component_id string, n_words string, row string, kept string, s string"


def awkward(n_long: int = 120_000) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(n_long // 6))
    near = [word() for _ in range(400)]
    other = near[:200] + ["changed"] + near[201:]
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, "two words"), (6, long), (7, "same text here, with a few words"), (8, "same text here, with a few words"),
        (9, "same text here, with a few words"), (9, "same text here, with a few words"), (None, "a row without an id"), (None, None), (10, "x" * 30_000), (11, "Ünï   İΣΑΣ ﬁ 12345 €"), (12, "<|endoftext|> and <|startoftext|>b"),
        (13, " ".join(near)), (14, " ".join(other)), (15, "\U0001f600\U0001f600 emoji ́ combining"), (16, "12 34 -- !!"), (17, "a\nb\na\nb\n\na"),
    ]
    return [(i, t, "en" if k % 2 else "de", None, None, 1, 2, "x", "y", "z", "k", "s") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
