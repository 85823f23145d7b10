from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, tie long, h string, doc long, salt string, features string, score double, cid long, n long, spans string"


def made_prose(n, seed, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows_of(texts):
    """(doc_id, text) pairs as rows with columns whose names clash with the operators' own."""
    return [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), 1, 2, "x", 3, "y", "z", 0.5, 4, 5, "w") for i, t in texts]


def edge_texts():
    one, long = made_prose(80, 1), made_prose(60000, 2)
    return [(1, one), (2, None), (3, ""), (4, " \t\n "), (5, one), (5, one), (6, one + " tail"), (7, long), (8, long[: len(long) // 2] + " x " + long[len(long) // 2 :]), (9, "Ünïcödé  ÄÖ ß ﬁ"), (None, "no id here at all"), (10, "word"), (11, one.upper()), (12, made_prose(300, 3))]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(edge_texts()), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def prose():
    return made_prose
