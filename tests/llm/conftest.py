import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string"
WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "ra", "so", "tu") for b in ("n", "r", "la", "mi", "st", "vo")]


def prose(seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words))


def as_docs(spark, pairs):
    """Documents with extra columns whose names clash with those of the operators' results."""
    rows = [(i, t, "en", "src0", None if t is None else len(t), 9.5, 7, "k") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def odd_pairs():
    long = prose(1, 30_000)
    return [
        (1, prose(2)), (2, prose(2)), (3, None), (None, prose(3)), (None, None), (4, ""), (5, " \n\t "), (6, long),
        (7, prose(7)), (7, prose(7)), (7, prose(8)), (8, "日本語 😀 naïve ﬁn\u0000x"), (9, "a"), (10, "x" * 50_000), (11, prose(2) + " tail"),
    ]


@pytest.fixture
def odd(spark):
    return as_docs(spark, odd_pairs())


@pytest.fixture
def none(spark):
    return as_docs(spark, [])
