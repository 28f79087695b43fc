import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_tokens string, matches string"


def prose(rnd, n, size=400):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "the", "and", "of"]) + str(rnd.randrange(size)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rnd = random.Random(5)
    long = prose(rnd, 30_000)
    same = prose(rnd, 120)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x" * 70_000), (6, long), (7, same), (7, same), (8, same),
        (None, same), (None, None), (9, "Ünï çødé 日本語 \U0001d518 ends."), (10, "a\nb\n\nc\n"), (11, " " * 5000 + "end"),
        (12, same.upper()), (12, "another text of the same id"), (13, long + " tail"),
    ]
    return [(i, t, None if (i or 0) % 2 else "en", None, None if t is None else len(t), "s", "k", "n", "m") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def words(text, lower=False):
    import re

    if lower:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
