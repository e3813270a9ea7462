import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("score", T.StringType()), T.StructField("key", T.StringType()), T.StructField("ids", T.StringType())])


def sentence(rnd, n, words=400):
    return " ".join(f"w{rnd.randint(0, words)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows, ties and clashing columns."""
    rnd = random.Random(5)
    passage = sentence(rnd, 70)
    base = sentence(rnd, 120).split()
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, "one two", "en", "s", 7),
        (5, " ".join(base), "en", "s", 1), (6, " ".join(near), "en", "s", 1), (7, " ".join(base), "de", "s", 1),
        (7, " ".join(base), "de", "s", 1), (8, sentence(rnd, 30) + " " + passage + " " + sentence(rnd, 30), "de", "t", 1),
        (9, passage, "de", "t", 1), (None, "no number here but words enough", "en", None, 1),
        (10, sentence(rnd, 60_000, 9000), "en", "s", 1), (11, "x" * 5000, "en", "s", 5000), (12, "Sich " * 300, "de", "s", 1),
        (13, "Été à 日本 😀 don't <|endoftext|> 12", "fr", "s", 1), (14, "ONE two", "en", "s", 7), (15, "12 34 !!", None, "s", 1),
    ]
    return [(*r, "7", "k", "i") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
