import random

import pytest

from barline.llm.common import ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def settings(spark):
    return ready(spark)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and extra
    columns whose names clash with those of results and intermediate steps."""
    rng = random.Random(5)
    long = words(rng, 60_000)
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, long, None, None, 1), (4, long, "en", "b", 1),
            (None, "one two", "en", "b", None), (None, "one two", None, "b", None), (None, None, None, None, None),
            (5, "one two", "fr", "c", 7), (5, "one two", "fr", "c", 7), (6, "ünï \U0001F600 \U0001F600", "de", "c", 5),
            (7, "?!", "de", None, 2), (8, "??", "de", None, 2), (9, "One  Two", "de", "d", 8)]
    rows += [(100 + i, words(rng, rng.randrange(1, 300)), "en", "abc"[i % 3], i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    for name in ("kept", "keep_id", "hash", "size", "row", "body", "id", "n", "salt", "label", "score", "bytes",
                 "prefix", "node", "class_id", "position", "length", "odd `name.x"):
        df = df.withColumn(name, F.lit("extra"))
    return df.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
