import random

import pytest


def words(r, n, pool=400):
    return [f"w{r.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    r = random.Random(3)
    long = " ".join(words(r, 30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
        (2, None, None, None, None), (None, "text without an id and some more words", None, "a", 3), (None, None, None, None, None),
        (3, "", "en", "a", 0), (4, "   \n\t ", "en", "b", 6), (5, long, "en", "a", len(long)), (6, "x" * 5000, "de", "b", 5000), (7, "é ñ ü 日本語 " * 40, "fr", None, 1),
        (8, "same line\nsame line\nother", "en", "a", 1), (9, "card 4111 1111 1111 1111 a@b.com 10.0.0.1 +1 (555) 123-4567", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", F.lit("clash").alias("n_words"), F.lit(1).alias("bucket"), F.lit(None).cast("string").alias("host"), F.lit(9).alias("th"), F.lit(0).alias("kind"), F.lit("k").alias("key"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
