import pytest

#: Columns that operators must carry along or pass over, named as their own.
CLASHING = {"id": 1, "t": "x", "n": 2, "s": "y", "k": 3, "shard": 9, "score": 0.5, "root": 7, "g": "z", "a.b": 1, "rank": 4, "block": 5, "__shard": 6, "entry": "e"}


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows and clashing columns."""
    long = "word " * 30_000 + "end"
    rows = [(1, "a plain text of some words", "en", "s0", 26), (1, "a plain text of some words", "en", "s0", 26), (2, "", "en", "s0", 0), (3, None, None, None, None), (None, "no id here at all", "fr", "s1", 17), (None, None, None, None, None), (4, long, "de", "s1", len(long)), (5, " \n\t", "en", None, 3), (6, "!!! ???", "es", "", 7), (7, "x" * 200_000, "fr", "s1", 200_000), (8, "a plain text of some words", "en", "s0", 26), (9, "naïve 日本語 текст \U0001f600 \x00 '\"", "xx", "s2", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(v).alias(k) for k, v in CLASHING.items()))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("doc_id = -1")
