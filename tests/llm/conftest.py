import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s1")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long and repeated texts, repeated and null keys."""
    long = " ".join(f"word{i}" for i in range(30000))
    return [
        (1, "one two three four five six", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "en", "a"),
        (5, long, "en", "b"), (6, "short", "en", "b"), (7, "short", "fr", "b"), (7, "short", "fr", "b"),
        (None, "null key text with some more words in it", "en", "c"), (8, "é中🙂  x", "de", "c"),
        (-50, "password = abcdefghijklmnop1", "en", "c"),
    ]


@pytest.fixture(scope="session")
def clashing():
    """Columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("key", "th", "row", "owner", "found", "rid", "set", "n", "h", "range", "cell", "size", "crc", "part", "ids",
             "item", "license", "dir", "share", "url_", "held_out", "score", "held", "words", "block", "label")
    return lambda df: df.withColumns({c: F.lit("x") for c in names if c not in df.columns})
