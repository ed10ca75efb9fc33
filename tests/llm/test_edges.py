"""Every operator on empty tables, odd rows and tables with clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from sightline.llm import bpe, decontaminate, jaccard, licences, maintext, pivots, secrets, sharding, simple8b, toxicity
from sightline.llm.common import shared_path

TOKENS = bpe.tokenizer_path()


def ids(docs):
    folder = shared_path(docs.sparkSession, "ids")
    simple8b.write_ids(docs, TOKENS, folder)
    return simple8b.read_ids(docs.sparkSession, folder)


def items(docs):
    return docs.sparkSession.createDataFrame(
        [(1, "one two three four five six"), (2, None), (3, ""), (None, "short")], "item_id bigint, text string")


def labels(docs):
    return docs.sparkSession.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")


OPERATORS = {
    "jaccard": jaccard.join_components,
    "keep_one": jaccard.keep_one,
    "secrets": secrets.scan,
    "redact": secrets.redact,
    "bpe": lambda d: bpe.encoded(d, TOKENS),
    "sharding": sharding.assign,
    "leaks": lambda d: decontaminate.matches(d, items(d)),
    "clean": lambda d: decontaminate.clean(d, items(d)),
    "toxicity": lambda d: toxicity.scores(d, toxicity.fit(d, labels(d))),
    "reject": lambda d: toxicity.reject(d, toxicity.fit(d, labels(d))),
    "licences": lambda d: licences.scan(d, path="source"),
    "ids": ids,
}
WHOLE = {"jaccard", "secrets", "redact", "bpe", "sharding", "toxicity", "licences", "ids"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, documents):
    assert OPERATORS[name](documents([])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_with_clashing_columns(name, documents, odd_rows, clashing):
    docs = clashing(documents(odd_rows)).repartition(3)
    out = OPERATORS[name](docs)
    got = out.collect()
    if name in WHOLE:
        assert len(got) == len(odd_rows)
    if name in ("keep_one", "redact", "clean", "reject"):
        assert out.columns == docs.columns


def test_pages(spark):
    schema = "page_id bigint, url string, html string, key string"
    assert maintext.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>", "x"), (3, "u", "plain &amp; text", "x"), (3, "u", "plain &amp; text", "x")]
    got = {(r.page_id, r.text) for r in maintext.extract(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, ""), (None, ""), (2, ""), (3, "plain & text")}


def test_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, score int, rank int"
    empty = spark.createDataFrame([], schema)
    assert pivots.search(empty, empty).count() == 0
    nan = float("nan")
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.1, None]), (5, [nan, 1.0]),
            (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [-1.0])]
    vectors = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    got = [tuple(r) for r in pivots.search(vectors, vectors.filter(F.col("vec_id") == 0)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 7, 0), (0, 4, 8, -32768)]
