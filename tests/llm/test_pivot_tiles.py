"""Tiles of blocks in the pivot search: many tiles an annulus, sizes of components, names used inside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import pivots


def expected(rows, every, width):
    q = np.zeros((len(rows), width), dtype=object)
    for i, (_, v) in enumerate(rows):
        q[i, :len(v)] = [int(np.floor(256 * x)) for x in v]
    want = []
    for i in range(0, len(rows), every):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(len(rows)) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    return sorted(want)


@pytest.mark.parametrize("largest", [1.0, 1e4, 1e8])
def test_many_tiles_give_the_exact_answer(spark, monkeypatch, largest):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 4)
    monkeypatch.setattr(pivots, "QUERY_ROWS", 3)
    monkeypatch.setattr(pivots, "TILE", 2)
    rng = np.random.default_rng(11)
    near = rng.normal(size=5)
    m = np.concatenate([rng.normal(size=(90, 5)), near + rng.normal(size=(60, 5)) * 1e-3])
    rows = [(i, [float(x) for x in (v if i % 7 else v[:3])]) for i, v in enumerate(m)]
    rows[4] = (4, [largest, -largest, 0.0])
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("id", "v", "pivot", "no", "ring", "part", "band", "column", "qpart", "d")})
    got = [tuple(r) for r in pivots.search(vectors, vectors.filter(F.col("vec_id") % 3 == 0)).collect()]
    assert sorted(got) == expected(rows, 3, 5)


def test_components_take_the_smallest_kind():
    assert [pivots.smallest_kind(x) for x in (0, 32767, 32768, 2**31)] == [np.int16, np.int16, np.int32, np.int64]
