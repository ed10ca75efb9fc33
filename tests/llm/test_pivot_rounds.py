"""An id with several vectors seen in both rounds of the pivot search."""

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import pivots


def test_an_id_takes_one_rank(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(120, 6))
    rows = [(i, [float(x) for x in f * v[i]]) for i in range(120) for f in (1.0, 1.3)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = np.stack([np.floor(256 * np.array(x)).astype(np.int64) for _, x in rows])
    want = []
    for i in range(0, 120, 5):
        asked = min(tuple(q[2 * i].tolist()), tuple(q[2 * i + 1].tolist()))
        scores = (q @ np.array(asked)).reshape(120, 2).max(axis=1).tolist()
        order = sorted((-s, j) for j, s in enumerate(scores) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    got = [tuple(r) for r in pivots.search(vectors, vectors.filter(F.col("vec_id") % 5 == 0)).collect()]
    assert sorted(got) == sorted(want)
