"""Exact top-k by inner product over a pivot-distance index (operator 2).

Components become ``floor(256 * x)``. With one more component that gives every indexed vector the same norm, the largest
inner product is the smallest Euclidean distance, so distances to pivots bound scores by the triangle inequality. Every
vector is keyed by its nearest pivot and its distance to it; the keys of a pivot are cut into at most ``ANNULI`` sorted
annuli by quantiles. The annuli of all pivots, whose number does not grow with the data, give each query an order of
lower bounds. Queries first look into the annuli with the smallest bounds until ``K`` candidates are seen; the k-th score is
then a bound, and the queries expand to all annuli whose bound does not exceed it. Bounds are widened by a rounding
slack and ties are kept, so the result is exact and equal scores go to the smaller id.

Rows of an annulus are packed into blocks of about ``BLOCK_ROWS`` vectors, and so are the queries, so that a task
multiplies one block of queries with one block of vectors and emits at most ``K`` rows for each of its queries. Blocks meet in tiles of
``TILE`` by ``TILE`` blocks of an annulus: an annulus of any size spreads over as many join keys as it has tiles, and a block is sent once for
every tile of its row or column. Components are kept in the smallest of 2, 4 or 8 bytes that the largest of them fits.

Defined cases: rows whose id or vector is null, or whose vector holds a null, NaN or infinite component, take no part; vectors
shorter than the longest count as padded with zeros; repeated (id, vector) rows count once, and a query's own rows, all
rows with its id, are no candidates of it; an id with several vectors is one query by its smallest vector, and answers with its best score. A query
without candidates has no rows. The pivots are fitted on at most ``SAMPLE`` rows; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import hashed_sample, settle, table

K = 5
EVERY = 50
SAMPLE = 4096
PIVOTS = 32
ANNULI = 16
BLOCK_ROWS = 2048
QUERY_ROWS = 512
TILE = 16


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """The vectors as rows, padded with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def smallest_kind(largest: int) -> type:
    """The smallest integer type that holds both ``largest`` and its negative."""
    return next(t for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)


def _lifted(m: np.ndarray, top: float) -> np.ndarray:
    """The vectors as points of one norm, whose square is ``top``."""
    x = m.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def fit_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots by a few rounds of nearest-mean refinement of the sample, from spread-out starts."""
    start = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(start) < min(pivots, len(sample)) and near.max() > 0:
        start.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[start[-1:]])[:, 0])
    centres = sample[start]
    for _ in range(5):
        own = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; floats are exact below 2^53 and much faster."""
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < 1 << 52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _best(scores: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every query the places of its k best ids, best first, ties to the smaller id; ``ids`` ascend and differ."""
    for i in range(len(query)):
        s = np.where(ids == query[i], np.iinfo(np.int64).min, scores[i])
        n = min(k, len(s))
        if not n:
            continue
        floor = np.partition(s, len(s) - n)[len(s) - n]
        at = np.flatnonzero(s >= floor)
        at = at[np.lexsort((ids[at], -s[at]))][:k]
        yield i, at[ids[at] != query[i]]


def _merged(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best ids of every query among candidates of several blocks."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[new], ids[new], scores[new]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query)
    best = np.arange(len(query)) - first < k
    return [query[best], ids[best], scores[best]]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for every row of ``queries``."""
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        plain = df.select(df[key].cast("bigint").alias("id"), df[vector].alias("v"))
        return plain.filter(F.col("id").isNotNull() & valid(F.col("v"))).select("id", quantised(F.col("v")).alias("v")).distinct()

    data = settle(ready(vectors), "vectors")
    norm = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = F.greatest(F.array_max("v"), -F.array_min("v"))
    facts = data.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("top"), F.max(most).alias("most")).first()
    if facts["width"] is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, top, kind = facts["width"], facts["top"], smallest_kind(facts["most"] or 0)
    picked = hashed_sample(data, F.xxhash64("id"), SAMPLE).orderBy("id", "v").select("v").toArrow().column("v").combine_chunks()
    pivots = fit_pivots(_lifted(_matrix(picked, width), top), PIVOTS)
    slack = 1e-6 * (1 + np.sqrt(top))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), width, kind)
            d = _distances(_lifted(m, top), pivots)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(own, pa.int32()), pa.array(d[np.arange(len(m)), own]),
                pa.array([row.tobytes() for row in m], pa.binary()),
            ], names=["id", "pivot", "d", "v"])

    index = settle(data.mapInArrow(keyed, "id bigint, pivot int, d double, v binary"), "pivot-index")
    cuts = index.groupBy("pivot").agg(F.percentile_approx("d", [i / ANNULI for i in range(1, ANNULI)], 2000).alias("cuts"))
    # At most PIVOTS rows, whatever the input.
    ringed = index.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("d")))).drop("cuts")
    rings = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    annuli = sorted(map(tuple, rings.collect()))
    sized = spark.createDataFrame([(p, r, n) for p, r, n, _, _ in annuli], "pivot int, ring int, n bigint")
    part = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        held = group.column("v").to_pylist()
        return pa.table({
            "pivot": group.column("pivot")[:1], "ring": group.column("ring")[:1], "part": group.column("part")[:1],
            "ids": pa.array([ids[order].tobytes()], pa.binary()), "rows": pa.array([b"".join(held[i] for i in order)], pa.binary())})

    blocks = settle(ringed.join(F.broadcast(sized), ["pivot", "ring"]).withColumn("part", part).groupBy("pivot", "ring", "part")
                    .applyInArrow(pack, "pivot int, ring int, part int, ids binary, rows binary"), "annuli")

    lows, highs = np.array([a[3] for a in annuli]), np.array([a[4] for a in annuli])
    of = np.array([a[0] for a in annuli])
    counts = np.array([a[2] for a in annuli])

    def bounds(q: np.ndarray) -> np.ndarray:
        """Lower bound of the distance from each query to each annulus."""
        point = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
        d = _distances(point, pivots)[:, of]
        return np.maximum(np.maximum(d - highs, lows - d), 0) - slack

    asked = ready(queries).groupBy("id").agg(F.min("v").alias("v"))

    def first_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(1), width, kind)
            low = bounds(q)
            order = np.argsort(low, axis=1, kind="stable")
            # One candidate more than k, as the query's own row may be among them.
            need = (np.cumsum(counts[order], axis=1) <= k).sum(axis=1) + 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()),
                pa.array([order[i, :n].tolist() for i, n in enumerate(need)], pa.list_(pa.int32())),
            ], names=["id", "v", "rings"])

    numbers = F.broadcast(spark.createDataFrame(  # at most PIVOTS * ANNULI rows
        [(i, a[0], a[1], -(-a[2] // (BLOCK_ROWS * TILE))) for i, a in enumerate(annuli)], "no int, pivot int, ring int, bands int"))

    def tiled(df: DataFrame) -> DataFrame:
        """Blocks of vectors next to blocks of queries that ask for their annulus, brought together by tile."""
        rows = df.select("id", "v", F.explode("rings").alias("no"))
        # At most PIVOTS * ANNULI rows, whatever the input.
        many = F.broadcast(rows.groupBy("no").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("qparts")))
        rows = rows.join(many, "no").withColumn("qpart", F.pmod(F.xxhash64("id"), F.col("qparts")).cast("int"))

        def gather(group: pa.Table) -> pa.Table:
            ids = group.column("id").to_numpy()
            return pa.table({"no": group.column("no")[:1], "qpart": group.column("qpart")[:1],
                             "q_ids": pa.array([ids.tobytes()], pa.binary()), "q_rows": pa.array([b"".join(group.column("v").to_pylist())], pa.binary())})

        asking = rows.select("id", "v", "no", "qpart").groupBy("no", "qpart").applyInArrow(
            gather, "no int, qpart int, q_ids binary, q_rows binary")
        asking = asking.join(numbers, "no").select(
            "no", F.floor(F.col("qpart") / TILE).cast("int").alias("column"), F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"),
            "q_ids", "q_rows")
        held = blocks.join(numbers, ["pivot", "ring"]).join(many, "no").select(
            "no", F.floor(F.col("part") / TILE).cast("int").alias("band"),
            F.explode(F.sequence(F.lit(0), F.floor((F.col("qparts") - 1) / TILE).cast("int"))).alias("column"), "ids", "rows")
        return held.join(asking, ["no", "band", "column"]).select("ids", "rows", "q_ids", "q_rows")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for ids, rows, q_ids, q_rows in zip(*(batch.column(c).to_pylist() for c in range(4))):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                x = np.frombuffer(rows, kind).reshape(len(ids), width)
                q = np.frombuffer(q_rows, kind).reshape(len(q_ids), width)
                s = _scores(q, x)
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                if len(first) < len(ids):
                    ids, s = ids[first], np.maximum.reduceat(s, first, axis=1)
                for i, at in _best(s, q_ids, ids, k):
                    parts[0].append(np.full(len(at), q_ids[i]))
                    parts[1].append(ids[at])
                    parts[2].append(s[i, at])
            out = _merged(*map(np.concatenate, parts), k)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["query_id", "vec_id", "score"])

    def answers(df: DataFrame) -> DataFrame:
        found = tiled(df).mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def highest(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    started = settle(asked.mapInArrow(first_rings, "id bigint, v binary, rings array<int>"), "queries")
    seen = settle(highest(answers(started)), "first-answers")
    kth = seen.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))

    def more_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(batch.num_rows, width)
            done = batch.column(2).to_pylist()
            worst = batch.column(3).to_pylist()
            low = bounds(q)
            squares = (q.astype(np.float64) ** 2).sum(axis=1)
            rest = []
            for i in range(len(q)):
                reach = np.inf if worst[i] is None else np.sqrt(max(squares[i] + top - 2.0 * worst[i], 0)) + slack
                rest.append(sorted(set(np.flatnonzero(low[i] <= reach).tolist()) - set(done[i])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rest, pa.list_(pa.int32()))], names=["id", "v", "rings"])

    expanded = started.join(kth, "id", "left").select("id", "v", "rings", "kth").mapInArrow(
        more_rings, "id bigint, v binary, rings array<int>")
    rest = answers(settle(expanded, "expanded"))
    both = seen.select("query_id", "vec_id", "score").union(rest.select("query_id", "vec_id", "score"))
    # An id with several vectors may have been seen in both rounds.
    once = both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return highest(once).select("query_id", "rank", "vec_id", "score")


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

QUERIES = {"op2_pivot_topk": op2_pivot_topk}
ORACLES = {"op2_pivot_topk": ORACLE}
