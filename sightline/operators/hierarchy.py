"""Hierarchical grouping of weighted feature tuples under the Gower dissimilarity, with the Ward criterion.

Individuals with equal features are one tuple with a weight. A cluster is its weight and its mean features; joining two
costs ``w1 w2 / (w1 + w2)`` times their squared Gower dissimilarity. In a round every cluster names its cheapest partner among
all others, and clusters that name each other merge; at least the cheapest pair of all does. Rounds go on until ``k`` clusters
are left, and the last one merges only as many pairs, cheapest first, as that takes. The search for partners is exact but skips
the clusters that a bound rules out (``partners.py``), so it does not form all pairs.

While there are more than ``TAIL`` clusters a round is a Spark job. The neighbours in the order of each feature give every cluster
a first partner, the other clusters of its block a better one, and it then asks those blocks that may still hold a cheaper one.
The rest of the rounds run over at most ``TAIL`` rows in one task, by the same arithmetic in the same order, so the result does not
depend on where the change falls.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.fidelity import FEATURES
from sightline.operators.partners import CELLS, NOBODY, Leaves, box_bound, cheapest_partners, look_up
from sightline.session import settle

TAIL = 65_536
RANGE_ROWS = 200_000
BLOCK_ROWS = 8192
BORDER_ROWS = 65_536
ASK_ROWS = 65_536


def weighted_tuples(scaled: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Distinct tuples as clusters: ``cluster`` is the smallest id (the last number, if there is none), ``w`` the number of individuals."""
    return scaled.groupBy(*columns).agg(F.coalesce(F.min("id"), F.lit(NOBODY)).alias("cluster"), F.count("*").cast("double").alias("w")).select("cluster", "w", *columns)


def merge_cost(a: Column, b: Column, columns: tuple[str, ...]) -> Column:
    gower = reduce(lambda x, y: x + y, [F.abs(a[c] - b[c]) for c in columns]) / F.lit(float(len(columns)))
    return a["w"] * b["w"] / (a["w"] + b["w"]) * (gower * gower)


def _adjacent(clusters: DataFrame, columns: tuple[str, ...], parts: int) -> DataFrame:
    """(a, b): each cluster with the next one in the order of each feature and of the cluster number; all features in one job."""
    fields = ("cluster", "w", *columns)
    orders = [clusters.select(F.lit(i).alias("feature"), F.col(c).alias("at"), *fields).repartitionByRange(parts, "at", "cluster")
              for i, c in enumerate(columns)]
    ranged = settle(reduce(DataFrame.union, orders).withColumn("part", F.spark_partition_id()), "ordered")
    one = F.struct(*fields)
    inside = ranged.select(one.alias("a"), F.lead(one).over(Window.partitionBy("feature", "part").orderBy("at", "cluster")).alias("b"))
    ends = ranged.groupBy("feature", "part").agg(*[f(F.struct("at", *fields)).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    border = ends.select("last", F.lead("first").over(Window.partitionBy("feature").orderBy("part")).alias("next")).filter("next IS NOT NULL")
    return inside.filter("b IS NOT NULL").union(border.select(*[
        F.struct(*[F.col(side)[c].alias(c) for c in fields]).alias(n) for side, n in (("last", "a"), ("next", "b"))]))


def _seeded(pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(cluster, w, features, cost, partner): the cheapest of the neighbours of each cluster."""
    sides = F.array(*[F.struct(F.col(x).alias("me"), F.col(y).alias("you")) for x, y in ("ab", "ba")])
    each = pairs.select(F.explode(sides).alias("p")).select("p.*")
    best = F.struct(merge_cost(F.col("me"), F.col("you"), columns).alias("cost"), F.col("you.cluster").alias("partner"))
    return each.withColumn("best", best).groupBy("me.cluster").agg(F.first("me").alias("me"), F.min("best").alias("best")).select("me.*", "best.*")


class Borders:
    """A tree of cuts that puts clusters near each other into one block; ``rows`` (a row for each feature) only place the cuts."""

    def __init__(self, rows: np.ndarray, blocks: int):
        self.axis, self.cut, self.child = [], [], []
        self._grow(rows, blocks)
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child)

    def _grow(self, rows: np.ndarray, blocks: int) -> int:
        node = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((node, node))
        if blocks > 1 and rows.shape[1] > 1 and np.ptp(rows, axis=1).max() > 0:
            axis = int(np.argmax(np.ptp(rows, axis=1)))
            x = rows[axis]
            cut = np.median(x)
            if not (x < cut).any():
                cut = x[x > cut].min()
            less = x < cut
            part = min(max(1, round(blocks * less.mean())), blocks - 1)
            self.axis[node], self.cut[node] = axis, cut
            self.child[node] = (self._grow(rows[:, less], part), self._grow(rows[:, ~less], blocks - part))
        return node

    def block(self, features: np.ndarray) -> np.ndarray:
        at, every = np.zeros(features.shape[1], dtype=np.int64), np.arange(features.shape[1])
        while (self.axis[at] >= 0).any():
            right = features[np.maximum(self.axis[at], 0), every] >= self.cut[at]
            at = self.child[at, right.astype(np.int64)]
        return at


def _arrays(rows: pa.Table | pa.RecordBatch, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows.column("cluster").to_numpy(), rows.column("w").to_numpy(), np.stack([rows.column(c).to_numpy() for c in columns])


def _blocked(clusters: DataFrame, count: int, columns: tuple[str, ...]) -> DataFrame:
    """The clusters with the number of their block, of about ``BLOCK_ROWS`` rows each."""
    blocks = min(-(-count // BLOCK_ROWS), BORDER_ROWS // 32)
    placing = clusters.select(*columns).sample(min(1.0, BORDER_ROWS / count), seed=1).toArrow()  # borders only; every cluster has a block
    borders = Borders(np.stack([placing.column(c).to_numpy() for c in columns]), blocks)

    def put(batches):
        for b in batches:
            yield b.append_column("block", pa.array(borders.block(_arrays(b, columns)[2])))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clusters.schema.fields)
    return clusters.mapInArrow(put, f"{fields}, block bigint")


def cheapest(clusters: DataFrame, count: int, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(cluster, w, features, cost, partner): the cheapest partner of each cluster among all others, ties to the smallest number."""
    parts = max(2, -(-count // RANGE_ROWS))
    blocked = settle(_blocked(settle(_seeded(_adjacent(clusters, columns, parts), columns), "seeded"), count, columns), "blocked")
    boxes = blocked.groupBy("block").agg(F.min("w"), *[f(c) for f in (F.min, F.max) for c in columns]).orderBy("block").toArrow()
    block, light, *sides = [c.to_numpy() for c in boxes.columns]
    low, high = np.stack(sides[:len(columns)]), np.stack(sides[len(columns):])
    tasks = len(block)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocked.schema.fields)
    found = "cluster bigint, cost double, partner bigint"

    def inside(rows: pa.Table) -> pa.Table:
        leaves = Leaves(*_arrays(rows, columns))
        leaves.start(rows.column("cost").to_numpy(), rows.column("partner").to_numpy())
        look_up(leaves, leaves)
        for name, values in zip(("cost", "partner"), leaves.found()):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
        return rows

    def route(batches):
        step = max(1, CELLS // tasks)
        for b in (part.slice(i, step) for part in batches for i in range(0, part.num_rows, step)):
            _, w, f = _arrays(b, columns)
            bound = box_bound(w[:, None], f[:, :, None], f[:, :, None], light, low[:, None], high[:, None])
            row, to = np.nonzero((bound <= b.column("cost").to_numpy()[:, None]) & (b.column("block").to_numpy()[:, None] != block))
            asked = b.take(pa.array(row))
            yield asked.set_column(asked.schema.get_field_index("block"), "block", pa.array(block[to]))

    def across(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked.select(["cluster", "cost", "partner"])
        ask = Leaves(*_arrays(asked, columns))
        cost, partner = asked.column("cost").to_numpy(), asked.column("partner").to_numpy()
        ask.start(cost, partner)
        look_up(ask, Leaves(*_arrays(rows, columns)))
        least, who = ask.found()
        better = np.flatnonzero((least < cost) | (who != partner))
        return pa.table({"cluster": asked.column("cluster").to_numpy()[better], "cost": least[better], "partner": who[better]})

    own = settle(blocked.repartition(tasks, "block").groupBy("block").applyInArrow(inside, schema), "own")
    asked = settle(own.mapInArrow(route, schema), "asked")
    sizes = settle(asked.groupBy("block").agg(F.ceil(F.count("*") / ASK_ROWS).cast("int").alias("pieces")), "sizes")
    key = ["block", "piece"]
    asking = asked.join(sizes, "block").withColumn("piece", F.pmod(F.xxhash64("cluster"), "pieces").cast("int")).drop("pieces")
    holding = blocked.drop("cost", "partner").join(sizes, "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    answers = asking.repartition(tasks, *key).groupBy(*key).cogroup(holding.repartition(tasks, *key).groupBy(*key)).applyInArrow(across, found)
    offers = own.drop("block").unionByName(answers, allowMissingColumns=True)
    return offers.groupBy("cluster").agg(
        *[F.max(c).alias(c) for c in ("w", *columns)], F.min(F.struct("cost", "partner")).alias("best")).select("cluster", "w", *columns, "best.*")


def merge_round(clusters: DataFrame, count: int, k: int, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(cluster, into, w, features) of the clusters that merge in this round."""
    side = F.struct("w", *columns)
    edge = F.struct("cost", F.least("cluster", "partner").alias("lo"), F.greatest("cluster", "partner").alias("hi"))
    mutual = cheapest(clusters, count, columns).withColumn("edge", edge).groupBy("edge").agg(
        F.count("*").alias("n"), F.min_by(side, "cluster").alias("a"), F.max_by(side, "cluster").alias("b")).filter("n = 2")
    chosen = settle(mutual, "mutual")
    if chosen.count() > count - k:
        chosen = chosen.orderBy("edge").limit(count - k)
    w = F.col("a.w") + F.col("b.w")
    merged = chosen.select("edge.lo", "edge.hi", w.alias("w"), *[
        ((F.col("a.w") * F.col(f"a.{c}") + F.col("b.w") * F.col(f"b.{c}")) / w).alias(c) for c in columns])
    return merged.select(F.explode(F.array("lo", "hi")).alias("cluster"), F.col("lo").alias("into"), "w", *columns)


def merged_rows(numbers: np.ndarray, weight: np.ndarray, features: np.ndarray, k: int) -> np.ndarray:
    """The cluster number that each row ends in; ``features`` has a row for each feature."""
    order = np.argsort(numbers)
    numbers, w, f = numbers[order], weight[order].copy(), features[:, order].copy()
    at = np.arange(len(numbers))  # where each row's cluster is kept: at the row of its smallest number
    live = np.arange(len(numbers))
    while len(live) > k:
        cost, partner = np.empty(len(numbers)), np.empty(len(numbers), dtype=np.int64)
        cost[live], partner[live] = cheapest_partners(live, w[live], f[:, live])
        lo = live[(partner[partner[live]] == live) & (live < partner[live])]
        lo = lo[np.lexsort((partner[lo], lo, cost[lo]))][:len(live) - k]
        hi = partner[lo]
        total = w[lo] + w[hi]
        for x in f:
            x[lo] = (w[lo] * x[lo] + w[hi] * x[hi]) / total
        w[lo] = total
        into = np.arange(len(numbers))
        into[hi] = lo
        at = into[at]
        live = live[into[live] == live]
    out = np.empty_like(numbers)
    out[order] = numbers[at]
    return out


def agglomerate(tuples: DataFrame, k: int, columns: tuple[str, ...] = FEATURES, tail: int = TAIL) -> DataFrame:
    """(member, cluster): for each tuple, by its number, the number of the one of at most ``k`` clusters it ends in."""
    clusters = settle(tuples.select("cluster", "w", *columns), "clusters")
    member = clusters.select(F.col("cluster").alias("member"), "cluster")
    count = clusters.count()
    while count > max(tail, k):
        merged = settle(merge_round(clusters, count, k, columns), "merged")
        kept = clusters.join(merged.select("cluster"), "cluster", "left_anti")
        clusters = settle(kept.union(merged.filter("cluster = into").drop("into")), "clusters")
        moved = merged.filter("cluster <> into").select("cluster", "into")
        member = settle(member.join(moved, "cluster", "left").select("member", F.coalesce("into", "cluster").alias("cluster")), "members")
        count = clusters.count()
    number = clusters.schema["cluster"].dataType.simpleString()

    def work(group: pa.Table) -> pa.Table:
        numbers = group.column("cluster").to_numpy()
        f = np.stack([group.column(c).to_numpy() for c in columns])
        return pa.table({"cluster": numbers, "last": merged_rows(numbers, group.column("w").to_numpy(), f, k)})

    last = clusters.groupBy(F.lit(0).alias("all")).applyInArrow(work, f"cluster {number}, last {number}")
    return member.join(last, "cluster").select("member", F.col("last").alias("cluster"))


def hierarchical_labels(scaled: DataFrame, k: int, rate: str = "m_rate", columns: tuple[str, ...] = FEATURES, tail: int = TAIL) -> DataFrame:
    """(id, grp) of every individual: ``k`` groups (fewer, if there are fewer tuples) numbered by falling mean rate, ties by number."""
    tuples = settle(weighted_tuples(scaled, columns), "tuples")
    named = settle(tuples.join(agglomerate(tuples, k, columns, tail).withColumnRenamed("cluster", "top"),
                               F.col("cluster") == F.col("member")).select("top", "w", *columns), "named")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_rate"), "top")
    ranks = named.groupBy("top").agg(F.round(F.sum(F.col("w") * F.col(rate)) / F.sum("w"), 9).alias("mean_rate")).withColumn(
        "grp", F.row_number().over(order)).select("top", "grp")
    return scaled.join(named.join(ranks, "top").select("grp", *columns), list(columns)).select("id", "grp")
