"""Running sums in numpy over ranges of values, for work that needs many sums of each value at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import settle

BUCKET_ROWS = 20_000
MAX_BUCKETS = 1024
STRIPE_ROWS = 131_072
DENSE = 32
DENSE_AT_ONCE = 512


def pair_products(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over unordered pairs of ``w_i w_j |x_i - x_j| |y_i - y_j|``.

    With the points in order of x, each level joins neighbouring runs: running sums along y of the left run serve all points of the
    right one. They give the pairs that rise or fall together; the signed sum over all pairs has a closed form, and twice the
    former less the latter is the sum of absolute values.
    """
    n = len(x)
    if n < 2:
        return 0.0
    signed = w.sum() * (w * x * y).sum() - (w * x).sum() * (w * y).sum()
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    by_y = np.argsort(y, kind="stable")
    short = -(-n // DENSE) * DENSE
    a, b, c = (np.pad(v, (0, short - n)).reshape(-1, DENSE) for v in (x, y, w))
    rising, run = 0.0, DENSE
    for at in range(0, len(a), DENSE_AT_ONCE):  # a few MB at once, whatever the number of points
        p, q, r = (v[at:at + DENSE_AT_ONCE] for v in (a, b, c))
        dx, dy = p[:, :, None] - p[:, None, :], q[:, :, None] - q[:, None, :]
        rising += float(((r[:, :, None] * r[:, None, :]) * (np.maximum(dx, 0) * np.maximum(dy, 0))).sum())
    while run < n:
        pair = by_y // (2 * run)
        order = np.argsort(pair.astype(np.uint16) if n // (2 * run) < 1 << 16 else pair, kind="stable")
        line, pair = by_y[order], pair[order]
        right = (line // run) % 2 == 1
        left = np.where(right, 0.0, w[line])
        xs, ys = x[line], y[line]
        first = np.searchsorted(pair, np.arange(int(pair[-1]) + 1))[pair]
        sums = []
        for term in (left, left * xs, left * ys, left * xs * ys):
            total = np.concatenate([[0.0], np.cumsum(term)])
            sums.append((total[1:] - total[first])[right])
        one, sx, sy, sxy = sums
        xs, ys = xs[right], ys[right]
        rising += float((w[line[right]] * (xs * ys * one - ys * sx - xs * sy + sxy)).sum())
        run *= 2
    return 2 * rising - signed


def crossing_products(a: np.ndarray, b: np.ndarray, w: np.ndarray, wx: np.ndarray, wy: np.ndarray, wxy: np.ndarray) -> float:
    """Sum of ``w_i w_j |x_i - x_j| |y_i - y_j|`` over the pairs whose cells differ both in ``a``, which ascends with x, and in ``b``, which
    ascends with y, from the sums of each cell: all pairs of two such cells rise, or all fall."""
    (a, rows), (b, columns) = ((x.ravel(), len(u)) for u, x in (np.unique(v, return_inverse=True) for v in (a, b)))
    grids = []
    for v in (w, wx, wy, wxy):
        grid = np.zeros((rows, columns))
        np.add.at(grid, (a, b), v)
        grids.append(grid)
    before = [np.cumsum(g, axis=0) - g for g in grids]  # smaller a, the same b
    less = [np.cumsum(g, axis=1) - g for g in before]
    more = [g.sum(axis=1, keepdims=True) - np.cumsum(g, axis=1) for g in before]
    n, x, y, xy = (u - v for u, v in zip(less, more))
    return float((n * grids[3] - y * grids[1] - x * grids[2] + xy * grids[0]).sum())


def bucket_of(value: Column, borders: Sequence[float]) -> Column:
    """Number of borders below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in borders]), lambda b: b < value)) if len(borders) else F.lit(0)


def value_sums(tuples: DataFrame, slots: list[tuple[int, int]], columns: tuple[str, ...], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(feature, v, sums): for each distinct value of a feature the sum of |v - x| over the members of every slot (k, c).

    ``tuples`` holds the features, a weight ``w`` and ``labels``. Values are cut into buckets at their quantiles, so packed values spread like
    others; a bucket's totals carry into the next ones, and one task sees one bucket with a column for each slot.
    """
    buckets = int(min(MAX_BUCKETS, max(1, -(-tuples.count() // bucket_rows))))
    borders = tuples.approxQuantile(list(columns), [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else [[]] * len(columns)
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"), bucket_of(F.col(c), sorted(set(b))).alias("bucket"))
                       for c, b in zip(columns, borders)])
    long = tuples.select("w", "labels", F.explode(values).alias("f")).select(
        "f.*", "w", F.explode("labels").alias("l")).groupBy("feature", "bucket", "v", "l.k", "l.c").agg(F.sum("w").cast("double").alias("w"))
    long = settle(long, "slot-values")
    totals = long.groupBy("feature", "bucket", "k", "c").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("s"))
    group = Window.partitionBy("feature", "k", "c")
    every = totals.select("feature", "bucket").distinct()
    spread = every.join(totals.select("feature", "k", "c").distinct(), "feature").join(totals, ["feature", "bucket", "k", "c"], "left")
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    carried = settle(spread.select("feature", "bucket", "k", "c", *[
        F.coalesce(F.sum(m).over(before), zero).alias(f"{m}_before") for m in ("w", "s")], *[
        F.coalesce(F.sum(m).over(group), zero).alias(f"{m}_all") for m in ("w", "s")]), "carries")
    place = {s: i for i, s in enumerate(slots)}

    def at(table: pa.Table) -> np.ndarray:
        return np.array([place[s] for s in zip(table.column("k").to_pylist(), table.column("c").to_pylist())], dtype=np.int64)

    def work(rows: pa.Table, carry: pa.Table) -> pa.Table:
        v, back = np.unique(rows.column("v").to_numpy(), return_inverse=True)
        slot, to = at(rows), at(carry)
        w = np.zeros((len(v), len(slots)))
        w[back, slot] = rows.column("w").to_numpy()
        run_w, run_s = np.cumsum(w, axis=0), np.cumsum(w * v[:, None], axis=0)
        whole = {}
        for name in ("w_before", "s_before", "w_all", "s_all"):
            whole[name] = np.zeros(len(slots))
            whole[name][to] = carry.column(name).to_numpy()
        run_w += whole["w_before"]
        run_s += whole["s_before"]
        sums = v[:, None] * (2 * run_w - whole["w_all"]) - 2 * run_s + whole["s_all"]
        ends = np.arange(len(v) + 1, dtype=np.int32) * len(slots)
        return pa.table({"feature": pa.array([rows.column("feature")[0].as_py()] * len(v)), "v": v,
                         "sums": pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))})

    return long.groupBy("feature", "bucket").cogroup(carried.groupBy("feature", "bucket")).applyInArrow(
        work, "feature string, v double, sums array<double>")
