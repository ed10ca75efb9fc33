"""Grouping of individuals by their fidelity features under the Gower dissimilarity.

Gower dissimilarity is a mean over features of |x_i - x_j| / range, so sums of it over many
individuals split by feature, and each feature's part follows from sorted running counts and sums.
The pair matrix is never built.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalar import let, one_row
from sightline.operators.fidelity import FEATURES
from sightline.operators.prefix import BUCKET_ROWS, STRIPE_ROWS, crossing_products, pair_products, value_sums
from sightline.operators.ranks import quantiles_from_runs, running_sums
from sightline.session import settle

DIGITS = 9


def standardize(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(x - mean) / sd with the n - 1 divisor; NULL for a constant feature."""
    stats = one_row(features, **{f"m_{c}": F.avg(c) for c in columns}, **{f"s_{c}": F.stddev_samp(c) for c in columns})
    return features.withColumn("s", stats).select(
        *[c for c in features.columns if c not in columns],
        *[F.try_divide(F.col(c) - F.col(f"s.m_{c}"), F.col(f"s.s_{c}")).alias(c) for c in columns],
    )


def range_scale(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(x - min) / (max - min), 0 for a constant feature.

    Standardizing first would change nothing: it is affine and the range divides it out.
    """
    stats = one_row(features, **{f"a_{c}": F.min(c) for c in columns}, **{f"b_{c}": F.max(c) for c in columns})

    def scaled(c: str) -> Column:
        low, high = F.col(f"s.a_{c}"), F.col(f"s.b_{c}")
        return F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0)).alias(c)

    return features.withColumn("s", stats).select(
        *[c for c in features.columns if c not in columns], *[scaled(c) for c in columns]
    )


def _long(df: DataFrame, keep: list[str], columns: tuple[str, ...] = FEATURES) -> DataFrame:
    return df.unpivot(keep, list(columns), "feature", "v")


def _value_runs(long: DataFrame) -> DataFrame:
    """Distinct values per feature with counts, sums and their running totals."""
    values = long.groupBy("feature", "v").agg(F.count("*").alias("w")).withColumn("s", F.col("w") * F.col("v"))
    return running_sums(settle(values, "values"), ["feature"], "v", ["w", "s"])


def _distance_sum(v: Column, w_run: Column, s_run: Column, w_all: Column, s_all: Column) -> Column:
    """Sum of |v - x| over a weighted set from its running and total counts and sums."""
    return v * w_run - s_run + (s_all - s_run) - v * (w_all - w_run)


def gower_sums(scaled: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """For each individual, the sum of its Gower dissimilarities to all others."""
    long = _long(scaled, ["id"], columns)
    total = _distance_sum(*[F.col(c) for c in ("v", "w_run", "s_run", "w_all", "s_all")])
    per_value = _value_runs(long).select("feature", "v", total.alias("part"))
    return long.join(per_value, ["feature", "v"]).groupBy("id").agg(
        (F.sum("part") / F.lit(float(len(columns)))).alias("sum_d")
    )


# ---- centres and labels -----------------------------------------------------------------------------

def quantile_centres(scaled: DataFrame, ks: list[int], columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """For each k, k starting centres at the (j - 1/2) / k quantiles of every feature."""
    wanted = [(k, j, (j - 0.5) / k) for k in ks for j in range(1, k + 1)]
    probs = sorted({p for _, _, p in wanted})
    found = quantiles_from_runs(_value_runs(_long(scaled, ["id"], columns)), ["feature"], "v", "w", probs)
    placed = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(j).alias("c"), F.lit(p).alias("p")) for k, j, p in wanted
    ])).alias("at")
    spread = found.select("feature", "p", "quantile", placed).filter(F.col("at.p") == F.col("p"))
    return spread.groupBy(F.col("at.k").alias("k"), F.col("at.c").alias("c")).agg(*[
        F.round(F.max(F.when(F.col("feature") == c, F.col("quantile"))), DIGITS).alias(c) for c in columns
    ])


def gower_distance(left: dict[str, Column], right: dict[str, Column], columns: tuple[str, ...] = FEATURES) -> Column:
    return reduce(lambda a, b: a + b, [F.abs(left[c] - right[c]) for c in columns]) / F.lit(float(len(columns)))


def assign_nearest(scaled: DataFrame, centres: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Nearest centre of each individual for every k in ``centres``; ties go to the lower number.

    The centres (at most k per k) travel as one nested array, so individuals are labelled where
    they are, without a shuffle.
    """
    sets = centres.groupBy("k").agg(F.collect_list(F.struct("c", *columns)).alias("centres"))
    listed = one_row(sets, all=F.collect_list(F.struct("k", "centres")))
    per_k = scaled.select("id", *columns, F.explode(listed["all"]).alias("set"))
    own = {c: F.col(c) for c in columns}
    near = F.array_min(F.transform("set.centres", lambda m: F.struct(
        F.round(gower_distance(own, {c: m[c] for c in columns}, columns), DIGITS).alias("d"), m["c"].alias("c"),
    )))
    return per_k.select("id", F.col("set.k").alias("k"), near.alias("near"), *columns).select(
        "id", "k", F.col("near.c").alias("c"), F.col("near.d").alias("d"), *columns
    )


def centre_means(labelled: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Size and mean features of each cluster: the refinement step after an assignment."""
    return labelled.groupBy("k", "c").agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in columns])


# ---- quality of a clustering ----------------------------------------------------------------------------

def weighted_labels(labelled: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Distinct tuples with their weight ``w`` and their cluster for every k, as sorted (k, c); equal tuples have equal labels."""
    counted = labelled.groupBy(*columns, "k", "c").agg(F.count("*").alias("w"))
    return counted.groupBy(*columns).agg(F.max("w").alias("w"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("labels"))


def silhouette_by_k(labelled: DataFrame, columns: tuple[str, ...] = FEATURES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Mean silhouette of each k under the Gower dissimilarity; 0 for singletons and for one cluster.

    The sum of dissimilarities from a value to all members of a cluster, for all clusters of all k at once, is one wide row per
    feature and distinct value (``value_sums``). A tuple adds up the rows of its six values, and counts as often as
    there are individuals with it.
    """
    tuples = settle(weighted_labels(labelled, columns), "tuples")
    sizes = {(r.k, r.c): r.size for r in tuples.select("w", F.explode("labels").alias("l")).groupBy("l.k", "l.c").agg(
        F.sum("w").alias("size")).collect()}  # one row a cluster: k (k + 1) / 2 for k clusters
    slots = sorted(sizes)
    parts = settle(value_sums(tuples, slots, columns, bucket_rows), "value-sums")
    wide = tuples
    for f in columns:
        own = parts.filter(F.col("feature") == f).select(F.col("v").alias(f), F.col("sums").alias(f"d_{f}"))
        wide = wide.join(own, f)
    size = np.array([sizes[s] for s in slots], dtype=np.float64)
    blocks = {k: [i for i, s in enumerate(slots) if s[0] == k] for k in sorted({k for k, _ in slots})}
    numbers = {s: i for i, s in enumerate(slots)}

    def work(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            total = sum(batch.column(i).flatten().to_numpy().reshape(n, len(slots)) for i in range(2, 2 + len(columns))) / float(len(columns))
            w = batch.column(0).to_numpy().astype(np.float64)
            labels = batch.column(1).flatten()
            of = np.array([numbers[s] for s in zip(labels.field("k").to_pylist(), labels.field("c").to_pylist())]).reshape(n, len(blocks))
            out = []
            for place, (k, block) in enumerate(blocks.items()):
                own, row = of[:, place], np.arange(n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = total[row, own] / (size[own] - 1)
                    means = total / size
                    means[row, own] = np.inf
                    b = means[:, block].min(axis=1)
                    width = (b - a) / np.maximum(a, b)
                width[(size[own] == 1) | ~np.isfinite(width)] = 0.0
                out.append((k, float((w * width).sum()), float(w.sum())))
            yield pa.RecordBatch.from_pylist([{"k": k, "s": s, "n": m} for k, s, m in out], schema=schema)

    kind = labelled.schema["k"].dataType.simpleString()
    schema = pa.schema([("k", pa.int64() if kind == "bigint" else pa.int32()), ("s", pa.float64()), ("n", pa.float64())])
    rows = wide.select("w", "labels", *[f"d_{f}" for f in columns]).mapInArrow(work, f"k {kind}, s double, n double")
    return rows.groupBy("k").agg((F.sum("s") / F.sum("n")).alias("silhouette"))


# ---- squared dissimilarities ------------------------------------------------------------------------------

def _striped(tuples: DataFrame, columns: tuple[str, ...], stripe_rows: int) -> DataFrame:
    """Adds ``codes``: for each feature the stripe of its value within (k, c), or nothing where (k, c) has at most ``stripe_rows`` tuples.

    Borders are sketched quantiles of the cluster. A value that is a border has an odd number to itself, so that a value held by any number
    of tuples does not swell a stripe; the values between two borders have an even one.
    """
    sizes = settle(tuples.groupBy("k", "c").agg(F.count("*").alias("n")), "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    parts = -(-most // stripe_rows)
    if parts < 2:
        return tuples.withColumn("codes", F.array().cast("array<int>"))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    large = sizes.filter(F.col("n") > stripe_rows).withColumn("own", F.ceil(F.col("n") / stripe_rows))
    cut = tuples.join(F.broadcast(large.select("k", "c")), ["k", "c"], "left_semi").groupBy("k", "c").agg(*[
        F.percentile_approx(f, at, 1000 + 20 * parts).alias(f) for f in columns])

    def kept(borders: Column) -> Column:  # as many as the own number of stripes takes
        return F.array_distinct(F.filter(borders, lambda _, i: F.floor((i + 1) * F.col("own") / parts) > F.floor(i * F.col("own") / parts)))

    borders = settle(cut.join(large, ["k", "c"]).select("k", "c", *[kept(F.col(f)).alias(f"b_{f}") for f in columns]), "borders")

    def code(value: Column, own: str) -> Column:
        return F.size(F.filter(own, lambda b: b < value)) * 2 + F.array_contains(own, value).cast("int")

    codes = F.array(*[code(F.col(f), f"b_{f}") for f in columns])
    return tuples.join(F.broadcast(borders), ["k", "c"], "left").select(
        *tuples.columns, F.when(F.col(f"b_{columns[0]}").isNull(), F.array().cast("array<int>")).otherwise(codes).alias("codes"))


def feature_products(labelled: DataFrame, columns: tuple[str, ...] = FEATURES, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """Sum of |x_i - x_j| |y_i - y_j| over the unordered pairs of every (k, c), for each pair of features.

    A cluster of at most ``stripe_rows`` tuples is one task for each feature: two-dimensional running sums give its products with the later
    features. A larger one is cut into stripes of x and, the same way, of y. Pairs in one stripe of x come from the task of that stripe, pairs in
    one stripe of y from the task of that one, less those in both, and pairs that differ in both stripes from the sums of the cells.
    So each tuple enters two tasks for a pair of features, whatever the number of stripes.
    """
    tuples = settle(labelled.groupBy("k", "c", *columns).agg(F.count("*").alias("w")), "weighted")
    striped = settle(_striped(tuples, columns, stripe_rows), "striped")
    last, cut = len(columns) - 1, F.size("codes") > 0
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(F.get("codes", F.lit(i)), F.lit(0)).alias("code")) for i in range(last + 1)])).alias("s")
    # A border's stripe has one value of its feature, and the last feature of an uncut cluster no later one: no products.
    cells = striped.select("k", "c", "w", *columns, "codes", sides).select("k", "c", "w", *columns, "codes", "s.*").filter(
        F.when(cut, F.col("code") % 2 == 0).otherwise(F.col("side") < last))
    kinds = ", ".join(f"{f} {cells.schema[f].dataType.simpleString()}" for f in ("k", "c"))

    def named(group: pa.Table, found: dict[tuple[int, int], float]) -> pa.Table:
        one = pa.concat_tables([group.slice(0, 1).select(["k", "c"])] * len(found))
        return one.append_column("pair", pa.array([f"{columns[i]}*{columns[j]}" for i, j in found])).append_column(
            "products", pa.array(list(found.values()), pa.float64()))

    def met(group: pa.Table) -> pa.Table:
        side = group.column("side")[0].as_py()
        w, *x = (group.column(n).to_numpy().astype(np.float64) for n in ("w", *columns))
        lists = group.column("codes").combine_chunks()
        codes = lists.flatten().to_numpy().reshape(-1, last + 1) if len(lists[0]) else None
        found = {}
        for j in range(0 if codes is not None else side + 1, last + 1):
            if j == side:
                continue
            total = pair_products(x[side], x[j], w)
            if codes is not None and j > side:
                order = np.argsort(codes[:, j], kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(codes[order, j])) + 1):
                    total -= pair_products(x[side][at], x[j][at], w[at])
            found[min(side, j), max(side, j)] = total
        return named(group, found)

    inside = cells.groupBy("k", "c", "side", "code").applyInArrow(met, f"{kinds}, pair string, products double")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("codes", F.lit(i)).alias("a"), F.get("codes", F.lit(j)).alias("b"),
                 F.col(columns[i]).alias("x"), F.col(columns[j]).alias("y")) for i in range(last) for j in range(i + 1, last + 1)])).alias("p")
    w, x, y = (F.col(n) for n in ("w", "x", "y"))
    sums = striped.filter(cut).select("k", "c", "w", pairs).select("k", "c", "w", "p.*").groupBy("k", "c", "i", "j", "a", "b").agg(
        F.sum("w").cast("double").alias("n"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * y).alias("wxy"))

    def crossed(group: pa.Table) -> pa.Table:
        i, j = (group.column(n)[0].as_py() for n in ("i", "j"))
        return named(group, {(i, j): crossing_products(*[group.column(n).to_numpy() for n in ("a", "b", "n", "wx", "wy", "wxy")])})

    between = sums.groupBy("k", "c", "i", "j").applyInArrow(crossed, f"{kinds}, pair string, products double")
    return inside.unionByName(between).groupBy("k", "c", "pair").agg(F.sum("products").alias("products"))


def within_squares(labelled: DataFrame, columns: tuple[str, ...] = FEATURES, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """Per (k, c): size and the sum of squared Gower dissimilarities over its unordered pairs.

    The square expands into products of feature differences: equal features give plain sums of
    squares, different ones ``feature_products``.
    """
    same = labelled.groupBy("k", "c").agg(F.count("*").alias("size"), reduce(lambda a, b: a + b, [
        F.count("*") * F.sum(F.col(f) * F.col(f)) - F.sum(f) * F.sum(f) for f in columns]).alias("own"))
    cross = feature_products(labelled, columns, stripe_rows).groupBy("k", "c").agg(F.sum("products").alias("cross"))
    both = same.withColumn("cross", F.lit(0.0)).unionByName(
        cross.select("k", "c", F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("own"), "cross")
    )
    square = (F.sum("own") + 2 * F.sum("cross")) / F.lit(float(len(columns) ** 2))
    return both.groupBy("k", "c").agg(F.sum("size").alias("size"), square.alias("sum_d2"))


def wss_by_k(labelled: DataFrame, columns: tuple[str, ...] = FEATURES, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """Within sum of squares: over clusters, squared dissimilarities of its pairs over its size."""
    squares = within_squares(labelled, columns, stripe_rows)
    return squares.groupBy("k").agg(F.sum(F.col("sum_d2") / F.col("size")).alias("wss"))


def pair_totals(scaled: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Number of unordered pairs, and the sums of their dissimilarities and of the squares."""
    whole = scaled.withColumns({"k": F.lit(1), "c": F.lit(1)})
    sums = gower_sums(scaled, columns).agg((F.sum("sum_d") / 2).alias("sum_d"))
    n = F.col("size")
    return within_squares(whole, columns).select(
        F.floor(n * (n - 1) / 2).alias("n_pairs"), sums.scalar().alias("sum_d"), "sum_d2"
    )


# ---- projection -------------------------------------------------------------------------------------------

def jacobi(matrix: Column, size: int, sweeps: int = 10) -> Column:
    """Eigenvalues ``a`` (the diagonal of a flat matrix) and eigenvectors ``v`` (flat, by column) of a symmetric flat ``size`` x ``size`` array.

    A fixed number of cyclic sweeps of Jacobi rotations, as one fold over the rotations.
    """
    steps = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(sweeps) for p in range(size) for q in range(p + 1, size)])
    unit = F.array(*[F.lit(1.0 if i % (size + 1) == 0 else 0.0) for i in range(size * size)])

    def at(x: Column, i: Column, j: Column) -> Column:
        return F.get(x, i * size + j)

    def turned(x: Column, p: Column, q: Column, c: Column, s: Column, rows: bool) -> Column:
        def cell(v: Column, n: Column) -> Column:
            i, j = F.floor(n / size).cast("int"), n % size
            line = i if rows else j
            at_p = at(x, p, j) if rows else at(x, i, p)
            at_q = at(x, q, j) if rows else at(x, i, q)
            return F.when(line == p, c * at_p - s * at_q).when(line == q, s * at_p + c * at_q).otherwise(v)

        return F.transform(x, cell)

    def tangent(state: Column, p: Column, q: Column) -> Column:
        off = at(state["a"], p, q)
        tau = F.try_divide(at(state["a"], q, q) - at(state["a"], p, p), 2 * off)
        return let(tau, lambda u: F.coalesce(F.when(u < 0, -1.0).otherwise(1.0) / (F.abs(u) + F.sqrt(1 + u * u)), F.lit(0.0)))

    def merge(state: Column, step: Column) -> Column:
        p, q = step["p"], step["q"]

        def applied(cs: Column) -> Column:
            c, s = cs["c"], cs["s"]
            half = turned(state["a"], p, q, c, s, rows=False)
            return F.struct(let(half, lambda x: turned(x, p, q, c, s, rows=True)).alias("a"), turned(state["v"], p, q, c, s, rows=False).alias("v"))

        return let(tangent(state, p, q), lambda t: let(
            F.struct((1 / F.sqrt(1 + t * t)).alias("c"), (t / F.sqrt(1 + t * t)).alias("s")), applied))

    return F.aggregate(steps, F.struct(matrix.alias("a"), unit.alias("v")), merge)


def principal_components(z: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(component, loadings, explained): all components of standardized features, by falling variance.

    The covariance matrix is one aggregate. The sign of a component is the one that makes its largest loading positive, the first of
    equally large ones. A NULL (constant) feature counts as 0 throughout.
    """
    n = len(columns)
    filled = z.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    cov = filled.agg(F.array(*[F.covar_samp(a, b) for a in columns for b in columns]).alias("m"))
    found = settle(cov.select(jacobi(F.col("m"), n).alias("e")), "eigen")
    value = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(
        (-F.get("e.a", j * (n + 1))).alias("minus"), j.alias("j"),
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("e.v", i * n + j)).alias("raw")))
    each = found.select(F.posexplode(F.array_sort(value)).alias("place", "x"),
                        F.aggregate(value, F.lit(0.0), lambda a, x: a - x["minus"]).alias("total"))
    top = F.array_max(F.transform("x.raw", lambda w: F.abs(w)))
    lead = F.get(F.filter("x.raw", lambda w: F.abs(w) >= top - 1e-9), F.lit(0))
    return each.select((F.col("place") + 1).alias("component"),
                       F.transform("x.raw", lambda w: F.when(lead < 0, -w).otherwise(w)).alias("loadings"),
                       F.try_divide(-F.col("x.minus"), F.col("total")).alias("explained"))


def pca_scores(z: DataFrame, keep: int = 2, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """First principal component scores of standardized features."""
    all_ = one_row(principal_components(z, columns).filter(F.col("component") <= keep),
                   p=F.array_sort(F.collect_list(F.struct("component", "loadings"))))
    with_ = z.withColumn("p", all_["p"])
    return with_.select("id", *[
        reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * F.col("p")[j]["loadings"][i] for i, c in enumerate(columns)]).alias(f"pc{j + 1}")
        for j in range(keep)])


def pca_loadings(z: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Loadings and explained variance share of every component."""
    named = F.transform("loadings", lambda w, i: F.struct(F.get(F.array(*[F.lit(c) for c in columns]), i).alias("feature"), w.alias("loading")))
    rows = principal_components(z, columns).select("component", "explained", F.explode(named).alias("l"))
    return rows.select("l.feature", "component", "l.loading", "explained")


def corr_matrix(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Correlation of every pair of features in long form, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    table = features.agg(F.array(*[
        F.struct(F.lit(a).alias("f_i"), F.lit(b).alias("f_j"), F.corr(a, b).alias("corr")) for a, b in pairs
    ]).alias("pairs"))
    return table.select(F.explode("pairs").alias("p")).select("p.*")
