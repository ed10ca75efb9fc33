import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import cluster as cl
from sightline.operators import hierarchy as hy
from sightline.operators import partners as pt
from sightline.operators.fidelity import FEATURES
from sightline.operators.prefix import pair_products

K = 3


@pytest.fixture(scope="module")
def table(spark):
    """90 individuals, a third of them copies of one, one feature constant."""
    rng = np.random.default_rng(11)
    x = rng.random((90, len(FEATURES)))
    x[:30] = x[0]
    x[:, 2] = 4.0
    x[:, 5] = np.round(x[:, 5] * 3)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in FEATURES))
    span = np.ptp(x, axis=0)
    scaled = (x - x.min(axis=0)) / np.where(span == 0, 1, span)
    return df, np.abs(scaled[:, None, :] - scaled[None, :, :]).mean(axis=2)


@pytest.fixture(scope="module")
def labelled(table):
    scaled = cl.range_scale(table[0]).cache()
    labels = cl.assign_nearest(scaled, cl.quantile_centres(scaled, [1, K])).cache()
    return scaled, labels


def test_row_sums(table, labelled):
    got = {r.id: r.sum_d for r in cl.gower_sums(labelled[0]).collect()}
    assert all(got[i] == pytest.approx(s, abs=1e-9) for i, s in enumerate(table[1].sum(axis=1)))


def test_pair_totals(table, labelled):
    upper = table[1][np.triu_indices(90, 1)]
    row = cl.pair_totals(labelled[0]).first()
    assert (row.n_pairs, row.sum_d, row.sum_d2) == (4005, pytest.approx(upper.sum()), pytest.approx((upper**2).sum()))


@pytest.mark.parametrize("rows", [7, 1000])
def test_wss_and_silhouette(table, labelled, rows):
    scaled, labels = labelled
    d = table[1]
    wss = {r.k: r.wss for r in cl.wss_by_k(labels, stripe_rows=rows).collect()}
    sil = {r.k: r.silhouette for r in cl.silhouette_by_k(labels, bucket_rows=rows).collect()}
    assert wss[1] == pytest.approx((d[np.triu_indices(90, 1)] ** 2).sum() / 90) and sil[1] == 0.0
    c = np.array([r.c for r in labels.filter(F.col("k") == K).orderBy("id").collect()])
    expected, widths = 0.0, []
    for g in set(c):
        m = np.where(c == g)[0]
        expected += (d[np.ix_(m, m)] ** 2).sum() / 2 / len(m)
    for i in range(90):
        own = np.where(c == c[i])[0]
        a = d[i, own].sum() / (len(own) - 1) if len(own) > 1 else None
        b = min(d[i, c == g].mean() for g in set(c) - {c[i]})
        widths.append(0.0 if a is None else (b - a) / max(a, b))
    assert wss[K] == pytest.approx(expected)
    assert sil[K] == pytest.approx(np.mean(widths)) and -1 <= sil[K] <= 1


def test_constant_feature_scales_to_zero_and_standardizes_to_null(table):
    assert cl.range_scale(table[0]).agg(F.max(FEATURES[2])).first()[0] == 0.0
    assert cl.standardize(table[0]).filter(f"{FEATURES[2]} IS NOT NULL").count() == 0


def test_hierarchical_groups_are_ranked_by_rate(table):
    scaled = cl.range_scale(table[0]).cache()
    labels = {r.id: r.grp for r in hy.hierarchical_labels(scaled, K).collect()}
    out = scaled.join(hy.hierarchical_labels(scaled, K), "id").groupBy("grp").agg(F.avg("m_rate").alias("r")).orderBy("grp").collect()
    assert [r.grp for r in out] == [1, 2, 3] and len({labels[i] for i in range(30)}) == 1
    assert [r.r for r in out] == sorted((r.r for r in out), reverse=True)


def test_rounds_as_spark_jobs_and_in_one_task_agree(table):
    scaled = cl.range_scale(table[0]).cache()
    want = {tuple(r) for r in hy.hierarchical_labels(scaled, K).collect()}
    assert {tuple(r) for r in hy.hierarchical_labels(scaled, K, tail=25).collect()} == want


def test_separate_groups_are_found(spark):
    rng = np.random.default_rng(4)
    centre = np.array([[.1] * 6, [.5] * 6, [.9] * 6])
    x = np.concatenate([c + rng.uniform(-.05, .05, (n, 6)) for c, n in zip(centre, (20, 70, 40))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id bigint, " + ", ".join(f"{c} double" for c in FEATURES))
    got = {r.id: r.grp for r in hy.hierarchical_labels(df, 3).collect()}
    assert [got[i] for i in range(130)] == [3] * 20 + [2] * 70 + [1] * 40


def test_few_and_no_tuples(spark):
    schema = "id bigint, " + ", ".join(f"{c} double" for c in FEATURES)
    two = spark.createDataFrame([(1, *[.5] * 6), (2, *[.5] * 6), (3, *[.7] * 6)], schema)
    assert {tuple(r) for r in hy.hierarchical_labels(two, 3).collect()} == {(1, 2), (2, 2), (3, 1)}
    assert hy.hierarchical_labels(two.limit(0), 3).count() == 0


def test_pair_products():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 130, 700):
        x, y, w = np.round(rng.random(n), 2), np.round(rng.random(n), 1), rng.integers(1, 9, n).astype(float)
        want = (w[:, None] * w * np.abs(x[:, None] - x) * np.abs(y[:, None] - y)).sum() / 2
        assert pair_products(x, y, w) == pytest.approx(want)


def test_components_against_numpy(table):
    z = cl.standardize(table[0]).fillna(0.0, list(FEATURES))
    raw = np.array([tuple(r) for r in z.select(*FEATURES).collect()])
    value, vector = np.linalg.eigh(np.cov(raw.T))
    found = cl.principal_components(z).orderBy("component").collect()
    for r, v, w in zip(found, value[::-1], vector.T[::-1]):
        w = w * np.sign(w[np.abs(w).argmax()])
        assert r.explained == pytest.approx(v / value.sum(), abs=1e-9) and np.allclose(r.loadings, w, atol=1e-7)


def test_scores_reproduce_the_distances(table):
    """All components together are a rotation: they keep squared distances of the standardized data."""
    z = cl.standardize(table[0]).fillna(0.0, list(FEATURES)).cache()
    pcs = np.array([tuple(r)[1:] for r in cl.pca_scores(z, len(FEATURES)).orderBy("id").collect()])
    raw = np.array([tuple(r)[1:] for r in z.orderBy("id").select("id", *FEATURES).collect()])
    assert ((pcs[0] - pcs[50]) ** 2).sum() == pytest.approx(((raw[0] - raw[50]) ** 2).sum())


def test_products_of_stripes_equal_all_pairs(spark):
    """Clusters of several sizes, one value of a feature in half the rows, weights: stripes in both directions give all pairs' products."""
    rng = np.random.default_rng(5)
    n = 900
    x = np.round(rng.random((n, len(FEATURES))), 3)
    x[: n // 2, 0], x[:, 5] = 0.25, np.round(x[:, 5] * 4) / 4
    x = np.concatenate([x, x[:50]])
    c = np.concatenate([rng.choice(3, n, p=[0.7, 0.27, 0.03]), np.zeros(50, int)])
    df = spark.createDataFrame([(1, int(k), *map(float, v)) for k, v in zip(c, x)], "k int, c int, " + ", ".join(f"{f} double" for f in FEATURES))
    tuples = df.groupBy("k", "c", *FEATURES).agg(F.count("*").alias("w"))
    striped = cl._striped(tuples, FEATURES, 60).select("c", "span_time_rel", F.get("codes", F.lit(0)).alias("code"), F.size("codes").alias("n")).collect()
    assert {r.n for r in striped if r.c == 2} == {0} and {r.n for r in striped if r.c < 2} == {6}
    assert all(r.code % 2 == 1 for r in striped if r.n and r.span_time_rel == 0.25)  # the heavy value fills no stripe between borders
    for rows in (60, 300, 10 ** 6):
        got = {(r.c, r.pair): r.products for r in cl.feature_products(df, FEATURES, rows).collect()}
        assert len(got) == 45
        for (k, pair), products in got.items():
            a, b = (x[c == k][:, FEATURES.index(f)] for f in pair.split("*"))
            assert products == pytest.approx((np.abs(a[:, None] - a) * np.abs(b[:, None] - b)).sum() / 2, rel=1e-9)


def test_pair_products_memory_does_not_grow_with_its_squares():
    rng = np.random.default_rng(9)
    x, y = rng.random(60_000), rng.random(60_000)
    tracemalloc.start()
    pair_products(x, y, np.ones(60_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 * 60_000  # 1300 bytes a row with all squares of the first step at once


def test_neighbours_of_all_features_in_one_table(spark):
    """Ties go by the cluster number, and ranges pass their outermost clusters on: each order has every step once."""
    rng = np.random.default_rng(3)
    x = np.round(rng.random((60, len(FEATURES))), 1)
    df = spark.createDataFrame([(i, 1.0, *map(float, v)) for i, v in enumerate(x)], "cluster bigint, w double, " + ", ".join(f"{f} double" for f in FEATURES))
    got = sorted((r.a.cluster, r.b.cluster) for r in hy._adjacent(df, FEATURES, 5).collect())
    orders = [np.lexsort((np.arange(60), v)).tolist() for v in x.T]
    assert got == sorted(step for line in orders for step in zip(line, line[1:]))


def _all_pairs(number, w, f):
    """(cost, number of the partner) of each cluster from the costs of all pairs."""
    gower = sum(np.abs(x[:, None] - x) for x in f) / float(len(f))
    cost = w[:, None] * w / (w[:, None] + w) * (gower * gower)
    np.fill_diagonal(cost, np.inf)
    least = cost.min(axis=1)
    return least, np.where(cost == least[:, None], number, np.iinfo(np.int64).max).min(axis=1)


def _tree(number, w, f, k):
    """The cluster of each row when all pairs are candidates in each round."""
    at, w, f = {n: n for n in number}, dict(zip(number, w)), dict(zip(number, f.T))
    while len(w) > k:
        live = np.array(sorted(w))
        cost, partner = _all_pairs(live, np.array([w[n] for n in live]), np.array([f[n] for n in live]).T)
        name = dict(zip(live, partner))
        edges = sorted((c, a, b) for c, a, b in zip(cost, live, partner) if a < b and name[b] == a)[:len(w) - k]
        for _, a, b in edges:
            f[a] = (w[a] * f[a] + w[b] * f[b]) / (w[a] + w[b])
            w[a] += w.pop(b)
            at = {n: a if c == b else c for n, c in at.items()}
    return [at[n] for n in number]


def _clusters(seed, n, digits):
    """Tuples with some far off and some heavy; few digits give many equal costs."""
    rng = np.random.default_rng(seed)
    x = np.unique(np.round(rng.random((n, len(FEATURES))) ** 2, digits), axis=0)
    x[-1] = 3.0
    number, w = rng.permutation(10 * len(x))[:len(x)], np.where(rng.random(len(x)) < 0.1, rng.integers(2, 900, len(x)), 1).astype(float)
    return number, w, np.ascontiguousarray(x.T)


@pytest.mark.parametrize("digits", [1, 6])
def test_partner_is_the_cheapest_of_all_clusters(digits):
    for seed, n in enumerate((2, 3, 31, 700, 2000)):
        number, w, f = _clusters(seed, n, digits)
        cost, partner = pt.cheapest_partners(number, w, f)
        least, who = _all_pairs(number, w, f)
        assert (cost == least).all() and (partner == who).all()


def test_a_pair_that_no_feature_puts_side_by_side_merges():
    """Clusters 0 and 1 are cheapest to each other, but in the order of each feature another stands between them."""
    x = np.full((8, 6), 0.4)
    x[1] = 0.402
    for i in range(6):
        x[2 + i] = np.arange(6) / 5 > (i / 5)
        x[2 + i, i] = 0.401
    number, w = np.arange(8), np.ones(8)
    f = np.ascontiguousarray(x.T)
    assert all(abs(r[0] - r[1]) > 1 for r in np.argsort(np.argsort(f, axis=1, kind="stable"), axis=1)[:, :2])
    got = hy.merged_rows(number, w, f, 7)
    assert got.tolist() == [0, 0, 2, 3, 4, 5, 6, 7] == _tree(number, w, f, 7)


@pytest.mark.parametrize("digits", [1, 6])
def test_groups_in_one_task_are_those_of_all_pairs(digits):
    number, w, f = _clusters(7, 300, digits)
    assert hy.merged_rows(number, w, f, 3).tolist() == _tree(number, w, f, 3)


def test_partners_across_blocks(spark, monkeypatch):
    """Small blocks, borders from some rows only, asks in several pieces: still the cheapest of all."""
    monkeypatch.setattr(hy, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hy, "BORDER_ROWS", 320)
    monkeypatch.setattr(hy, "ASK_ROWS", 7)
    number, w, f = _clusters(5, 400, 1)
    rows = [(int(n), float(v), *map(float, x)) for n, v, x in zip(number, w, f.T)]
    df = spark.createDataFrame(rows, "cluster bigint, w double, " + ", ".join(f"{c} double" for c in FEATURES))
    got = sorted((r.cluster, r.w, r.cost, r.partner, *[r[c] for c in FEATURES]) for r in hy.cheapest(df, len(rows)).collect())
    cost, partner = _all_pairs(number, w, f)
    assert got == sorted((n, v, c, p, *x) for (n, v, *x), c, p in zip(rows, cost.tolist(), partner.tolist()))


def test_groups_of_rounds_as_spark_jobs_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hy, "BLOCK_ROWS", 30)
    number, w, f = _clusters(3, 150, 6)
    rows = [(int(n), float(v), *map(float, x)) for n, v, x in zip(number, w, f.T)]
    df = spark.createDataFrame(rows, "cluster bigint, w double, " + ", ".join(f"{c} double" for c in FEATURES))
    got = {r.member: r.cluster for r in hy.agglomerate(df, 3, tail=90).collect()}
    assert [got[n] for n in number] == _tree(number, w, f, 3)


def test_an_individual_without_a_number_has_a_group(spark):
    schema = "id bigint, " + ", ".join(f"{c} double" for c in FEATURES)
    df = spark.createDataFrame([(1, *[.1] * 6), (2, *[.2] * 6), (3, *[.7] * 6), (None, *[.9] * 6)], schema)
    assert {tuple(r) for r in hy.hierarchical_labels(df, 3).collect()} == {(None, 1), (3, 2), (1, 3), (2, 3)}
