"""Clustering and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import cluster as cl
from sightline.operators import hierarchy as hy
from sightline.operators.fidelity import FEATURES, fidelity_features
from sightline.plans import views  # noqa: F401  (oracle views)
from sightline.plans.registry import q, query, r, view
from sightline.session import settle
from sightline.sources import fixtures as fx

K_MAX = 10
K_STUDY = 3


def _features(spark, sf):
    """The features, written once: range and quantile passes precede every use of them."""
    return settle(fidelity_features(fx.sighting_days(spark, sf)), "features")


def _scaled(spark, sf):
    return settle(cl.range_scale(_features(spark, sf)), "scaled")


def _labelled(spark, sf, ks):
    scaled = _scaled(spark, sf)
    centres = settle(cl.quantile_centres(scaled, ks), "centres")
    return cl.assign_nearest(scaled, centres)


# ---- oracle views ---------------------------------------------------------------------------------

view("scaled", "SELECT id, " + ", ".join(
    f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) AS {c}" for c in FEATURES
) + " FROM features", "features")
_D = "(" + " + ".join(f"abs(a.{c} - b.{c})" for c in FEATURES) + ") / CAST(6 AS DOUBLE)"
view("pairs", f"SELECT a.id AS i, b.id AS j, {_D} AS d FROM scaled a JOIN scaled b ON a.id <> b.id", "scaled")
view("centres", " UNION ALL ".join(
    f"SELECT {k} AS k, {j} AS c, " + ", ".join(f"round(quantile_cont({f}, {(j - 0.5) / k!r}), 9) AS {f}" for f in FEATURES)
    + " FROM scaled" for k in range(1, K_MAX + 1) for j in range(1, k + 1)), "scaled")
view("labels", f"""
    SELECT id, k, c, d FROM (
      SELECT a.id, b.k, b.c, round({_D}, 9) AS d,
             row_number() OVER (PARTITION BY a.id, b.k ORDER BY round({_D}, 9), b.c) AS rn
      FROM scaled a, centres b) WHERE rn = 1""", "scaled centres")
view("tuples", f"SELECT min(id) AS cluster, CAST(count(*) AS DOUBLE) AS w, {', '.join(FEATURES)} FROM scaled GROUP BY ALL", "scaled")
view("labels3", f"SELECT id, c, d FROM labels WHERE k = {K_STUDY}", "labels")


# ---- queries ------------------------------------------------------------------------------------------

@query("fn_std", f"SELECT id, {q('(sights - avg(sights) OVER ()) / stddev_samp(sights) OVER ()')} AS sights FROM features",
       "features")
def fn_std(spark, sf):
    z = cl.standardize(_features(spark, sf).select("id", "sights"), ("sights",))
    return z.withColumn("sights", r("sights"))


@query("standardize", "SELECT id, " + ", ".join(
    f"{q(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS {c}" for c in FEATURES) + " FROM features", "features")
def standardize(spark, sf):
    return cl.standardize(_features(spark, sf)).select("id", *[r(c).alias(c) for c in FEATURES])


@query("gower_pairs", f"SELECT i AS id, {q('sum(d)')} AS sum_d, {q('avg(d)')} AS mean_d FROM pairs GROUP BY i", "pairs")
def gower_pairs(spark, sf):
    """Row sums of the dissimilarity matrix, without its pairs."""
    scaled = _scaled(spark, sf)
    others = cl.one_row(scaled, n=F.count("*") - 1)
    out = cl.gower_sums(scaled)
    return out.select("id", r("sum_d").alias("sum_d"), r(F.try_divide(F.col("sum_d"), others["n"].cast("double"))).alias("mean_d"))


@query("pair_join", f"SELECT count(*) AS n_pairs, {q('sum(d)', 3)} AS sum_d, {q('sum(d * d)', 3)} AS sum_d2 FROM pairs WHERE i < j",
       "pairs")
def pair_join(spark, sf):
    """Totals over all unordered pairs, without the pairs."""
    out = cl.pair_totals(_scaled(spark, sf))
    return out.select("n_pairs", r("sum_d", 3).alias("sum_d"), r("sum_d2", 3).alias("sum_d2"))


@query("wss_by_k", f"""
    SELECT k, {q('sum(ss / size)', 5)} AS wss FROM (
      SELECT n.k, n.c, n.size, coalesce(m.ss, 0) AS ss FROM (SELECT k, c, count(*) AS size FROM labels GROUP BY 1, 2) n
      LEFT JOIN (SELECT x.k, x.c, sum(p.d * p.d) AS ss FROM pairs p JOIN labels x ON x.id = p.i
                 JOIN labels y ON y.id = p.j AND y.k = x.k AND y.c = x.c WHERE p.i < p.j GROUP BY 1, 2) m
        ON m.k = n.k AND m.c = n.c) GROUP BY k""", "pairs labels")
def wss_by_k(spark, sf):
    scaled = _scaled(spark, sf)
    centres = settle(cl.quantile_centres(scaled, list(range(1, K_MAX + 1))), "centres")
    labelled = settle(cl.assign_nearest(scaled, centres), "labels")
    return cl.wss_by_k(labelled).withColumn("wss", r("wss", 5))


@query("silhouette_by_k", f"""
    SELECT k, {q('avg(CASE WHEN own_n = 1 OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END)')} AS silhouette
    FROM (SELECT l.k, l.id, n.size AS own_n, m.a, m.b FROM labels l
          JOIN (SELECT k, c, count(*) AS size FROM labels GROUP BY 1, 2) n ON n.k = l.k AND n.c = l.c
          JOIN (SELECT k, i, max(CASE WHEN own THEN mean_d END) AS a, min(CASE WHEN NOT own THEN mean_d END) AS b FROM (
                  SELECT x.k, p.i, x.c = y.c AS own, y.c AS cj, avg(p.d) AS mean_d FROM pairs p
                  JOIN labels x ON x.id = p.i JOIN labels y ON y.id = p.j AND y.k = x.k GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) m
            ON m.k = l.k AND m.i = l.id) GROUP BY k""", "pairs labels")
def silhouette_by_k(spark, sf):
    labelled = settle(_labelled(spark, sf, list(range(1, K_MAX + 1))), "labels")
    return cl.silhouette_by_k(labelled).withColumn("silhouette", r("silhouette"))


@query("assign_nearest", f"SELECT id, c, {q('d')} AS d FROM labels3", "labels3")
def assign_nearest(spark, sf):
    return _labelled(spark, sf, [K_STUDY]).select("id", "c", r("d").alias("d"))


@query("lloyd_step", "SELECT l.c, count(*) AS size, " + ", ".join(f"{q(f'avg({c})')} AS {c}" for c in FEATURES) + """
    FROM labels3 l JOIN scaled s ON s.id = l.id GROUP BY l.c""", "labels3 scaled")
def lloyd_step(spark, sf):
    return cl.centre_means(_labelled(spark, sf, [K_STUDY])).select("c", "size", *[r(c).alias(c) for c in FEATURES])


@query("label_sightings", "SELECT s.id, s.sdate, l.c AS grp FROM sightings s JOIN labels3 l ON l.id = s.id", "sightings labels3")
def label_sightings(spark, sf):
    labels = _labelled(spark, sf, [K_STUDY]).select("id", F.col("c").alias("grp"))
    return fx.sighting_days(spark, sf).join(labels, "id")


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS f_i, '{b}' AS f_j, {q(f'corr({a}, {b})')} AS corr FROM features"
    for i, a in enumerate(FEATURES) for b in FEATURES[i:]), "features")
def corr_matrix(spark, sf):
    return cl.corr_matrix(_features(spark, sf)).withColumn("corr", r("corr"))


_C = ", ".join(FEATURES)
_COST = f"x.w * y.w / (x.w + y.w) * (({' + '.join(f'abs(x.{c} - y.{c})' for c in FEATURES)}) / CAST(6 AS DOUBLE)) ** 2"


@query("cluster_labels", f"""
    , merges AS (
      SELECT 0 AS round, cluster AS member, cluster, w, {_C} FROM tuples
      UNION ALL (
        WITH c AS (SELECT DISTINCT cluster, w, {_C} FROM merges),
        d AS (SELECT x.cluster AS lo, y.cluster AS hi, {_COST} AS cost FROM c x JOIN c y ON x.cluster < y.cluster),
        best AS (SELECT lo, hi, cost FROM (SELECT lo AS e, lo, hi, cost FROM d UNION ALL SELECT hi, lo, hi, cost FROM d)
                 QUALIFY row_number() OVER (PARTITION BY e ORDER BY cost, lo, hi) = 1),
        mutual AS (SELECT lo, hi, cost FROM best GROUP BY ALL HAVING count(*) = 2),
        chosen AS (SELECT lo, hi FROM mutual
                   QUALIFY row_number() OVER (ORDER BY cost, lo, hi) <= (SELECT count(*) FROM c) - {K_STUDY}),
        made AS (SELECT lo, hi, x.w + y.w AS w, {', '.join(f'(x.w * x.{c} + y.w * y.{c}) / (x.w + y.w) AS {c}' for c in FEATURES)}
                 FROM chosen JOIN c x ON x.cluster = lo JOIN c y ON y.cluster = hi),
        named AS (SELECT lo AS e, * FROM made UNION ALL SELECT hi, * FROM made)
        SELECT s.round + 1, s.member, coalesce(n.lo, s.cluster), coalesce(n.w, s.w), {', '.join(f'coalesce(n.{c}, s.{c})' for c in FEATURES)}
        FROM merges s LEFT JOIN named n ON n.e = s.cluster WHERE (SELECT count(*) FROM c) > {K_STUDY})),
    last AS (SELECT member, cluster FROM merges WHERE round = (SELECT max(round) FROM merges)),
    ranks AS (SELECT cluster, row_number() OVER (ORDER BY round(sum(w * m_rate) / sum(w), 9) DESC, cluster) AS grp
              FROM last JOIN (SELECT cluster AS member, w, m_rate FROM tuples) USING (member) GROUP BY cluster)
    SELECT s.id, CAST(r.grp AS INT) AS grp FROM scaled s JOIN tuples t USING ({_C}) JOIN last l ON l.member = t.cluster
    JOIN ranks r ON r.cluster = l.cluster""", "scaled tuples")
def cluster_labels(spark, sf):
    """Hierarchical groups under the Gower dissimilarity with the Ward criterion, from weighted distinct tuples; all others are candidates."""
    return hy.hierarchical_labels(_scaled(spark, sf), K_STUDY)


# Jacobi rotations on the correlation matrix, one a step, over the pairs of features in turn.
_N, _SWEEPS = len(FEATURES), 10
_PQ = [(p, q) for p in range(_N) for q in range(p + 1, _N)]
view("z", "SELECT id, " + ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 0) AS {c}" for c in FEATURES) + " FROM features",
     "features")
_TURN = "list_transform(range({n}), lambda i: CASE {line} WHEN p THEN c * {x}[{at_p} + 1] - s * {x}[{at_q} + 1] WHEN q THEN s * {x}[{at_p} + 1] + c * {x}[{at_q} + 1] ELSE {x}[i + 1] END)"
_COLS = dict(n=_N * _N, line=f"i % {_N}", at_p=f"(i // {_N}) * {_N} + p", at_q=f"(i // {_N}) * {_N} + q")
_ROWS = dict(n=_N * _N, line=f"i // {_N}", at_p=f"p * {_N} + i % {_N}", at_q=f"q * {_N} + i % {_N}")
_PCA = f"""
    , pq AS (SELECT row_number() OVER () - 1 AS j, p, q FROM (VALUES {', '.join(str(x) for x in _PQ)}) AS v(p, q)),
    spin AS (
      SELECT CAST(0 AS BIGINT) AS step, [{', '.join(f'covar_samp({a}, {b})' for a in FEATURES for b in FEATURES)}] AS a,
             [{', '.join(f'CAST({1 if i % (_N + 1) == 0 else 0} AS DOUBLE)' for i in range(_N * _N))}] AS v FROM z
      UNION ALL
      SELECT step + 1, {_TURN.format(x='a1', **_ROWS)}, v1 FROM (
        SELECT *, {_TURN.format(x='a', **_COLS)} AS a1, {_TURN.format(x='v', **_COLS)} AS v1 FROM (
          SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (
            SELECT step, a, v, p, q, CASE WHEN a[p * {_N} + q + 1] = 0 THEN 0 ELSE
              CASE WHEN tau < 0 THEN -1 ELSE 1 END / (abs(tau) + sqrt(1 + tau * tau)) END AS t FROM (
              SELECT step, a, v, p, q, (a[q * {_N + 1} + 1] - a[p * {_N + 1} + 1]) / nullif(2 * a[p * {_N} + q + 1], 0) AS tau
              FROM spin JOIN pq ON pq.j = step % {len(_PQ)} WHERE step < {_SWEEPS * len(_PQ)}))))),
    eigen AS (SELECT j, a[j * {_N + 1} + 1] AS value, list_transform(range({_N}), lambda i: v[i * {_N} + j + 1]) AS raw
      FROM spin, (SELECT range AS j FROM range({_N})) WHERE step = {_SWEEPS * len(_PQ)}),
    pcs AS (SELECT row_number() OVER (ORDER BY value DESC, j) AS component, value / sum(value) OVER () AS explained,
      CASE WHEN list_filter(raw, lambda w: abs(w) >= list_max(list_transform(raw, lambda u: abs(u))) - 1e-9)[1] < 0
           THEN list_transform(raw, lambda w: -w) ELSE raw END AS loadings FROM eigen)"""


def _score_sql(keep: int) -> str:
    return _PCA + " SELECT id, " + ", ".join(
        q(" + ".join(f"z.{c} * (SELECT loadings[{i + 1}] FROM pcs WHERE component = {j + 1})" for i, c in enumerate(FEATURES))) + f" AS pc{j + 1}"
        for j in range(keep)) + " FROM z"


def _scores(spark, sf, keep):
    out = cl.pca_scores(settle(cl.standardize(_features(spark, sf)), "standardized"), keep)
    return out.select("id", *[r(f"pc{j + 1}").alias(f"pc{j + 1}") for j in range(keep)])


@query("pca_scores", _score_sql(_N), "z")
def pca_scores(spark, sf):
    return _scores(spark, sf, _N)


@query("top_components", _score_sql(2), "z")
def top_components(spark, sf):
    return _scores(spark, sf, 2)


@query("pca_loadings", _PCA + f"""
    SELECT unnest([{', '.join(repr(c) for c in FEATURES)}]) AS feature, CAST(component AS INT) AS component,
           unnest(list_transform(loadings, lambda w: {q('w')})) AS loading, {q('explained')} AS explained FROM pcs""", "z")
def pca_loadings(spark, sf):
    out = cl.pca_loadings(settle(cl.standardize(_features(spark, sf)), "standardized"))
    return out.select("feature", "component", r("loading").alias("loading"), r("explained").alias("explained"))
