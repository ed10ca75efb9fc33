"""Capture-recapture queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.normal import norm_quantile
from sightline.functions.scalar import one_row
from sightline.operators import abundance as ab
from sightline.operators import capture as cap
from sightline.operators import counts as ct
from sightline.operators import fidelity, gof, models
from sightline.plans import views  # noqa: F401  (oracle views)
from sightline.plans.registry import q, query, r, view
from sightline.session import settle
from sightline.sources import fixtures as fx

BUCKETS = fx.JACKKNIFE_BUCKETS
Z95 = norm_quantile(1 - 0.05 / 2)


# ---- oracle views -------------------------------------------------------------------------------

def _count_views(name: str, source: str, by: str, needs: str) -> None:
    """links_<name> and counts_<name>: naive form, with z by an explicit range join."""
    keys = f"{by}, " if by else ""
    view(f"links_{name}", f"""
        SELECT *, lag(t) OVER w AS prev, lead(t) OVER w AS nxt FROM ({source}) s
        WINDOW w AS (PARTITION BY {keys}id ORDER BY t)""", needs)
    on = " AND ".join(f"g.{k} = {{0}}.{k}" for k in [*(by.split(", ") if by else []), "t"])
    grid = (f"SELECT * FROM (SELECT DISTINCT {by} FROM links_{name}) a CROSS JOIN (SELECT DISTINCT t FROM links_{name}) b"
            if by else f"SELECT DISTINCT t FROM links_{name}")
    out = ", ".join(f"g.{k}" for k in [*(by.split(", ") if by else []), "t"])
    lkeys = "".join(f"l.{k}, " for k in by.split(", ")) if by else ""
    view(f"counts_{name}", f"""
        SELECT {out}, coalesce(c.n, 0) AS n, coalesce(c.u, 0) AS u, coalesce(c.m, 0) AS m,
               coalesce(c.r, 0) AS r, coalesce(c.s, 0) AS s, coalesce(z.z, 0) AS z
        FROM ({grid}) g
        LEFT JOIN (SELECT {keys}t, count(*) AS n, count(*) FILTER (prev IS NULL) AS u,
                          count(*) FILTER (prev IS NOT NULL) AS m, count(*) FILTER (nxt IS NOT NULL) AS r,
                          count(*) FILTER (prev IS NOT NULL AND nxt IS NOT NULL) AS s
                   FROM links_{name} GROUP BY {keys}t) c ON {on.format('c')}
        LEFT JOIN (SELECT {lkeys}o.t, count(*) AS z FROM links_{name} l
                   JOIN (SELECT DISTINCT t FROM links_{name}) o ON l.t < o.t AND o.t < l.nxt
                   GROUP BY {lkeys}o.t) z ON {on.format('z')}""", f"links_{name}")
    part = f"PARTITION BY {by} " if by else ""
    view(f"js_{name}", f"""
        SELECT *, lead(n_hat) OVER w - phi * n_hat AS b FROM (
          SELECT *, m / m_hat AS p, lead(m_hat) OVER w / (m_hat - m + n) AS phi, (n + 1) * m_hat / (m + 1) AS n_hat FROM (
            SELECT *, CASE WHEN t > min(t) OVER a AND t < max(t) OVER a
                           THEN m + (n + 1) * CAST(z AS DOUBLE) / (r + 1) END AS m_hat
            FROM counts_{name} WINDOW a AS ({part})) WINDOW w AS ({part}ORDER BY t)) WINDOW w AS ({part}ORDER BY t)""",
         f"counts_{name}")
    if "grp" in by:
        view(f"gross_{name}", f"""
            SELECT {by}, sum(CASE WHEN t = 2 THEN n_hat END) + coalesce(sum(CASE WHEN t BETWEEN 2 AND k - 3 THEN
                     b * CASE WHEN phi = 1 THEN 1 WHEN phi > 0 THEN ln(phi) / (phi - 1) END END), 0) AS n_gross
            FROM (SELECT *, (SELECT max(t) FROM counts_{name}) AS k FROM js_{name}) GROUP BY {by}""", f"js_{name}")


_REPLICATES = f"SELECT b.rep, c.* FROM {{}} c JOIN (SELECT range AS rep FROM range({BUCKETS})) b ON c.id % {BUCKETS} <> b.rep"
_count_views("all", "SELECT id, t FROM captures", "", "captures")
_count_views("wm", "SELECT * FROM captures_wm", "", "captures_wm")
_count_views("grp", "SELECT * FROM captures_wm", "grp", "captures_wm")
_count_views("rep", _REPLICATES.format("captures_wm"), "rep, grp", "captures_wm")
_count_views("month", "SELECT * FROM captures_wm_month", "", "captures_wm_month")
_count_views("monthrep", _REPLICATES.format("captures_wm_month"), "rep", "captures_wm_month")

view("jack_cov", f"""
    SELECT a.grp AS g_i, b.grp AS g_j, covar_pop(a.n_gross, b.n_gross) * {BUCKETS - 1} AS cov
    FROM gross_rep a JOIN gross_rep b ON a.rep = b.rep GROUP BY 1, 2""", "gross_rep")
view("gross_se", """
    SELECT g.grp, g.n_gross, sqrt(c.cov) AS se FROM gross_grp g JOIN jack_cov c ON c.g_i = g.grp AND c.g_j = g.grp""",
     "gross_grp jack_cov")
view("total_se", """
    SELECT (SELECT sum(n_gross) FROM gross_grp) AS n_gross, (SELECT sqrt(sum(cov)) FROM jack_cov) AS se""",
     "gross_grp jack_cov")


# ---- builders -----------------------------------------------------------------------------------

def _links(spark, sf, by=(), period="quarter", marks=("WM",)):
    """Link counts over ``by``, written once: the single pass over the captures."""
    caps = fx.captures(spark, sf, marks=marks, period=period).withColumn("bucket", F.pmod("id", F.lit(BUCKETS)).cast("int"))
    return settle(cap.link_counts(caps, list(by)), "links")


def _ranked_links(spark, sf):
    """Link counts over ranked occasions, as the tests of fit ask for."""
    return settle(cap.link_counts(cap.rank_occasions(fx.captures(spark, sf))), "links")


def _counts(spark, sf):
    return cap.full_counts(_links(spark, sf))


def _group_counts(spark, sf):
    return cap.full_counts(_links(spark, sf, ["grp"]), ["grp"])


def _gross_of(links):
    grouped = cap.narrow(links, ["grp"]) if "bucket" in links.columns else links
    return ab.gross_total(ab.jolly_seber(cap.full_counts(grouped, ["grp"]), ["grp"]), ["grp"])


def _covariance_of(links):
    reps = ab.jackknife_counts(cap.full_counts(links, ["grp", "bucket"]), ["grp"], BUCKETS)
    keys = ["grp", "bucket"]
    gross = settle(ab.gross_total(ab.jolly_seber(reps, keys), keys), "replicates")
    return ab.jackknife_covariance(gross, "grp", "n_gross", BUCKETS)


def _with_se(spark, sf):
    """Gross totals with standard errors: by group, and the sum over groups."""
    links = _links(spark, sf, ["grp", "bucket"])
    gross, cov = settle(_gross_of(links), "gross"), settle(_covariance_of(links), "covariance")
    return ab.with_group_se(gross, cov), ab.total_with_covariance(gross, cov)


def _abundance(spark, sf, captures, years):
    """Estimates at ranked occasions, corrected by the mark rate of the year that ``years`` reads from their period."""
    links = settle(cap.link_counts(captures, ["bucket"]), "links")
    est = ab.jolly_seber(cap.full_counts(cap.narrow(links))).filter("n_hat IS NOT NULL").select("t", "n_hat")
    reps = ab.jackknife_counts(cap.full_counts(links, ["bucket"]), [], BUCKETS)
    se = ab.jolly_seber(reps, ["bucket"]).groupBy("t").agg(F.sqrt(F.var_pop("n_hat") * F.lit(float(BUCKETS - 1))).alias("se"))
    yearly = ct.distinct_individuals(fx.sightings(spark, sf)).filter("m IS NULL AND y IS NOT NULL")
    dated = captures.select("t", "period").distinct().withColumn("y", (years(F.col("period")) + fx.FIRST_YEAR).cast("int"))
    joined = est.join(se, "t").join(dated, "t").join(yearly.select("y", "n", "theta"), "y")
    return ab.mark_rate_correct(joined, "n_hat", "se", F.col("theta"), F.col("n"))


# ---- histories and counts -------------------------------------------------------------------------

@query("resight_links", "SELECT id, t, prev, nxt AS next FROM links_wm", "links_wm")
def resight_links(spark, sf):
    return cap.resight_links(fx.captures(spark, sf)).select("id", "t", "prev", "next")


@query("capture_history", """
    SELECT i.id, i.grp, string_agg(CASE WHEN c.id IS NULL THEN '0' ELSE '1' END, '' ORDER BY o.t) AS ch
    FROM (SELECT DISTINCT id, grp FROM captures_wm) i CROSS JOIN (SELECT DISTINCT t FROM captures_wm) o
    LEFT JOIN captures_wm c ON c.id = i.id AND c.t = o.t GROUP BY 1, 2""", "captures_wm")
def capture_history(spark, sf):
    return cap.capture_history(fx.captures(spark, sf))


@query("pivot_history", "SELECT id, grp, " + ", ".join(
    f"CAST(max(CASE WHEN t = {t} THEN 1 ELSE 0 END) AS INT) AS t{t:02d}" for t in range(1, 28)
) + " FROM captures_wm GROUP BY id, grp", "captures_wm")
def pivot_history(spark, sf):
    captures = fx.captures(spark, sf)
    # One row for each period of the calendar.
    seen = sorted(row.t for row in captures.select("t").distinct().collect())
    return cap.pivot_history(captures, seen)


@query("occasion_counts", "SELECT t, n, u, m, r FROM counts_wm", "counts_wm")
def occasion_counts(spark, sf):
    return cap.occasion_counts(_links(spark, sf)).select("t", "n", "u", "m", "r")


@query("between_counts", "SELECT t, z FROM counts_wm", "counts_wm")
def between_counts(spark, sf):
    return _counts(spark, sf).select("t", "z")


@query("m_array", "SELECT t, nxt AS next, count(*) AS n FROM links_wm GROUP BY 1, 2", "links_wm")
def m_array(spark, sf):
    return cap.m_array(_links(spark, sf))


# ---- goodness of fit ---------------------------------------------------------------------------------

def _chi(cells: str) -> str:
    margins = "(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d))"
    return f"""SELECT t, a, b, c, d,
        CASE WHEN {margins} > 0 THEN (a + b + c + d) * power(CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c, 2) / {margins}
             ELSE 0.0 END AS chi2, CAST(CASE WHEN {margins} > 0 THEN 1 ELSE 0 END AS BIGINT) AS dof FROM ({cells})"""


def _four(cells: dict[str, str], source: str, t: str = "t") -> str:
    return f"SELECT {t} AS t, " + ", ".join(f"count(*) FILTER ({w}) AS {k}" for k, w in cells.items()) + \
        f" FROM {source} GROUP BY {t}"


_ALIVE = """(SELECT t, 1 AS seen, nxt - t AS delay FROM links_{0} WHERE nxt IS NOT NULL
    UNION ALL SELECT o.t, 0, l.nxt - o.t FROM links_{0} l JOIN (SELECT DISTINCT t FROM links_{0}) o ON l.t < o.t AND o.t < l.nxt)"""


def _gof_sql(name: str) -> dict[str, str]:
    alive, links = _ALIVE.format(name), f"links_{name}"
    before, later = "prev IS NOT NULL", "nxt IS NOT NULL"
    soon = "nxt = t + 1"
    return {
        "3sr": _chi(_four({"a": f"{before} AND {later}", "b": f"{before} AND nxt IS NULL",
                           "c": f"prev IS NULL AND {later}", "d": "prev IS NULL AND nxt IS NULL"}, links)),
        "3sm": _chi(_four({"a": f"{before} AND {soon}", "b": f"{before} AND nxt > t + 1",
                           "c": f"prev IS NULL AND {soon}", "d": "prev IS NULL AND nxt > t + 1"},
                          f"(SELECT * FROM {links} WHERE {later})")),
        "2ct": _chi(_four({"a": "seen = 1 AND delay = 1", "b": "seen = 1 AND delay > 1",
                           "c": "seen = 0 AND delay = 1", "d": "seen = 0 AND delay > 1"}, alive)),
        "2cl": _chi(_four({"a": "seen = 1 AND delay = 2", "b": "seen = 1 AND delay > 2",
                           "c": "seen = 0 AND delay = 2", "d": "seen = 0 AND delay > 2"}, alive)),
    }


_GOF = _gof_sql("wm")


def _register_gof(name):
    sql = f"SELECT t, a, b, c, d, {q('chi2')} AS chi2, dof FROM ({_GOF[name]}) WHERE a + b + c + d > 0"

    @query(f"gof_test{name}", sql, "links_wm")
    def gof_test(spark, sf):
        tables = gof.gof_tables(_ranked_links(spark, sf)).filter((F.col("test") == name) & (F.expr("a + b + c + d") > 0))
        return tables.drop("test").withColumn("chi2", r("chi2"))


for _name in gof.TESTS:
    _register_gof(_name)

_GOF_ALL = " UNION ALL ".join(
    f"SELECT '{k}' AS test, sum(chi2) AS chi2, CAST(sum(dof) AS BIGINT) AS dof FROM ({s})" for k, s in _GOF.items())
view("gof_all", _GOF_ALL, "links_wm")


@query("gof_summary", f"SELECT test, {q('chi2')} AS chi2, dof FROM gof_all", "gof_all")
def gof_summary(spark, sf):
    return gof.gof_summary(_ranked_links(spark, sf)).select("test", r("chi2").alias("chi2"), "dof")


@query("c_hat", f"""
    SELECT {q('sum(chi2)')} AS chi2, CAST(sum(dof) AS BIGINT) AS dof, {q('sum(chi2) / sum(dof)')} AS c_hat FROM gof_all""",
       "gof_all")
def c_hat(spark, sf):
    return gof.c_hat(_ranked_links(spark, sf)).select(r("chi2").alias("chi2"), "dof", r("c_hat").alias("c_hat"))


# ---- abundance -------------------------------------------------------------------------------------

_EST = ("m_hat", "n_hat", "phi", "b", "p")


@query("jolly_seber", "SELECT t, n, m, r, z, " + ", ".join(f"{q(c)} AS {c}" for c in _EST) + " FROM js_wm", "js_wm")
def jolly_seber(spark, sf):
    est = ab.jolly_seber(_counts(spark, sf))
    return est.select("t", "n", "m", "r", "z", *[r(c).alias(c) for c in _EST])


def _gapped(spark, sf):
    """Captures without the quarters that 5 divides, numbered by rank of the sampled quarters."""
    return cap.rank_occasions(fx.captures(spark, sf).filter("t % 5 <> 0"))


view("captures_gapped", """
    SELECT id, grp, CAST(dense_rank() OVER (ORDER BY t) AS INTEGER) AS t, t AS period FROM captures_wm WHERE t % 5 <> 0""", "captures_wm")
view("captures_skipping", "SELECT id, grp, t + 100 AS t FROM captures_wm WHERE t % 5 <> 0", "captures_wm")
_count_views("gapped", "SELECT id, t FROM captures_gapped", "", "captures_gapped")
_count_views("gappedgrp", "SELECT id, grp, t FROM captures_gapped", "grp", "captures_gapped")
_count_views("skipping", "SELECT * FROM captures_skipping", "grp", "captures_skipping")
_UNIT = "CASE WHEN phi >= 0 THEN power(phi, 1.0 / gap) END"


@query("jolly_seber_intervals", f"""
    SELECT t, period, gap, n, m, r, z, {q('phi')} AS phi, {q(_UNIT)} AS phi_unit FROM js_gapped JOIN (
      SELECT t, period, lead(period) OVER (ORDER BY t) - period AS gap FROM (SELECT DISTINCT t, period FROM captures_gapped)) USING (t)""",
       "js_gapped captures_gapped")
def jolly_seber_intervals(spark, sf):
    captures = _gapped(spark, sf)
    links = settle(cap.link_counts(captures), "links")
    est = ab.survival_per_unit(ab.jolly_seber(cap.full_counts(links)), cap.occasions(captures))
    return est.select("t", "period", "gap", "n", "m", "r", "z", r("phi").alias("phi"), r("phi_unit").alias("phi_unit"))


@query("gross_by_group_intervals", f"SELECT grp, {q('n_gross')} AS n_gross FROM gross_gappedgrp", "gross_gappedgrp")
def gross_by_group_intervals(spark, sf):
    return _gross_of(settle(cap.link_counts(_gapped(spark, sf), ["grp"]), "links")).select("grp", r("n_gross").alias("n_gross"))


_NTOT = "(est / theta)"
_SETOT = f"sqrt({_NTOT} * {_NTOT} * ((se / est) * (se / est) + (1 - theta) / (n * theta)))"


def _corrected_sql(source: str, keep: str) -> str:
    return f"""SELECT {keep}, {q('n_tot')} AS n_tot, {q('se_tot')} AS se_tot,
        {q(f'exp({Z95!r} * sqrt(ln(1 + (se_tot / n_tot) * (se_tot / n_tot))))')} AS c_tot
        FROM (SELECT *, {_NTOT} AS n_tot, {_SETOT} AS se_tot FROM ({source}))"""


_GOF_GAPPED = _gof_sql("gapped")
view("gof_gapped", " UNION ALL ".join(
    f"SELECT '{k}' AS test, sum(chi2) AS chi2, CAST(sum(dof) AS BIGINT) AS dof FROM ({s})" for k, s in _GOF_GAPPED.items()), "links_gapped")


def _gapped_links(spark, sf, by=()):
    captures = _gapped(spark, sf).withColumn("bucket", F.pmod("id", F.lit(BUCKETS)).cast("int"))
    return settle(cap.link_counts(captures, list(by)), "links")


@query("gof_tables_intervals", " UNION ALL ".join(
    f"SELECT '{k}' AS test, t, a, b, c, d, {q('chi2')} AS chi2, dof FROM ({s}) WHERE a + b + c + d > 0" for k, s in _GOF_GAPPED.items()), "links_gapped")
def gof_tables_intervals(spark, sf):
    """The four tests where quarters are unsampled: the next occasion is the next sampled one."""
    tables = gof.gof_tables(_gapped_links(spark, sf)).filter("a + b + c + d > 0")
    return tables.select("test", "t", "a", "b", "c", "d", r("chi2").alias("chi2"), "dof")


@query("c_hat_intervals", f"""
    SELECT {q('sum(chi2)')} AS chi2, CAST(sum(dof) AS BIGINT) AS dof, {q('sum(chi2) / sum(dof)')} AS c_hat FROM gof_gapped""", "gof_gapped")
def c_hat_intervals(spark, sf):
    return gof.c_hat(_gapped_links(spark, sf)).select(r("chi2").alias("chi2"), "dof", r("c_hat").alias("c_hat"))


_count_views("gappedrep", _REPLICATES.format("captures_gapped"), "rep, grp", "captures_gapped")
_count_views("gappedwholerep", _REPLICATES.format("captures_gapped"), "rep", "captures_gapped")


@query("jackknife_vcv_intervals", f"""
    SELECT a.grp AS g_i, b.grp AS g_j, {q(f'covar_pop(a.n_gross, b.n_gross) * {BUCKETS - 1}')} AS cov
    FROM gross_gappedrep a JOIN gross_gappedrep b ON a.rep = b.rep GROUP BY 1, 2""", "gross_gappedrep")
def jackknife_vcv_intervals(spark, sf):
    return _covariance_of(_gapped_links(spark, sf, ["grp", "bucket"])).withColumn("cov", r("cov"))


@query("abundance_by_occasion_intervals", _corrected_sql(f"""
    SELECT j.t, p.period, CAST(y.y AS INT) AS y, j.n_hat AS est, s.se, y.theta, y.n FROM js_gapped j
    JOIN (SELECT DISTINCT t, period FROM captures_gapped) p ON p.t = j.t
    JOIN (SELECT t, sqrt(var_pop(n_hat) * {BUCKETS - 1}) AS se FROM js_gappedwholerep GROUP BY t) s ON s.t = j.t
    JOIN (SELECT year(sdate) AS y, count(DISTINCT id) AS n,
                 CAST(count(DISTINCT CASE WHEN mark_level = 'WM' THEN id END) AS DOUBLE) / count(DISTINCT id) AS theta
          FROM sightings GROUP BY 1) y ON y.y = 1995 + (p.period - 1) // 4
    WHERE j.n_hat IS NOT NULL""", "t, period, y, " + q("est") + " AS est, " + q("se") + " AS se"),
       "js_gapped js_gappedwholerep captures_gapped sightings")
def abundance_by_occasion_intervals(spark, sf):
    """Corrected abundance at ranked quarters; the year of an occasion is that of its period, not of its rank."""
    captures = settle(_gapped(spark, sf).withColumn("bucket", F.pmod("id", F.lit(BUCKETS)).cast("int")), "captures")
    return _abundance(spark, sf, captures, lambda period: F.floor((period - 1) / 4)).select(
        "t", "period", "y", r("n_hat").alias("est"), *[r(c).alias(c) for c in ("se", "n_tot", "se_tot", "c_tot")])


@query("between_counts_skipping", "SELECT grp, t, n, z FROM counts_skipping", "counts_skipping")
def between_counts_skipping(spark, sf):
    """Grouped counts where whole occasions are missing and numbers do not start at 1."""
    captures = fx.captures(spark, sf).filter("t % 5 <> 0").withColumn("t", F.col("t") + 100)
    return cap.full_counts(settle(cap.link_counts(captures, ["grp"]), "links"), ["grp"]).select("grp", "t", "n", "z")


@query("jolly_seber_all_marks", "SELECT t, " + ", ".join(f"{q(c)} AS {c}" for c in _EST) + " FROM js_all", "js_all")
def jolly_seber_all_marks(spark, sf):
    est = ab.jolly_seber(cap.full_counts(_links(spark, sf, marks=None)))
    return est.select("t", *[r(c).alias(c) for c in _EST])


@query("jolly_seber_by_group", "SELECT grp, t, n, " + ", ".join(f"{q(c)} AS {c}" for c in _EST) + " FROM js_grp", "js_grp")
def jolly_seber_by_group(spark, sf):
    est = ab.jolly_seber(_group_counts(spark, sf), ["grp"])
    return est.select("grp", "t", "n", *[r(c).alias(c) for c in _EST])


@query("gross_by_group", f"SELECT grp, {q('n_gross')} AS n_gross FROM gross_grp", "gross_grp")
def gross_by_group(spark, sf):
    return _gross_of(_links(spark, sf, ["grp"])).select("grp", r("n_gross").alias("n_gross"))


@query("jackknife_vcv", f"SELECT g_i, g_j, {q('cov')} AS cov FROM jack_cov", "jack_cov")
def jackknife_vcv(spark, sf):
    return _covariance_of(_links(spark, sf, ["grp", "bucket"])).withColumn("cov", r("cov"))


@query("total_with_cov", f"SELECT {q('n_gross')} AS n_gross, {q('se')} AS se FROM total_se", "total_se")
def total_with_cov(spark, sf):
    _, total = _with_se(spark, sf)
    return total.select(r("n_gross").alias("n_gross"), r("se").alias("se"))


_C = f"exp({Z95!r} * sqrt(ln(1 + (se / n_gross) * (se / n_gross))))"
view("intervals", f"""
    SELECT pos, label, n_gross, se, {_C} AS c, n_gross / {_C} AS lower, n_gross * {_C} AS upper FROM (
      SELECT 0 AS pos, 'Total' AS label, n_gross, se FROM total_se UNION ALL
      SELECT grp, label, n_gross, se FROM gross_se LEFT JOIN (
        SELECT grp, ['Residents', 'Part-Time', 'Transient'][row_number() OVER (ORDER BY avg(m_rate) DESC, grp)] AS label
        FROM features JOIN id_group USING (id) GROUP BY grp) USING (grp))""",
     "total_se gross_se features id_group")
# Row labels of the estimate table, from the highest to the lowest monthly rate.
GROUP_LABELS = ("Residents", "Part-Time", "Transient")


@query("lognormal_ci", "SELECT pos, " + ", ".join(
    f"{q(c)} AS {c}" for c in ("n_gross", "se", "c", "lower", "upper")) + " FROM intervals", "intervals")
def lognormal_ci(spark, sf):
    groups, total = _with_se(spark, sf)
    rows = groups.withColumnRenamed("grp", "pos").unionByName(total.withColumn("pos", F.lit(0)))
    out = ab.lognormal_interval(rows)
    return out.select("pos", *[r(c).alias(c) for c in ("n_gross", "se", "c", "lower", "upper")])


@query("ci_table", "SELECT pos, label, " + ", ".join(
    f"round_even({c}, 0) AS {c}" for c in ("lower", "n_gross", "upper")) + " FROM intervals", "intervals")
def ci_table(spark, sf):
    groups, total = (ab.lognormal_interval(df) for df in _with_se(spark, sf))
    features = fidelity.fidelity_features(fx.sighting_days(spark, sf)).select("id", "m_rate")
    rates = features.join(fx.individuals(spark, sf).select("id", "grp"), "id").groupBy("grp").agg(F.avg("m_rate").alias("rate"))
    return ab.ci_table(groups, total, rates, GROUP_LABELS)


@query("mark_rate_correct", _corrected_sql("""
    SELECT pos, n_gross AS est, se, t.theta, t.n FROM intervals,
      (SELECT count(DISTINCT id) AS n,
              CAST(count(DISTINCT CASE WHEN mark_level = 'WM' THEN id END) AS DOUBLE) / count(DISTINCT id) AS theta
       FROM sightings) t""", "pos"), "intervals sightings")
def mark_rate_correct(spark, sf):
    groups, total = _with_se(spark, sf)
    rows = groups.withColumnRenamed("grp", "pos").unionByName(total.withColumn("pos", F.lit(0)))
    overall = ct.distinct_individuals(fx.sightings(spark, sf)).filter("y IS NULL AND m IS NULL")
    rate = one_row(overall, n=F.max("n"), theta=F.max("theta"))
    out = ab.mark_rate_correct(rows, "n_gross", "se", rate["theta"], rate["n"])
    return out.select("pos", *[r(c).alias(c) for c in ("n_tot", "se_tot", "c_tot")])


@query("abundance_by_occasion", _corrected_sql(f"""
    SELECT j.t, CAST(y.y AS INT) AS y, j.n_hat AS est, s.se, y.theta, y.n FROM js_month j
    JOIN (SELECT t, sqrt(var_pop(n_hat) * {BUCKETS - 1}) AS se FROM js_monthrep GROUP BY t) s ON s.t = j.t
    JOIN (SELECT year(sdate) AS y, count(DISTINCT id) AS n,
                 CAST(count(DISTINCT CASE WHEN mark_level = 'WM' THEN id END) AS DOUBLE) / count(DISTINCT id) AS theta
          FROM sightings GROUP BY 1) y ON y.y = 1995 + (j.t - 1) // 12
    WHERE j.n_hat IS NOT NULL""", "t, y, " + q("est") + " AS est, " + q("se") + " AS se"),
       "js_month js_monthrep sightings")
def abundance_by_occasion(spark, sf):
    captures = fx.captures(spark, sf, period="month").withColumn("bucket", F.pmod("id", F.lit(BUCKETS)).cast("int"))
    out = _abundance(spark, sf, settle(cap.rank_occasions(captures), "captures"), lambda period: F.floor((period - 1) / 12))
    return out.select(F.col("period").alias("t"), "y", r("n_hat").alias("est"), *[r(c).alias(c) for c in ("se", "n_tot", "se_tot", "c_tot")])


# ---- model table -------------------------------------------------------------------------------------

_PAR = {  # parameters per specification from the number of occasions k and groups g
    "p": "CASE p WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE k - 2 END",
    "phi": "CASE phi WHEN 1 THEN 1 WHEN 2 THEN k - 1 ELSE g END",
    "pent": "CASE pent WHEN 1 THEN 1 WHEN 2 THEN k - 1 ELSE g END",
}


@query("model_grid", f"""
    SELECT 'Mod' || p || phi || pent AS model, {_PAR['p']} + {_PAR['phi']} + {_PAR['pent']} AS npar
    FROM (SELECT range + 1 AS p FROM range(3)), (SELECT range + 1 AS phi FROM range(3)), (SELECT range + 1 AS pent FROM range(3)),
         (SELECT count(DISTINCT t) AS k, count(DISTINCT grp) AS g FROM captures_wm)""", "captures_wm")
def model_grid(spark, sf):
    size = one_row(fx.captures(spark, sf), k=F.count_distinct("t"), g=F.count_distinct("grp"))
    grid = models.model_grid(spark).withColumns({"k": size["k"], "g": size["g"]})
    return grid.selectExpr("model", f"{_PAR['p']} + {_PAR['phi']} + {_PAR['pent']} AS npar")


def _ll(k, n, p, binomial):
    first = f"CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({p}) END"
    return f"{first} + CASE WHEN {n} = {k} THEN 0 ELSE ({n} - {k}) * ln(1 - {p}) END" if binomial else first


def _fit(spec, source, binomial, t="CAST(NULL AS INT)", grp="CAST(NULL AS INT)"):
    return f"""SELECT {spec} AS spec, {t} AS t, {grp} AS grp, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, p,
               {_ll('k', 'n', 'p', binomial)} AS loglik FROM ({source})"""


def _pool(source, keys=""):
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}sum(k) AS k, sum(n) AS n, CAST(sum(k) AS DOUBLE) / sum(n) AS p FROM ({source}){group} HAVING sum(n) > 0"


_DET = "SELECT t, s AS k, s + z AS n FROM counts_wm WHERE s + z > 0"
_RET = "SELECT t, grp, r AS k, n FROM counts_grp WHERE t < (SELECT max(t) FROM counts_grp)"
_ENT1 = """SELECT {1}CASE WHEN t = (SELECT min(t) FROM counts_grp) THEN t END AS t, sum(u) AS k, any_value(w) AS n,
    CAST(sum(u) AS DOUBLE) / any_value(w) / CASE WHEN t = (SELECT min(t) FROM counts_grp) THEN 1
        ELSE (SELECT count(DISTINCT t) - 1 FROM counts_grp) END AS p
    FROM (SELECT *, sum(u) OVER ({0}) AS w FROM counts_grp) GROUP BY {1}t = (SELECT min(t) FROM counts_grp), 
    CASE WHEN t = (SELECT min(t) FROM counts_grp) THEN t END"""
view("fit_p", _fit(1, _pool(_DET), True) + " UNION ALL " + _fit(3, _pool(_DET, "t"), True, t="t"), "counts_wm")
view("fit_phi", " UNION ALL ".join((
    _fit(1, _pool(_RET), True), _fit(2, _pool(_RET, "t"), True, t="t"), _fit(3, _pool(_RET, "grp"), True, grp="grp"))),
     "counts_grp")
view("fit_pent", " UNION ALL ".join((
    _fit(1, _ENT1.format("", ""), False, t="t"),
    _fit(2, """SELECT t, sum(u) AS k, (SELECT sum(u) FROM counts_grp) AS n,
               CAST(sum(u) AS DOUBLE) / (SELECT sum(u) FROM counts_grp) AS p FROM counts_grp GROUP BY t""", False, t="t"),
    _fit(3, _ENT1.format("PARTITION BY grp", "grp, "), False, t="t", grp="grp"))), "counts_grp")
_FIT = f"SELECT spec, t, grp, k, n, {q('p')} AS p, {q('loglik')} AS loglik FROM "


def _fits(cells):
    return cells.withColumns({"p": r("p"), "loglik": r("loglik")})


@query("detect_models", _FIT + "fit_p", "fit_p")
def detect_models(spark, sf):
    return _fits(models.detect_models(_counts(spark, sf)))


@query("return_models", _FIT + "fit_phi", "fit_phi")
def return_models(spark, sf):
    return _fits(models.return_models(_group_counts(spark, sf)))


@query("entry_models", _FIT + "fit_pent", "fit_pent")
def entry_models(spark, sf):
    return _fits(models.entry_models(_group_counts(spark, sf)))


def _effort(spark, sf, months_per_occasion):
    month = (F.col("y") - fx.FIRST_YEAR) * 12 + F.col("m") - 1
    return fx.effort_days(spark, sf).groupBy(
        (F.floor(month / months_per_occasion) + 1).cast("int").alias("t")
    ).agg(F.sum("n").alias("effort"))


view("effort_cells", """
    SELECT c.t, c.s AS k, c.s + c.z AS n, ln(CAST(e.effort AS DOUBLE)) AS x FROM counts_wm c JOIN (
      SELECT ((y - 1995) * 12 + m - 1) // 3 + 1 AS t, sum(n) AS effort FROM effort_days GROUP BY 1) e ON e.t = c.t WHERE c.s + c.z > 0""",
     "counts_wm effort_days")
# Newton steps of a logit line from the pooled rate; "q" is the detection rate of a cell at the current line.
_NEWTON = f"""
    , newton AS (
      SELECT 0 AS step, ln(sum(k) / CAST(sum(n) - sum(k) AS DOUBLE)) AS a, CAST(0 AS DOUBLE) AS b FROM effort_cells
      UNION ALL
      SELECT step + 1, a + (bb * ga - ab * gb) / (aa * bb - ab * ab), b + (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
        SELECT step, a, b, sum(k - n * q) AS ga, sum((k - n * q) * x) AS gb, sum(n * q * (1 - q)) AS aa,
               sum(n * q * (1 - q) * x) AS ab, sum(n * q * (1 - q) * x * x) AS bb
        FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS q FROM newton, effort_cells) GROUP BY step, a, b) WHERE step < {models.NEWTON_STEPS}),
    line AS (SELECT a, b FROM newton WHERE step = {models.NEWTON_STEPS}),
    fit_effort AS (SELECT 2 AS spec, CAST(2 AS BIGINT) AS npar, a, b, (
      SELECT sum(k * (a + b * x) - n * ln(1 + exp(a + b * x))) FROM effort_cells) AS ll FROM line)"""


@query("detect_effort_model", _NEWTON + f"""
    SELECT 'p' AS part, spec, npar, {q('ll')} AS loglik, {q('a', 5)} AS intercept, {q('b', 5)} AS slope FROM fit_effort""", "effort_cells")
def detect_effort_model(spark, sf):
    fit = models.detect_effort_fit(_counts(spark, sf), _effort(spark, sf, 3))
    return fit.select("part", "spec", "npar", r("loglik").alias("loglik"), *[r(c, 5).alias(c) for c in ("intercept", "slope")])


def _compare(spark, sf, effort):
    links = _links(spark, sf, ["grp"])
    whole_links = cap.narrow(links)
    grouped = settle(cap.full_counts(links, ["grp"]), "group-counts")
    whole = settle(cap.full_counts(whole_links), "counts")
    parts = (
        models.part_fit(models.detect_models(whole), "p")
        .unionByName(models.part_fit(models.return_models(grouped), "phi"))
        .unionByName(models.part_fit(models.entry_models(grouped), "pent"))
    )
    if effort:
        fit = models.detect_effort_fit(whole, _effort(spark, sf, 3))
        parts = parts.unionByName(fit.select("part", "spec", "npar", "loglik"))
    parts = settle(parts, "parts")
    fit = settle(gof.c_hat(_ranked_links(spark, sf)), "c-hat")
    n, c = one_row(whole, n=F.sum("n")), one_row(fit, c=F.max("c_hat"))
    out = models.model_compare(spark, parts, n["n"], c["c"])
    scores = ("deviance", "aicc", "qaicc", "delta", "weight")
    return out.select("model", "npar", "model_rank", *[r(s).alias(s) for s in scores])


_KP = "a.npar + b.npar + c.npar"
_SCORED = f"""
    SELECT *, deviance + 2 * npar + 2.0 * npar * (npar + 1) / (n - npar - 1) AS aicc,
           deviance / ch + 2 * (npar + 1) + 2.0 * (npar + 1) * (npar + 2) / (n - npar - 2) AS qaicc FROM (
      SELECT 'Mod' || a.spec || b.spec || c.spec AS model, {_KP} AS npar, -2 * (a.ll + b.ll + c.ll) AS deviance,
             CAST((SELECT count(*) FROM captures_wm) AS DOUBLE) AS n, (SELECT sum(chi2) / sum(dof) FROM gof_all) AS ch
      FROM (SELECT spec, count(*) AS npar, sum(loglik) AS ll FROM fit_p GROUP BY spec /*more*/) a,
           (SELECT spec, count(*) AS npar, sum(loglik) AS ll FROM fit_phi GROUP BY spec) b,
           (SELECT spec, CASE spec WHEN 1 THEN 1 WHEN 2 THEN count(*) - 1 ELSE count(DISTINCT grp) END AS npar,
                   sum(loglik) AS ll FROM fit_pent GROUP BY spec) c)"""
_SCORED_NEEDS = "captures_wm gof_all fit_p fit_phi fit_pent"
view("scored", _SCORED, _SCORED_NEEDS)
_RANKED = f"""
    SELECT model, npar, CAST(row_number() OVER (ORDER BY qaicc, model) AS INT) AS model_rank, {q('deviance')} AS deviance,
           {q('aicc')} AS aicc, {q('qaicc')} AS qaicc, {q('qaicc - min(qaicc) OVER ()')} AS delta, {q('w / sum(w) OVER ()')} AS weight
    FROM (SELECT *, exp(-0.5 * (qaicc - min(qaicc) OVER ())) AS w FROM {{}})"""


@query("model_compare", _RANKED.format("scored"), "scored")
def model_compare(spark, sf):
    return _compare(spark, sf, effort=False)


@query("model_compare_effort", _NEWTON + ", scored27 AS (" + _SCORED.replace(
    "/*more*/", "UNION ALL SELECT spec, npar, ll FROM fit_effort") + ")" + _RANKED.format("scored27"), f"effort_cells {_SCORED_NEEDS}")
def model_compare_effort(spark, sf):
    return _compare(spark, sf, effort=True)


@query("model_rank", """
    SELECT model, CAST(row_number() OVER (ORDER BY qaicc, model) AS INT) AS model_rank FROM scored""", "scored")
def model_rank(spark, sf):
    return _compare(spark, sf, effort=False).select("model", "model_rank")


@query("param_prefix", f"SELECT 'p ' || t AS name, {q('p')} AS estimate FROM fit_p WHERE spec = 3", "fit_p")
def param_prefix(spark, sf):
    links = _links(spark, sf, ["grp"])
    grouped = cap.full_counts(links, ["grp"])
    cells = {"p": models.detect_models(cap.full_counts(cap.narrow(links))).filter("spec = 3"),
             "Phi": models.return_models(grouped).filter("spec = 2"), "pent": models.entry_models(grouped).filter("spec = 2")}
    named = ct.stack_labelled({
        part: c.select(F.concat_ws(" ", F.lit(part), "t").alias("name"), F.col("p").alias("estimate"))
        for part, c in cells.items()
    }).drop("param")
    return named.filter(F.col("name").rlike("^p ")).withColumn("estimate", r("estimate"))


@query("effort_covariate", f"""
    SELECT c.t, c.s AS k, c.s + c.z AS n, CAST(e.n AS BIGINT) AS effort, {q('ln(e.n)')} AS log_effort
    FROM counts_month c JOIN effort_days e ON c.t = (e.y - 1995) * 12 + e.m WHERE c.s + c.z > 0""",
       "counts_month effort_days")
def effort_covariate(spark, sf):
    cells = models.detect_cells(cap.full_counts(_links(spark, sf, period="month")))
    return cells.join(_effort(spark, sf, 1), "t").withColumn("log_effort", r(F.log(F.col("effort").cast("double"))))
