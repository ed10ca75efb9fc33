"""Tabular queries: scans, projections, joins, aggregations, order-dependent functions, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.scalar import na_to_zero, one_row, round_half_even
from sightline.functions.normal import norm_quantile
from sightline.operators import calendar, counts, fidelity
from sightline.operators.ranks import group_quantiles, quantiles_from_runs, running_sums
from sightline.plans import views  # noqa: F401  (oracle views)
from sightline.plans.registry import q, query, r
from sightline.session import settle, shared_path
from sightline.sources import fixtures as fx
from sightline.sources import tables as tb

Z95 = norm_quantile(0.975)


# ---- scans and sinks -------------------------------------------------------------------------

@query("scan_delimited", f"SELECT event_id, {q('x')} AS x, {q('y')} AS y, stype FROM points", "points")
def scan_delimited(spark, sf):
    pts = fx.points(spark, sf).select("event_id", "x", "y", "stype")
    path = tb.sink_delimited(pts, shared_path(spark, "points-text"), header=True)
    back = tb.scan_delimited(spark, path, pts.schema, header=True)
    return back.select("event_id", r("x").alias("x"), r("y").alias("y"), "stype")


@query("scan_matrix", "SELECT id, mark_level, sdate, tot FROM sightings", "sightings")
def scan_matrix(spark, sf):
    path = tb.sink_table(fx.sightings(spark, sf), shared_path(spark, "matrix"))
    return tb.scan_matrix(spark, path).select("id", "mark_level", "sdate", "tot")


@query("sink_clustered", """
    SELECT s.id, s.sdate, g.grp FROM sightings s JOIN id_group g ON s.id = g.id""", "sightings id_group")
def sink_clustered(spark, sf):
    labels = fx.individuals(spark, sf).select("id", "grp")
    labelled = fx.sighting_days(spark, sf).join(labels, "id")
    path = tb.sink_table(labelled, shared_path(spark, "clustered"), partition_by="grp")
    return spark.read.schema("id bigint, sdate date, grp int").parquet(path)


@query("literal_sequence", f"""
    SELECT {q('i / CAST(10 AS DOUBLE)')} AS x, count(p.event_id) AS n
    FROM (SELECT range AS i FROM range(71)) s LEFT JOIN points p ON floor(p.y * 10) = s.i GROUP BY s.i""", "points")
def literal_sequence(spark, sf):
    grid = spark.range(71).select(F.col("id").alias("i"), (F.col("id") / F.lit(10.0)).alias("x"))
    binned = fx.points(spark, sf).groupBy(F.floor(F.col("y") * 10).alias("i")).agg(F.count("*").alias("n"))
    return grid.join(binned, "i", "left").select(r("x").alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- projections, filters, predicates ---------------------------------------------------------

@query("derive_columns", """
    SELECT id, sdate, CAST(date_trunc('month', sdate) AS DATE) AS ym, CAST(year(sdate) AS INT) AS y,
           CAST(year(sdate) - 1995 AS INT) AS study_year, year(sdate) - 1995 >= 3 AS late FROM sightings""", "sightings")
def derive_columns(spark, sf):
    return (
        fx.sighting_days(spark, sf)
        .withColumns({"ym": F.trunc("sdate", "month"), "y": F.year("sdate")})
        .withColumn("study_year", F.col("y") - fx.FIRST_YEAR)
        .withColumn("late", F.col("study_year") >= 3)
    )


@query("drop_columns", "SELECT id, sdate, observed, tot FROM sightings", "sightings")
def drop_columns(spark, sf):
    return fx.sightings(spark, sf).drop("mark_level", "age_class", "gender")


@query("filter_eq", "SELECT id, sdate FROM sightings WHERE mark_level = 'WM' AND observed = 1", "sightings")
def filter_eq(spark, sf):
    return fx.sightings(spark, sf).filter((F.col("mark_level") == "WM") & (F.col("observed") == 1)).select("id", "sdate")


def _stacked_draws(spark, sf):
    draws = fx.draws(spark, sf)
    params = ("b0", "b1", "loc", "theta_sig")
    return counts.stack_labelled({p: draws.select("draw", F.col(p).alias("value")) for p in params})


_STACKED = " UNION ALL ".join(
    f"SELECT draw, {p} AS value, '{p}' AS param FROM draws" for p in ("b0", "b1", "loc", "theta_sig")
)


@query("stack_labelled", f"SELECT draw, {q('value')} AS value, param FROM ({_STACKED})", "draws")
def stack_labelled(spark, sf):
    return _stacked_draws(spark, sf).withColumn("value", r("value"))


@query("filter_compound", f"""
    SELECT draw, {q('value')} AS value, param FROM ({_STACKED})
    WHERE value < 1000 AND ((value < 0.05 AND param = 'theta_sig') OR param <> 'theta_sig')""", "draws")
def filter_compound(spark, sf):
    capped = F.col("param") == "theta_sig"
    return (
        _stacked_draws(spark, sf).filter(F.col("value") < 1000)
        .filter(((F.col("value") < 0.05) & capped) | ~capped).withColumn("value", r("value"))
    )


@query("distinct_keys", "SELECT DISTINCT id, tot, age_class FROM sightings", "sightings")
def distinct_keys(spark, sf):
    return fx.sightings(spark, sf).select("id", "tot", "age_class").distinct()


@query("relabel", """
    SELECT CASE mark_level WHEN 'WM' THEN 'Well marked' WHEN 'FM' THEN 'Fairly marked' ELSE 'Unmarked' END AS row_label,
           count(DISTINCT id) AS individuals, count(*) AS sighting_days FROM sightings GROUP BY 1""", "sightings")
def relabel(spark, sf):
    level = F.col("mark_level")
    label = F.when(level == "WM", "Well marked").when(level == "FM", "Fairly marked").otherwise("Unmarked")
    per_id = fx.sightings(spark, sf).groupBy("id", "mark_level").agg(F.count("*").alias("days"))
    table = per_id.groupBy("mark_level").agg(F.count("*"), F.sum("days")).withColumn("mark_level", label)
    return table.toDF("row_label", "individuals", "sighting_days")


@query("key_check", """
    SELECT id, count(*) AS n, (SELECT count(*) FROM sightings) AS n_rows
    FROM sightings GROUP BY id HAVING count(*) > 1""", "sightings")
def key_check(spark, sf):
    return counts.key_check(fx.sighting_days(spark, sf), "id")


@query("na_to_zero", """
    SELECT g.id, g.month, coalesce(s.n, 0) AS n FROM dense_months g
    LEFT JOIN (SELECT id, CAST(date_trunc('month', sdate) AS DATE) AS month, CAST(count(*) AS DOUBLE) AS n
               FROM sightings GROUP BY 1, 2) s ON g.id = s.id AND g.month = s.month""", "dense_months")
def na_to_zero_query(spark, sf):
    days = fx.sighting_days(spark, sf)
    full = fidelity.dense_months(days, days.select("id").distinct()).select("id", "month")
    n = days.groupBy("id", F.trunc("sdate", "month").alias("month")).agg(F.count("*").cast("double").alias("n"))
    return full.join(n, ["id", "month"], "left").withColumn("n", na_to_zero("n"))


@query("scalar_pull", f"""
    SELECT CAST(year(sdate) AS INT) AS y, count(DISTINCT id) AS n,
           {q('CAST(count(DISTINCT id) AS DOUBLE) / (SELECT count(DISTINCT id) FROM sightings)')} AS share
    FROM sightings GROUP BY 1""", "sightings")
def scalar_pull(spark, sf):
    seen = fx.sighting_days(spark, sf).select("id", F.year("sdate").alias("y")).distinct()
    total = one_row(seen.select("id").distinct(), n=F.count("*"))
    return seen.groupBy("y").agg(F.count("*").alias("n")).withColumn(
        "share", r(F.col("n").cast("double") / total["n"])
    )


# ---- joins --------------------------------------------------------------------------------------

@query("join_occasions", "SELECT s.id, s.sdate, o.occ, o.time FROM sightings s LEFT JOIN occs o ON s.sdate = o.sdate",
       "sightings occs")
def join_occasions(spark, sf):
    days = fx.sighting_days(spark, sf)
    return days.join(calendar.occasions(days), "sdate", "left").select("id", "sdate", "occ", "time")


@query("join_labels", "SELECT s.id, s.sdate, g.grp FROM sightings s LEFT JOIN id_group g ON s.id = g.id",
       "sightings id_group")
def join_labels(spark, sf):
    labels = fx.individuals(spark, sf).select("id", "grp")
    return fx.sighting_days(spark, sf).join(labels, "id", "left").select("id", "sdate", "grp")


_MONTH_COUNTS = """
    SELECT CAST(year(sdate) AS INT) AS y, CAST(month(sdate) AS INT) AS m, count(DISTINCT id) AS n FROM sightings {} GROUP BY 1, 2"""


@query("bind_by_key", f"""
    SELECT a.y, a.m, a.n, coalesce(b.n, 0) AS n_calf_um, e.n AS effort
    FROM ({_MONTH_COUNTS.format('')}) a
    LEFT JOIN ({_MONTH_COUNTS.format("WHERE mark_level = 'UM' AND age_class = 'calf'")}) b ON a.y = b.y AND a.m = b.m
    LEFT JOIN effort_days e ON a.y = e.y AND a.m = e.m""", "sightings effort_days")
def bind_by_key(spark, sf):
    month = fx.sightings(spark, sf).select(
        "id", "mark_level", "age_class", F.year("sdate").alias("y"), F.month("sdate").alias("m")
    ).distinct()
    everyone = month.groupBy("y", "m").agg(F.count("*").alias("n"))
    some = month.filter("mark_level = 'UM' AND age_class = 'calf'").groupBy("y", "m").agg(F.count("*").alias("n_calf_um"))
    effort = fx.effort_days(spark, sf).withColumnRenamed("n", "effort")
    return everyone.join(some, ["y", "m"], "left").join(effort, ["y", "m"], "left").fillna(0, ["n_calf_um"])


@query("spread_year_to_month", f"""
    SELECT a.y, a.m, a.n, b.n AS n_year FROM ({_MONTH_COUNTS.format('')}) a
    JOIN (SELECT CAST(year(sdate) AS INT) AS y, count(DISTINCT id) AS n FROM sightings GROUP BY 1) b ON a.y = b.y""",
       "sightings")
def spread_year_to_month(spark, sf):
    levels = counts.distinct_individuals(fx.sightings(spark, sf))
    month = levels.filter("m IS NOT NULL").select("y", "m", "n")
    year = levels.filter("m IS NULL AND y IS NOT NULL").select("y", F.col("n").alias("n_year"))
    return month.join(year, "y").select("y", "m", "n", "n_year")


# ---- aggregations -------------------------------------------------------------------------------

@query("group_count", "SELECT mark_level, age_class, count(*) AS n FROM sightings GROUP BY 1, 2", "sightings")
def group_count(spark, sf):
    return fx.sightings(spark, sf).groupBy("mark_level", "age_class").agg(F.count("*").alias("n"))


def _dense(spark, sf):
    days = fx.sighting_days(spark, sf)
    return fidelity.dense_months(days, days.select("id").distinct())


def _dense_days(spark, sf):
    days = fx.sighting_days(spark, sf)
    return fidelity.dense_days(days, days.select("id").distinct())


@query("conditional_minmax", """
    SELECT id, min(CASE WHEN observed = 1 THEN month END) AS first_month,
           max(CASE WHEN observed = 1 THEN month END) AS last_month,
           min(CASE WHEN observed = 0 THEN month END) AS first_missed FROM dense_months GROUP BY id""", "dense_months")
def conditional_minmax(spark, sf):
    hit, miss = F.when(F.col("observed") == 1, F.col("month")), F.when(F.col("observed") == 0, F.col("month"))
    return _dense(spark, sf).groupBy("id").agg(
        F.min(hit).alias("first_month"), F.max(hit).alias("last_month"), F.min(miss).alias("first_missed")
    )


@query("conditional_minmax_days", """
    SELECT id, min(CASE WHEN observed = 1 THEN sdate END) AS first_day,
           max(CASE WHEN observed = 1 THEN sdate END) AS last_day,
           min(CASE WHEN observed = 0 THEN sdate END) AS first_missed FROM dense_days GROUP BY id""", "dense_days")
def conditional_minmax_days(spark, sf):
    hit, miss = F.when(F.col("observed") == 1, F.col("sdate")), F.when(F.col("observed") == 0, F.col("sdate"))
    return _dense_days(spark, sf).groupBy("id").agg(
        F.min(hit).alias("first_day"), F.max(hit).alias("last_day"), F.min(miss).alias("first_missed")
    )


@query("chained_summary", f"""
    SELECT id, first_time, last_time, last_time - first_time AS span_time,
           {q('CAST(last_time - first_time AS DOUBLE) / (SELECT max(time) FROM occs)')} AS span_time_rel
    FROM (SELECT s.id, min(o.time) AS first_time, max(o.time) AS last_time
          FROM sightings s JOIN occs o ON s.sdate = o.sdate GROUP BY s.id)""", "sightings occs")
def chained_summary(spark, sf):
    days = fx.sighting_days(spark, sf)
    occ = calendar.occasions(days)
    longest = one_row(occ, time=F.max("time"))
    return (
        days.join(occ, "sdate").groupBy("id")
        .agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))
        .withColumn("span_time", F.col("last_time") - F.col("first_time"))
        .withColumn("span_time_rel", r(F.try_divide(F.col("span_time").cast("double"), longest["time"])))
    )


@query("global_max", """
    SELECT id, s.sdate, occ, (SELECT max(occ) FROM occs) AS max_occ, (SELECT max(time) FROM occs) AS max_time
    FROM sightings s JOIN occs o ON s.sdate = o.sdate""", "sightings occs")
def global_max(spark, sf):
    days = fx.sighting_days(spark, sf)
    occ = calendar.occasions(days)
    top = one_row(occ, occ=F.max("occ"), time=F.max("time"))
    return days.join(occ, "sdate").select(
        "id", "sdate", "occ", top["occ"].alias("max_occ"), top["time"].alias("max_time")
    )


@query("period_indicator", """
    SELECT id, CAST(year(month) AS INT) AS y, max(observed) AS seen FROM dense_months GROUP BY 1, 2""", "dense_months")
def period_indicator(spark, sf):
    return _dense(spark, sf).groupBy("id", F.year("month").alias("y")).agg(F.max("observed").alias("seen"))


@query("period_indicator_days", """
    SELECT id, CAST(year(sdate) AS INT) AS y, CAST(month(sdate) AS INT) AS m, max(observed) AS seen
    FROM dense_days GROUP BY 1, 2, 3""", "dense_days")
def period_indicator_days(spark, sf):
    return _dense_days(spark, sf).groupBy("id", F.year("sdate").alias("y"), F.month("sdate").alias("m")).agg(
        F.max("observed").alias("seen")
    )


@query("nested_mean", f"""
    SELECT id, {q('avg(seen)')} AS rate FROM (
      SELECT id, year(month) AS y, avg(observed) AS seen FROM dense_months GROUP BY 1, 2) GROUP BY id""", "dense_months")
def nested_mean(spark, sf):
    yearly = _dense(spark, sf).repartition("id").groupBy("id", F.year("month").alias("y")).agg(
        F.avg("observed").alias("seen")
    )
    return yearly.groupBy("id").agg(r(F.avg("seen")).alias("rate"))


@query("nested_mean_days", f"""
    SELECT id, {q('avg(seen)')} AS rate FROM (
      SELECT id, year(sdate) AS y, avg(observed) AS seen FROM dense_days GROUP BY 1, 2) GROUP BY id""", "dense_days")
def nested_mean_days(spark, sf):
    yearly = _dense_days(spark, sf).repartition("id").groupBy("id", F.year("sdate").alias("y")).agg(
        F.avg("observed").alias("seen")
    )
    return yearly.groupBy("id").agg(r(F.avg("seen")).alias("rate"))


@query("numeric_means", "SELECT " + ", ".join(f"{q(f'avg({c})')} AS {c}" for c in fidelity.FEATURES) + " FROM features",
       "features")
def numeric_means(spark, sf):
    means = counts.numeric_means(fidelity.fidelity_features(fx.sighting_days(spark, sf)), skip=("id",))
    return means.select(*[r(c).alias(c) for c in means.columns])


@query("first_in_group", """
    SELECT CAST(date_trunc('month', sdate) AS DATE) AS month, min(sdate) AS first_date, count(DISTINCT sdate) AS n_days
    FROM sightings GROUP BY 1""", "sightings")
def first_in_group(spark, sf):
    return calendar.sampled_months(fx.sighting_days(spark, sf))


@query("group_quantiles", "SELECT age_class, " + ", ".join(
    f"{q(f'quantile_cont(tot, {p})')} AS {n}"
    for n, p in (("q025", .025), ("q25", .25), ("med", .5), ("q75", .75), ("q975", .975))) + """
    FROM (SELECT DISTINCT id, age_class, CAST(tot AS DOUBLE) AS tot FROM sightings) GROUP BY age_class""", "sightings")
def group_quantiles_query(spark, sf):
    per_id = fx.sighting_days(spark, sf).groupBy("id").agg(F.count("*").cast("double").alias("tot"))
    labelled = per_id.join(fx.individuals(spark, sf), "id").select("age_class", "tot")
    probs = {"q025": 0.025, "q25": 0.25, "med": 0.5, "q75": 0.75, "q975": 0.975}
    out = group_quantiles(labelled, ["age_class"], "tot", probs)
    return out.select("age_class", *[r(n).alias(n) for n in probs])


_LEVELS = """
    SELECT y, m, count(DISTINCT id) AS n, count(DISTINCT CASE WHEN mark_level = 'WM' THEN id END) AS n_wm
    FROM (SELECT id, mark_level, CAST(year(sdate) AS INT) AS y, CAST(month(sdate) AS INT) AS m FROM sightings)
    GROUP BY GROUPING SETS ((), (y), (y, m))"""


@query("distinct_individuals", f"SELECT y, m, n FROM ({_LEVELS})", "sightings")
def distinct_individuals(spark, sf):
    return counts.distinct_individuals(fx.sightings(spark, sf)).select("y", "m", "n")


@query("mark_rate", f"SELECT y, m, n, n_wm, {q('CAST(n_wm AS DOUBLE) / n')} AS theta FROM ({_LEVELS})", "sightings")
def mark_rate(spark, sf):
    return counts.distinct_individuals(fx.sightings(spark, sf)).withColumn("theta", r("theta"))


@query("group_histogram", f"""
    SELECT age_class, bin, n, {q('n / (sum(n) OVER (PARTITION BY age_class) * width)')} AS density FROM (
      SELECT age_class, CAST(least(floor((tot - lo) / width), 29) AS INT) AS bin, width, count(*) AS n
      FROM (SELECT DISTINCT id, age_class, tot FROM sightings),
           (SELECT min(tot) AS lo, (max(tot) - min(tot)) / CAST(30 AS DOUBLE) AS width FROM sightings)
      GROUP BY 1, 2, 3)""", "sightings")
def group_histogram(spark, sf):
    per_id = fx.sighting_days(spark, sf).groupBy("id").agg(F.count("*").alias("tot"))
    labelled = per_id.join(fx.individuals(spark, sf), "id")
    return counts.density_histogram(labelled, "age_class", "tot").withColumn("density", r("density"))


@query("months_per_year", """
    SELECT CAST(year(sdate) AS INT) AS y, count(DISTINCT month(sdate)) AS n_months FROM sightings GROUP BY 1""", "sightings")
def months_per_year(spark, sf):
    return calendar.months_per_year(fx.sighting_days(spark, sf))


@query("cluster_profile", "SELECT grp, count(*) AS size, " + ", ".join(
    f"{q(f'avg({c})')} AS {c}" for c in fidelity.FEATURES) + """
    FROM features f JOIN id_group g ON f.id = g.id GROUP BY grp""", "features id_group")
def cluster_profile(spark, sf):
    labels = fx.individuals(spark, sf).select("id", "grp")
    out = counts.cluster_profile(fidelity.fidelity_features(fx.sighting_days(spark, sf)), labels)
    return out.select("grp", "size", *[r(c).alias(c) for c in fidelity.FEATURES])


# ---- order-dependent ----------------------------------------------------------------------------

@query("occasion_index", "SELECT sdate, occ FROM occs", "occs")
def occasion_index(spark, sf):
    return calendar.occasions(fx.sighting_days(spark, sf)).select("sdate", "occ")


@query("elapsed_days", "SELECT sdate, CAST(time AS BIGINT) AS elapsed FROM occs", "occs")
def elapsed_days(spark, sf):
    return calendar.elapsed_days(fx.sighting_days(spark, sf))


@query("mean_gap", f"""
    SELECT id, {q('avg(gap)')} AS mean_gap, count(*) AS n FROM (
      SELECT id, sdate - lag(sdate) OVER (PARTITION BY id ORDER BY sdate) AS gap FROM sightings) GROUP BY id""", "sightings")
def mean_gap(spark, sf):
    return fidelity.mean_gap(fx.sighting_days(spark, sf)).withColumn("mean_gap", r("mean_gap"))


@query("month_gaps", """
    SELECT month, gap FROM (
      SELECT month, CAST(date_diff('month', lag(month) OVER (ORDER BY month), month) AS INT) AS gap
      FROM (SELECT DISTINCT CAST(date_trunc('month', sdate) AS DATE) AS month FROM sightings)) WHERE gap IS NOT NULL""",
       "sightings")
def month_gaps(spark, sf):
    return calendar.month_gaps(fx.sighting_days(spark, sf))


@query("sorted_periods", f"SELECT y, m, n FROM ({_MONTH_COUNTS.format('')}) ORDER BY y, m", "sightings")
def sorted_periods(spark, sf):
    month = counts.seen_by_month(fx.sightings(spark, sf))
    return month.groupBy("y", "m").agg(F.count("*").alias("n")).orderBy("y", "m")


@query("sample_draws", f"""
    SELECT draw, {q('b0')} AS b0, {q('b1')} AS b1 FROM draws
    ORDER BY (draw * 1103515245 + 12345) % 2147483648, draw LIMIT 4""", "draws")
def sample_draws(spark, sf):
    chosen = counts.sample_rows(fx.draws(spark, sf), "draw", 4)
    return chosen.select("draw", r("b0").alias("b0"), r("b1").alias("b1"))


@query("bernoulli_thin", f"""
    SELECT event_id, {q('p')} AS p FROM (SELECT event_id, u1, exp(-(x / 50) * (x / 50) / 2) AS p FROM points)
    WHERE u1 < p""", "points")
def bernoulli_thin(spark, sf):
    scaled = F.col("x") / 50
    pts = fx.points(spark, sf).withColumn("p", F.exp(-scaled * scaled / 2))
    return counts.keep_with_probability(pts, "p", "u1").select("event_id", r("p").alias("p"))


# ---- reshape --------------------------------------------------------------------------------------

@query("unpivot_curves", "SELECT draw, name, " + q("value") + """ AS value FROM (
    SELECT draw, 'b0' AS name, b0 AS value FROM draws UNION ALL SELECT draw, 'b1', b1 FROM draws
    UNION ALL SELECT draw, 'loc', loc FROM draws)""", "draws")
def unpivot_curves(spark, sf):
    wide = fx.draws(spark, sf).select("draw", "b0", "b1", "loc")
    return wide.unpivot("draw", ["b0", "b1", "loc"], "name", "value").withColumn("value", r("value"))


@query("densify", "SELECT id, month, observed FROM dense_months", "dense_months")
def densify(spark, sf):
    return _dense(spark, sf)


@query("densify_days", """
    SELECT id, CAST(year(sdate) AS INT) AS y, count(*) AS n, CAST(sum(observed) AS BIGINT) AS n_observed
    FROM dense_days GROUP BY 1, 2""", "dense_days")
def densify_days(spark, sf):
    """An aggregate over the complete matrix, whose rows are too many to compare (3.6 M at sf0.01)."""
    return _dense_days(spark, sf).groupBy("id", F.year("sdate").alias("y")).agg(
        F.count("*").alias("n"), F.sum("observed").alias("n_observed")
    )


@query("effort_month", f"SELECT make_date(y, m, 1) AS month, n, {q('ln(n)')} AS log_n FROM effort_days", "effort_days")
def effort_month(spark, sf):
    return calendar.effort_months(fx.effort_days(spark, sf)).withColumn("log_n", r("log_n"))


# ---- scalar functions -----------------------------------------------------------------------------

@query("fn_date", """
    SELECT id, sdate, CAST(date_trunc('month', sdate) AS DATE) AS ym, CAST(year(sdate) AS INT) AS y,
           CAST(month(sdate) AS INT) AS m FROM sightings""", "sightings")
def fn_date(spark, sf):
    return fx.sighting_days(spark, sf).select(
        "id", "sdate", F.trunc("sdate", "month").alias("ym"), F.year("sdate").alias("y"), F.month("sdate").alias("m")
    )


@query("fn_datediff", """
    SELECT id, sdate, CAST(sdate - (SELECT min(sdate) FROM sightings) AS INT) AS days FROM sightings""", "sightings")
def fn_datediff(spark, sf):
    days = fx.sighting_days(spark, sf)
    start = one_row(days, first=F.min("sdate"))
    return days.select("id", "sdate", F.datediff("sdate", start["first"]).alias("days"))


@query("fn_parse_date", "SELECT make_date(y, m, 1) AS month, n FROM effort_days", "effort_days")
def fn_parse_date(spark, sf):
    text = F.concat_ws("-", F.col("y"), F.lpad(F.col("m").cast("string"), 2, "0"), F.lit("01"))
    return fx.effort_days(spark, sf).select(F.to_date(text, "yyyy-MM-dd").alias("month"), "n")


@query("fn_math", f"""
    SELECT event_id, {q('exp(-x / 100)')} AS e, {q('ln(y)')} AS l, {q('sqrt(x)')} AS s, {q('pow(y, 2)')} AS p,
           {q('100 / sqrt(CAST(8 AS DOUBLE)) * u1')} AS k, round_even(y / 2, 0) AS h FROM points""", "points")
def fn_math(spark, sf):
    x, y = F.col("x"), F.col("y")
    return fx.points(spark, sf).select(
        "event_id", r(F.exp(-x / 100)).alias("e"), r(F.log(y)).alias("l"), r(F.sqrt(x)).alias("s"),
        r(F.pow(y, F.lit(2))).alias("p"), r(F.lit(100.0) / F.sqrt(F.lit(8.0)) * F.col("u1")).alias("k"),
        round_half_even(y / 2).alias("h"),
    )


@query("fn_string", """
    SELECT event_id, concat_ws('-', stype, CAST(year(pdate) AS VARCHAR), CAST(month(pdate) AS VARCHAR)) AS label,
           stype || ':' || species AS tag FROM points""", "points")
def fn_string(spark, sf):
    return fx.points(spark, sf).select(
        "event_id",
        F.concat_ws("-", "stype", F.year("pdate").cast("string"), F.month("pdate").cast("string")).alias("label"),
        F.concat("stype", F.lit(":"), "species").alias("tag"),
    )


@query("fn_factor", """
    SELECT event_id, stype, CAST(dense_rank() OVER (ORDER BY stype) AS INT) AS stype_code FROM points""", "points")
def fn_factor(spark, sf):
    return counts.factor_codes(fx.points(spark, sf).select("event_id", "stype"), "stype")


@query("fn_factor_ids", """
    SELECT o_orderkey, name, CAST(dense_rank() OVER (ORDER BY name) AS INT) AS name_code FROM (
      SELECT o_orderkey, 'individual-' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS name FROM orders)""")
def fn_factor_ids(spark, sf):
    """Codes of many text ids with one long common beginning."""
    name = F.concat(F.lit("individual-"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("name")
    return counts.factor_codes(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", name), "name")


_PACKED = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


@query("packed_quantiles", " UNION ALL ".join(f"""
    SELECT l_returnflag AS flag, CAST({p} AS DOUBLE) AS p, round(quantile_cont(l_extendedprice / CAST(1000000000000 AS DOUBLE), {p}), 12) AS quantile
    FROM lineitem GROUP BY 1""" for p in _PACKED))
def packed_quantiles(spark, sf):
    """Exact quantiles from running sums of values that fill a ten-millionth of [0, 1]."""
    price = (F.col("l_extendedprice") / F.lit(1e12)).alias("v")
    values = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), price).groupBy("flag", "v").agg(F.count("*").alias("w"))
    runs = running_sums(settle(values, "values"), ["flag"], "v", ["w"], rows=4000)
    return quantiles_from_runs(runs, ["flag"], "v", "w", _PACKED).withColumn("quantile", F.round("quantile", 12))


@query("fn_norm_quantile", f"""
    SELECT id, tot, {q(f'tot - {Z95!r} * sqrt(CAST(tot AS DOUBLE))')} AS lower, {q(f'tot + {Z95!r} * sqrt(CAST(tot AS DOUBLE))')} AS upper
    FROM (SELECT DISTINCT id, tot FROM sightings)""", "sightings")
def fn_norm_quantile(spark, sf):
    half = F.lit(norm_quantile(1 - 0.05 / 2)) * F.sqrt(F.col("tot").cast("double"))
    per_id = fx.sighting_days(spark, sf).groupBy("id").agg(F.count("*").alias("tot"))
    return per_id.select("id", "tot", r(F.col("tot") - half).alias("lower"), r(F.col("tot") + half).alias("upper"))


# ---- site fidelity ----------------------------------------------------------------------------------

def _features(spark, sf):
    return fidelity.fidelity_features(fx.sighting_days(spark, sf))


@query("fidelity_features", "SELECT id, " + ", ".join(f"{q(c)} AS {c}" for c in fidelity.FEATURES) + " FROM features",
       "features")
def fidelity_features(spark, sf):
    return _features(spark, sf).select("id", *[r(c).alias(c) for c in fidelity.FEATURES])


def _single(key, feature):
    @query(key, f"SELECT id, {q(feature)} AS {feature} FROM features", "features")
    def single(spark, sf):
        return _features(spark, sf).select("id", r(feature).alias(feature))


for _key, _feature in (
    ("span_time_rel", "span_time_rel"), ("periodicity", "periodicity"), ("resight_rate", "resight"),
    ("sight_rate", "sights"), ("monthly_rate", "m_rate"), ("yearly_rate", "y_rate"),
):
    _single(_key, _feature)
