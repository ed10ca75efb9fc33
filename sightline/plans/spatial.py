"""Spatial queries: layers, overlays, detection, intensity and posterior summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import normal
from sightline.operators import counts as ct
from sightline.operators import detect, geo
from sightline.operators import intensity as it
from sightline.plans import views  # noqa: F401  (oracle views)
from sightline.plans.registry import q, query, r, view
from sightline.session import settle, shared_path
from sightline.sources import fixtures as fx
from sightline.sources import tables as tb

STEP = 2.0
TRACK_STEP = 20.0
PARAMS = [(-4.0, -1.0), (-4.0, -0.5), (-3.5, -1.0), (-3.5, -0.5)]


# ---- oracle spellings -------------------------------------------------------------------------------

def cdf_sql(x: str) -> str:
    """Lower tail of the normal distribution as DuckDB text, from the same published coefficients."""
    z = f"abs({x})"

    def poly(cs):
        n = len(cs) - 1
        return "(" + " + ".join(f"{c!r} * power({z}, {n - i})" for i, c in enumerate(cs)) + ")"

    b = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        b = f"({z} + {k} / {b})"
    tail = f"""(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < {normal.RATIONAL_BELOW!r}
        THEN exp(-{z} * {z} / 2) * {poly(normal.NUMERATOR)} / {poly(normal.DENOMINATOR)}
        ELSE exp(-{z} * {z} / 2) / ({b} * {normal.ROOT_TWO_PI!r}) END)"""
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def log_cdf_sql(x: str) -> str:
    return f"(CASE WHEN {x} < -37 THEN -{x} * {x} / 2 - ln(-{x}) - 0.5 * ln(2 * pi()) ELSE ln({cdf_sql(x)}) END)"


def _inside(source: str, key: str) -> str:
    return f"""SELECT p.* FROM {source} p JOIN (
        SELECT p.{key} FROM {source} p, area_edges e
        WHERE (e.y1 <= p.y) <> (e.y2 <= p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
        GROUP BY p.{key} HAVING count(*) % 2 = 1) i ON i.{key} = p.{key}"""


def _distance(source: str, key: str) -> str:
    return f"""SELECT {key}, min(d) AS dist_obs, min_by(line_id, d) AS line_id FROM (
        SELECT {key}, line_id, sqrt(power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2)) AS d FROM (
          SELECT p.{key}, p.x, p.y, s.*, least(greatest(((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1))
                 / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0.0), 1.0) AS t
          FROM (SELECT {key}, x, y FROM {source}) p, ferry_segments s)) GROUP BY {key}"""


view("dist", _distance("points", "event_id"), "points ferry_segments")
view("inside", _inside("points", "event_id"), "points area_edges")
view("surf", """SELECT p.*, coalesce(g.z, 0) AS surf FROM points p LEFT JOIN social_grid g
    ON g.ix = CAST(floor(p.x / 2) AS INT) AND g.iy = CAST(floor(p.y / 2) AS INT)""", "points social_grid")
view("depths", """SELECT p.*, coalesce(g.z, 0) AS depth FROM points p LEFT JOIN depth_grid g
    ON g.ix = CAST(floor(p.x / 2) AS INT) AND g.iy = CAST(floor(p.y / 2) AS INT)""", "points depth_grid")
view("cells", _inside("(SELECT *, iy * 50 + ix AS cell FROM depth_grid)", "cell"), "depth_grid area_edges")
view("thin_social", f"SELECT * FROM (SELECT *, {cdf_sql('(surf / 0.5)')} AS pdetect FROM surf) WHERE u1 < pdetect", "surf")
view("thin_ferry", """SELECT * FROM (SELECT p.*, d.dist_obs, exp(-0.5 * power(d.dist_obs / 2, 2)) AS pdetect
    FROM points p JOIN dist d ON p.event_id = d.event_id) WHERE u2 < pdetect""", "points dist")


# ---- builders -----------------------------------------------------------------------------------------

def _edges(spark):
    return geo.ring_edges(fx.area_vertices(spark))


def _ferries(spark):
    return geo.line_segments(fx.ferry_vertices(spark))


def _surf(spark, df):
    return geo.point_grid_join(df, fx.social_grid(spark), STEP, STEP, "surf")


def _depth(spark, df):
    return geo.point_grid_join(df, fx.depth_grid(spark), STEP, STEP, "depth")


def _distance_to_ferry(spark, df, key="event_id"):
    return geo.nearest_line(df, _ferries(spark), key)


def _inside_area(spark, df, key="event_id"):
    return geo.inside_polygon(df, _edges(spark), key)


def _area_cells(spark, nx=50):
    """Cell centres of the depth raster inside the area."""
    cells = fx.depth_grid(spark, nx, nx).withColumn("cell", F.col("iy") * nx + F.col("ix"))
    return _inside_area(spark, cells, "cell")


def _thin_social(spark, sf):
    return detect.thin(detect.detect_social(_surf(spark, fx.points(spark, sf))), "u1")


def _thin_ferry(spark, sf):
    return detect.thin(detect.detect_ferry(_distance_to_ferry(spark, fx.points(spark, sf))), "u2")


# ---- layers ---------------------------------------------------------------------------------------------

_SEG = ("x1", "y1", "x2", "y2")


@query("scan_vertices", "SELECT line_id, seq, " + ", ".join(f"{q(c)} AS {c}" for c in _SEG) + " FROM track_segments",
       "track_segments")
def scan_vertices(spark, sf):
    tracks = fx.track_vertices(spark, sf)
    vertices = tb.scan_matrix(spark, tb.sink_table(tracks, shared_path(spark, "vertices")), tracks.schema)
    segments = geo.with_crs(geo.line_segments(vertices), _SEG)
    return segments.select("line_id", "seq", *[r(c).alias(c) for c in _SEG])


@query("points_layer", f"SELECT event_id, {q('x')} AS x, {q('y')} AS y, 1 AS d FROM points", "points")
def points_layer(spark, sf):
    layer = geo.points_layer(fx.points(spark, sf), "event_id")
    return layer.select("event_id", r("x").alias("x"), r("y").alias("y"), "d")


_RASTER = """SELECT ix, iy, ix * 2 + CAST(1 AS DOUBLE) AS x, iy * 2 + CAST(1 AS DOUBLE) AS y, avg(u1) AS z, count(*) AS n FROM (
    SELECT CAST(floor(x / 2) AS INT) AS ix, CAST(floor(y / 2) AS INT) AS iy, u1 FROM points) GROUP BY 1, 2"""
view("raster", _RASTER, "points")


def _raster(spark, sf):
    """A raster made from the points: mean of a mark and number of points per cell."""
    cells = fx.points(spark, sf).select(geo.cell("x", 0, STEP).alias("ix"), geo.cell("y", 0, STEP).alias("iy"), "u1")
    filled = cells.groupBy("ix", "iy").agg(F.avg("u1").alias("z"), F.count("*").alias("n"))
    return filled.select(((F.col("ix") + 0.5) * STEP).alias("x"), ((F.col("iy") + 0.5) * STEP).alias("y"), "z", "n")


@query("grid_layer", f"SELECT ix, iy, x, y, {q('z')} AS z, n FROM raster", "raster")
def grid_layer(spark, sf):
    return geo.grid_layer(_raster(spark, sf), STEP, STEP).withColumn("z", r("z"))


LATTICE = 200
view("ext", "SELECT min(x) AS xmin, min(y) AS ymin, (max(x) - min(x)) / 200.0 AS dx, (max(y) - min(y)) / 200.0 AS dy FROM points",
     "points")
view("lat", """SELECT CAST(id % 200 AS INT) AS ix, CAST(id // 200 AS INT) AS iy, id AS cell,
    xmin + (id % 200 + 0.5) * dx AS x, ymin + (id // 200 + 0.5) * dy AS y
    FROM (SELECT range AS id FROM range(40000)) r, ext""", "ext")


@query("pixel_lattice", f"""
    SELECT l.ix, l.iy, {q('l.x')} AS x, {q('l.y')} AS y, coalesce(c.n, 0) AS n FROM ({_inside('lat', 'cell')}) l LEFT JOIN (
      SELECT CAST(floor((x - xmin) / dx) AS INT) AS ix, CAST(floor((y - ymin) / dy) AS INT) AS iy, count(*) AS n
      FROM points, ext GROUP BY 1, 2) c ON l.ix = c.ix AND l.iy = c.iy""", "points lat area_edges")
def pixel_lattice(spark, sf):
    pts = fx.points(spark, sf)
    box = geo.extent(pts)
    lattice = geo.pixel_lattice(spark, LATTICE, LATTICE, box).withColumn("cell", F.col("iy") * LATTICE + F.col("ix"))
    counts = pts.groupBy(
        geo.cell("x", box["xmin"], (box["xmax"] - box["xmin"]) / float(LATTICE)).alias("ix"),
        geo.cell("y", box["ymin"], (box["ymax"] - box["ymin"]) / float(LATTICE)).alias("iy"),
    ).agg(F.count("*").alias("n"))
    kept = _inside_area(spark, lattice, "cell").join(counts, ["ix", "iy"], "left").fillna(0, ["n"])
    return kept.select("ix", "iy", r("x").alias("x"), r("y").alias("y"), "n")


@query("raster_mask_crop", f"""
    SELECT ix, iy, {q('z')} AS z, n FROM ({_inside('(SELECT *, iy * 10000 + ix AS cell FROM raster)', 'cell')})""",
       "raster area_edges")
def raster_mask_crop(spark, sf):
    ring = fx.area_vertices(spark)
    box = geo.extent(ring)
    layer = geo.grid_layer(_raster(spark, sf), STEP, STEP)
    cropped = layer.filter(F.col("x").between(box["xmin"], box["xmax"]) & F.col("y").between(box["ymin"], box["ymax"]))
    masked = geo.inside_polygon(cropped.withColumn("cell", F.col("iy") * 10000 + F.col("ix")), geo.ring_edges(ring), "cell")
    return masked.select("ix", "iy", r("z").alias("z"), "n")


# ---- overlays -------------------------------------------------------------------------------------------

@query("point_grid_join", f"SELECT event_id, {q('surf')} AS surf FROM surf", "surf")
def point_grid_join(spark, sf):
    return _surf(spark, fx.points(spark, sf).select("event_id", "x", "y")).select("event_id", r("surf").alias("surf"))


@query("nearest_line", f"SELECT event_id, {q('dist_obs')} AS dist_obs, line_id FROM dist", "dist")
def nearest_line(spark, sf):
    out = _distance_to_ferry(spark, fx.points(spark, sf).select("event_id", "x", "y"))
    return out.select("event_id", r("dist_obs").alias("dist_obs"), "line_id")


@query("point_in_polygon", "SELECT event_id, stype FROM inside", "inside")
def point_in_polygon(spark, sf):
    return _inside_area(spark, fx.points(spark, sf).select("event_id", "stype", "x", "y")).select("event_id", "stype")


_CURVE = "SELECT draw, i, exp(-0.5 * power(i / 10.0 / sigma, 2)) AS value FROM (SELECT draw, {0} AS sigma FROM draws), " \
         "(SELECT range AS i FROM range(71))".format(f"-{log_cdf_sql('(-theta_sig)')} / 0.5")
view("curve_ferry", _CURVE, "draws")
view("curve_social", f"""SELECT draw, i, {cdf_sql('v')} AS value FROM (
    SELECT draw, i - 40 AS i, (i - 40) / 10.0 / scale + loc AS v
    FROM (SELECT draw, loc, -{log_cdf_sql('(-theta_scale)')} / 1.0 AS scale FROM draws), (SELECT range AS i FROM range(71)))""",
     "draws")


@query("cross_grid", f"SELECT draw, CAST(i AS INT) AS i, {q('value')} AS value FROM curve_ferry", "curve_ferry")
def cross_grid(spark, sf):
    return it.curve_ferry(fx.draws(spark, sf)).withColumn("value", r("value"))


# ---- functions --------------------------------------------------------------------------------------------

@query("fn_norm_cdf", f"""SELECT event_id, {q(cdf_sql('z'))} AS p, {q(log_cdf_sql('z'))} AS log_p, {q(cdf_sql('(-z)'))} AS upper_p
    FROM (SELECT event_id, (x - 80) / 2 AS z FROM points)""", "points")
def fn_norm_cdf(spark, sf):
    z = fx.points(spark, sf).select("event_id", ((F.col("x") - 80) / 2).alias("z"))
    p = F.col("z")
    return z.select(
        "event_id", r(normal.norm_cdf(p)).alias("p"), r(normal.log_norm_cdf(p)).alias("log_p"),
        r(normal.norm_upper(p)).alias("upper_p"),
    )


@query("fn_exp_link", f"""SELECT draw, {q(f"-{log_cdf_sql('(-theta_scale)')} / 1.0")} AS scale,
    {q(f"-{log_cdf_sql('(-theta_sig)')} / 0.5")} AS sigma FROM draws""", "draws")
def fn_exp_link(spark, sf):
    return fx.draws(spark, sf).select(
        "draw", r(normal.exp_link(F.col("theta_scale"), detect.SOCIAL_RATE)).alias("scale"),
        r(normal.exp_link(F.col("theta_sig"), detect.FERRY_RATE)).alias("sigma"),
    )


# ---- detection ----------------------------------------------------------------------------------------------

@query("detect_social", f"SELECT event_id, {q(cdf_sql('(surf / 0.5)'))} AS pdetect FROM surf", "surf")
def detect_social(spark, sf):
    out = detect.detect_social(_surf(spark, fx.points(spark, sf)))
    return out.select("event_id", r("pdetect").alias("pdetect"))


@query("detect_ferry", f"SELECT event_id, {q('exp(-0.5 * power(dist_obs / 2, 2))')} AS pdetect FROM dist", "dist")
def detect_ferry(spark, sf):
    out = detect.detect_ferry(_distance_to_ferry(spark, fx.points(spark, sf)))
    return out.select("event_id", r("pdetect").alias("pdetect"))


@query("log_detect_social", f"SELECT event_id, {q(log_cdf_sql('(surf / 0.7 + 0.1)'))} AS log_g FROM surf", "surf")
def log_detect_social(spark, sf):
    g = detect.log_detect_social(F.col("surf"), scale=0.7, shift=0.1)
    return _surf(spark, fx.points(spark, sf)).select("event_id", r(g).alias("log_g"))


@query("log_detect_ferry", f"SELECT event_id, {q('-0.5 * power(dist_obs / 2, 2)', 5)} AS log_g FROM dist", "dist")
def log_detect_ferry(spark, sf):
    g = detect.log_detect_ferry(F.col("dist_obs"), detect.FERRY_SIGMA)
    return _distance_to_ferry(spark, fx.points(spark, sf)).select("event_id", r(g, 5).alias("log_g"))


@query("thin_social", f"SELECT event_id, {q('pdetect')} AS pdetect FROM thin_social", "thin_social")
def thin_social(spark, sf):
    return _thin_social(spark, sf).select("event_id", r("pdetect").alias("pdetect"))


@query("thin_ferry", f"SELECT event_id, {q('dist_obs')} AS dist_obs, {q('pdetect')} AS pdetect FROM thin_ferry", "thin_ferry")
def thin_ferry(spark, sf):
    return _thin_ferry(spark, sf).select("event_id", r("dist_obs").alias("dist_obs"), r("pdetect").alias("pdetect"))


@query("stack_sources", f"""
    SELECT event_id, {q('x')} AS x, {q('y')} AS y, CAST(NULL AS DOUBLE) AS dist_obs, 'Social' AS type FROM thin_social
    UNION ALL SELECT event_id, {q('x')}, {q('y')}, {q('dist_obs')}, 'FERRY' FROM thin_ferry
    UNION ALL SELECT p.event_id, {q('x')}, {q('y')}, {q('dist_obs')}, 'UNIRM' FROM points p
      JOIN dist d ON p.event_id = d.event_id WHERE stype = 'UNIRM'""", "thin_social thin_ferry points dist")
def stack_sources(spark, sf):
    boat = _distance_to_ferry(spark, fx.points(spark, sf).filter("stype = 'UNIRM'"))
    place = ["event_id", r("x").alias("x"), r("y").alias("y")]
    stacked = ct.stack_labelled({
        "FERRY": _thin_ferry(spark, sf).select(*place, r("dist_obs").alias("dist_obs")),
        "UNIRM": boat.select(*place, r("dist_obs").alias("dist_obs")),
        "Social": _thin_social(spark, sf).select(*place),
    }, "type")
    return stacked


# ---- intensity ------------------------------------------------------------------------------------------------

@query("log_intensity", f"SELECT event_id, {q('-4 - depth')} AS log_lambda FROM depths", "depths")
def log_intensity(spark, sf):
    out = _depth(spark, fx.points(spark, sf).select("event_id", "x", "y"))
    return out.select("event_id", r(it.log_intensity(F.col("depth"))).alias("log_lambda"))


def _cell_counts(spark, df):
    return df.groupBy(geo.cell("x", 0, STEP).alias("ix"), geo.cell("y", 0, STEP).alias("iy")).agg(F.count("*").alias("n"))


@query("quadrature_area", """
    SELECT c.ix, c.iy, c.x, c.y, CAST(4 AS DOUBLE) AS w, coalesce(n, 0) AS n FROM cells c LEFT JOIN (
      SELECT CAST(floor(x / 2) AS INT) AS ix, CAST(floor(y / 2) AS INT) AS iy, count(*) AS n FROM points GROUP BY 1, 2) p
      ON c.ix = p.ix AND c.iy = p.iy""", "cells points")
def quadrature_area(spark, sf):
    rows = _area_cells(spark).join(_cell_counts(spark, fx.points(spark, sf)), ["ix", "iy"], "left").fillna(0, ["n"])
    return rows.select("ix", "iy", "x", "y", F.lit(STEP * STEP).alias("w"), "n")


def _transect_sql(source: str, step: float) -> str:
    return f"""SELECT line_id, seq, j, CAST(k AS INT) AS knot, k * 1.75 AS dist_obs,
        x1 + (j + 0.5) / steps * (x2 - x1) AS x, y1 + (j + 0.5) / steps * (y2 - y1) AS y,
        len / steps * 1.75 * CASE WHEN k IN (0, 4) THEN 0.5 ELSE 1.0 END AS w
        FROM (SELECT *, unnest(range(0, steps)) AS j FROM (
                SELECT *, CAST(greatest(ceil(len / {step}), 1) AS BIGINT) AS steps FROM (
                  SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len FROM {source}))),
             (SELECT range AS k FROM range(5))"""


@query("quadrature_transect", "SELECT line_id, seq, j, knot, " + ", ".join(
    f"{q(c)} AS {c}" for c in ("dist_obs", "x", "y", "w")) + f" FROM ({_transect_sql('track_segments', TRACK_STEP)})",
       "track_segments")
def quadrature_transect(spark, sf):
    rows = it.quadrature_transect(geo.line_segments(fx.track_vertices(spark, sf)), TRACK_STEP)
    return rows.select("line_id", "seq", "j", "knot", *[r(c).alias(c) for c in ("dist_obs", "x", "y", "w")])


@query("hat_basis", f"""SELECT event_id, CAST(k AS INT) AS knot, {q('greatest(0, 1 - abs(dist_obs - k * 1.75) / 1.75)')} AS basis
    FROM dist, (SELECT range AS k FROM range(5))""", "dist")
def hat_basis(spark, sf):
    out = it.hat_basis(_distance_to_ferry(spark, fx.points(spark, sf).select("event_id", "x", "y")))
    return out.select("event_id", "knot", r("basis").alias("basis"))


_SETS = ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in PARAMS)
_LIK = """SELECT '{0}' AS source, b0, b1, n, n * b0 + b1 * sd + sg - integral AS loglik FROM
    (SELECT count(*) AS n, sum(depth) AS sd, sum(log_g) AS sg FROM ({1})),
    (SELECT b0, b1, sum(w * exp(b0 + b1 * depth + log_g)) AS integral
     FROM ({2}), (VALUES """ + _SETS + """) AS v(b0, b1) GROUP BY b0, b1)"""
_G_SOCIAL = log_cdf_sql("(surf / 0.5)")
view("lik", _LIK.format(
    "social",
    f"""SELECT t.event_id, d.depth, {_G_SOCIAL} AS log_g FROM thin_social t JOIN depths d ON d.event_id = t.event_id
        JOIN inside i ON i.event_id = t.event_id""",
    f"""SELECT 4.0 AS w, c.z AS depth, {_G_SOCIAL} AS log_g FROM (
        SELECT c.*, coalesce(s.z, 0) AS surf FROM cells c LEFT JOIN social_grid s ON s.ix = c.ix AND s.iy = c.iy) c""",
) + " UNION ALL " + _LIK.format(
    "ferry",
    """SELECT d.depth, -0.5 * power(t.dist_obs / 2, 2) AS log_g FROM thin_ferry t JOIN depths d ON d.event_id = t.event_id
       WHERE t.dist_obs <= 7""",
    f"""SELECT t.w, coalesce(g.z, 0) AS depth, -0.5 * power(t.dist_obs / 2, 2) AS log_g
        FROM ({_transect_sql('ferry_segments', 1.0)}) t LEFT JOIN depth_grid g
          ON g.ix = CAST(floor(t.x / 2) AS INT) AND g.iy = CAST(floor(t.y / 2) AS INT)""",
), "thin_social thin_ferry depths inside cells social_grid depth_grid ferry_segments")


@query("pp_loglik", f"""SELECT source, b0, b1, n, {q('loglik', 4)} AS loglik FROM lik
    UNION ALL SELECT 'joint', b0, b1, CAST(sum(n) AS BIGINT), {q('sum(loglik)', 4)} FROM lik GROUP BY b0, b1""", "lik")
def pp_loglik(spark, sf):
    g_social = detect.log_detect_social(F.col("surf"), detect.SOCIAL_SCALE, 0.0)
    g_ferry = detect.log_detect_ferry(F.col("dist_obs"), detect.FERRY_SIGMA)
    seen = _depth(spark, _inside_area(spark, _thin_social(spark, sf))).withColumn("log_g", g_social)
    area = _surf(spark, _area_cells(spark).withColumnRenamed("z", "depth")).select(
        F.lit(STEP * STEP).alias("w"), "depth", g_social.alias("log_g"))
    ferry = _depth(spark, _thin_ferry(spark, sf).filter(F.col("dist_obs") <= it.DISTANCE_LIMIT)).withColumn("log_g", g_ferry)
    track = _depth(spark, it.quadrature_transect(_ferries(spark), 1.0)).select("w", "depth", g_ferry.alias("log_g"))
    parts = ct.stack_labelled({
        "social": it.pp_loglik(seen, area, PARAMS), "ferry": it.pp_loglik(ferry, track, PARAMS),
    }, "source").select("source", "b0", "b1", "n", "loglik")
    parts = settle(parts, "loglik")
    joint = parts.groupBy("b0", "b1").agg(F.sum("n").alias("n"), F.sum("loglik").alias("loglik"))
    stacked = parts.unionByName(joint.withColumn("source", F.lit("joint")))
    return stacked.withColumn("loglik", r("loglik", 4))


_SEEN = {
    "social": "SELECT d.depth FROM thin_social t JOIN depths d ON d.event_id = t.event_id JOIN inside i ON i.event_id = t.event_id",
    "ferry": "SELECT d.depth FROM thin_ferry t JOIN depths d ON d.event_id = t.event_id WHERE t.dist_obs <= 7",
}
view("quadrature", f"""SELECT CAST(4 AS DOUBLE) AS w, depth, {_G_SOCIAL} AS log_g FROM (
      SELECT c.z AS depth, coalesce(s.z, 0) AS surf FROM cells c LEFT JOIN social_grid s ON s.ix = c.ix AND s.iy = c.iy)
    UNION ALL SELECT t.w, coalesce(g.z, 0), -0.5 * power(t.dist_obs / 2, 2) FROM ({_transect_sql('ferry_segments', 1.0)}) t
      LEFT JOIN depth_grid g ON g.ix = CAST(floor(t.x / 2) AS INT) AND g.iy = CAST(floor(t.y / 2) AS INT)""",
     "cells social_grid ferry_segments depth_grid")
_FIT_SQL = f"""
    , seen AS (SELECT count(*) AS n, sum(depth) AS sd FROM ({' UNION ALL '.join(_SEEN.values())})),
    newton AS (
      SELECT 0 AS step, ln(any_value(n) / sum(w * exp(log_g))) AS b0, CAST(0 AS DOUBLE) AS b1 FROM quadrature, seen
      UNION ALL
      SELECT step + 1, b0 + (s2 * (n - s0) - s1 * (sd - s1)) / (s0 * s2 - s1 * s1), b1 + (s0 * (sd - s1) - s1 * (n - s0)) / (s0 * s2 - s1 * s1)
      FROM (SELECT step, b0, b1, sum(m) AS s0, sum(m * depth) AS s1, sum(m * depth * depth) AS s2
            FROM (SELECT *, w * exp(b0 + b1 * depth + log_g) AS m FROM newton, quadrature) GROUP BY step, b0, b1), seen
      WHERE step < {it.NEWTON_STEPS}),
    last AS (SELECT b0, b1 FROM newton WHERE step = {it.NEWTON_STEPS}),
    fitted AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(m) AS s0, sum(m * depth) AS s1
               FROM (SELECT *, w * exp(b0 + b1 * depth + log_g) AS m FROM last, quadrature))
    SELECT {q('b0')} AS intercept, {q('b1')} AS beta_depth, n AS n_points, {q('s0')} AS n_fitted, {q('n - s0')} AS score0, {q('sd - s1')} AS score1
    FROM fitted, seen"""


@query("poisson_intensity_fit", _FIT_SQL, "thin_social thin_ferry depths inside quadrature")
def poisson_intensity_fit(spark, sf):
    """Both sources at once: area cells for the social points, transect steps times distance knots for the ferry points."""
    g_social = detect.log_detect_social(F.col("surf"), detect.SOCIAL_SCALE, 0.0)
    g_ferry = detect.log_detect_ferry(F.col("dist_obs"), detect.FERRY_SIGMA)
    seen = _depth(spark, _inside_area(spark, _thin_social(spark, sf))).select("depth").unionByName(
        _depth(spark, _thin_ferry(spark, sf).filter(F.col("dist_obs") <= it.DISTANCE_LIMIT)).select("depth"))
    area = _surf(spark, _area_cells(spark).withColumnRenamed("z", "depth")).select(
        F.lit(STEP * STEP).alias("w"), "depth", g_social.alias("log_g"))
    track = _depth(spark, it.quadrature_transect(_ferries(spark), 1.0)).select("w", "depth", g_ferry.alias("log_g"))
    fit = it.poisson_intensity_fit(seen, settle(area.unionByName(track), "quadrature"))
    return fit.select("n_points", *[r(c).alias(c) for c in ("intercept", "beta_depth", "n_fitted")], *[
        (r(c) + 0.0).alias(c) for c in ("score0", "score1")])


@query("binned_intensity", f"""
    SELECT c.band, c.exposure, coalesce(p.n, 0) AS n, {q('coalesce(p.n, 0) / c.exposure')} AS rate FROM
    (SELECT CAST(floor(z * 4) AS INT) AS band, count(*) * CAST(4 AS DOUBLE) AS exposure FROM cells GROUP BY 1) c LEFT JOIN
    (SELECT CAST(floor(depth * 4) AS INT) AS band, count(*) AS n FROM depths d JOIN inside i ON i.event_id = d.event_id GROUP BY 1) p
    ON c.band = p.band""", "cells depths inside")
def binned_intensity(spark, sf):
    pts = _depth(spark, _inside_area(spark, fx.points(spark, sf).select("event_id", "x", "y")))
    out = it.binned_intensity(pts, _area_cells(spark).withColumnRenamed("z", "depth"), STEP * STEP)
    return out.select("band", "exposure", "n", r("rate").alias("rate"))


# ---- draws ----------------------------------------------------------------------------------------------------

view("grid20", """SELECT CAST(id % 20 AS INT) AS ix, CAST(id // 20 AS INT) AS iy, id AS cell,
    CAST(5 * (id % 20) AS DOUBLE) + 2.5 AS x, CAST(5 * (id // 20) AS DOUBLE) + 2.5 AS y,
    1 + sin((5 * (id % 20) + CAST(2.5 AS DOUBLE)) / 15) * cos((5 * (id // 20) + CAST(2.5 AS DOUBLE)) / 20) AS z
    FROM (SELECT range AS id FROM range(400)) r""")
view("cells20", _inside("grid20", "cell"), "grid20 area_edges")
view("grid200", """SELECT CAST(id % 200 AS INT) AS ix, CAST(id // 200 AS INT) AS iy, id AS cell,
    CAST(id % 200 AS DOUBLE) / 2 + 0.25 AS x, CAST(id // 200 AS DOUBLE) / 2 + 0.25 AS y,
    1 + sin((CAST(id % 200 AS DOUBLE) / 2 + 0.25) / 15) * cos((CAST(id // 200 AS DOUBLE) / 2 + 0.25) / 20) AS z
    FROM (SELECT range AS id FROM range(40000)) r""")
view("cells200", _inside("grid200", "cell"), "grid200 area_edges")


def _pixels(spark, nx):
    return settle(_area_cells(spark, nx).select("cell", F.col("z").alias("depth")), "pixels")


@query("predict_draws", f"""SELECT draw, CAST(cell AS INT) AS cell, {q('exp(b0 + b1 * z)')} AS value FROM draws, cells20""",
       "draws cells20")
def predict_draws(spark, sf):
    return it.predict_draws(fx.draws(spark, sf), _pixels(spark, 20), 400).withColumn("value", r("value"))


def _lattice_draws(spark, draws, blocks=None):
    """Every draw on every pixel of the full lattice."""
    return it.predict_draws(draws, _pixels(spark, LATTICE), LATTICE ** 2, blocks)


@query("predict_draws_lattice", f"""SELECT draw, count(*) AS n, {q('avg(value)')} AS m, {q('min(value)')} AS lo, {q('max(value)')} AS hi
    FROM (SELECT draw, exp(b0 + b1 * z) AS value FROM draws, cells200) GROUP BY draw""", "draws cells200")
def predict_draws_lattice(spark, sf):
    """An aggregate over all draws and pixels, as the rows themselves (500 draws x 200 x 200) are too many to compare."""
    return _lattice_draws(spark, fx.draws(spark, sf)).groupBy("draw").agg(
        F.count("*").alias("n"), r(F.avg("value")).alias("m"), r(F.min("value")).alias("lo"), r(F.max("value")).alias("hi"))


def _pixel_quantiles(spark, sf, probs):
    draws = fx.draws(spark, sf)
    return it.over_draws(_lattice_draws(spark, draws, it.CELL_BLOCKS), ["cell"], probs, draws)


_PIXEL = "SELECT CAST(cell AS INT) AS cell, {} FROM (SELECT cell, exp(b0 + b1 * z) AS value FROM draws, cells200) GROUP BY cell"


@query("pixel_median", _PIXEL.format(f"{q('quantile_cont(value, 0.5)')} AS m"), "draws cells200")
def pixel_median(spark, sf):
    return _pixel_quantiles(spark, sf, {"m": 0.5}).withColumn("m", r("m"))


@query("pixel_rwpci", _PIXEL.format(f"""{q('quantile_cont(value, 0.5)')} AS m, {q('quantile_cont(value, 0.25)')} AS q25,
    {q('quantile_cont(value, 0.75)')} AS q75,
    {q('(quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / quantile_cont(value, 0.5)')} AS rwpci"""), "draws cells200")
def pixel_rwpci(spark, sf):
    out = it.relative_width(_pixel_quantiles(spark, sf, it.QUARTILES))
    return out.select("cell", *[r(c).alias(c) for c in ("m", "q25", "q75", "rwpci")])


_BAND = "SELECT CAST(i AS INT) AS i, " + ", ".join(
    f"{q(f'quantile_cont(value, {p})')} AS {n}" for n, p in it.BAND.items()) + " FROM {} GROUP BY i"


def _band(spark, sf, curve):
    draws = fx.draws(spark, sf)
    return it.over_draws(curve(draws), ["i"], it.BAND, draws)


@query("curve_band_social", _BAND.format("curve_social"), "curve_social")
def curve_band_social(spark, sf):
    return _band(spark, sf, it.curve_social).select("i", *[r(c).alias(c) for c in it.BAND])


@query("curve_band_ferry", _BAND.format("curve_ferry"), "curve_ferry")
def curve_band_ferry(spark, sf):
    return _band(spark, sf, it.curve_ferry).select("i", *[r(c).alias(c) for c in it.BAND])


_TRUE = """SELECT '{0}' AS source, CAST(i AS INT) AS i, {1} AS truth, {1} BETWEEN lo AND hi AS covered FROM (
    SELECT i, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM {2} GROUP BY i)"""


@query("true_curve", _TRUE.format("social", q(cdf_sql("(i / 10.0 / 0.5)")), "curve_social") + " UNION ALL " + _TRUE.format(
    "ferry", q("exp(-0.5 * power(i / 10.0 / 2, 2))"), "curve_ferry"), "curve_social curve_ferry")
def true_curve(spark, sf):
    x = F.col("i") / F.lit(10.0)
    truths = {
        "social": (it.curve_social, normal.norm_cdf(x, detect.SOCIAL_LOCATION, detect.SOCIAL_SCALE)),
        "ferry": (it.curve_ferry, it.half_normal(x, detect.FERRY_SIGMA)),
    }
    return ct.stack_labelled({
        name: _band(spark, sf, curve).withColumn("truth", r(truth))
        .select("i", "truth", F.col("truth").between(F.col("q1"), F.col("q2")).alias("covered"))
        for name, (curve, truth) in truths.items()
    }, "source")


@query("draw_surfaces", f"""SELECT draw, CAST(cell AS INT) AS cell, {q('exp(b0 + b1 * z)')} AS value FROM (
    SELECT * FROM draws ORDER BY (draw * 1103515245 + 12345) % 2147483648, draw LIMIT 4), cells200""", "draws cells200")
def draw_surfaces(spark, sf):
    chosen = ct.sample_rows(fx.draws(spark, sf), "draw", 4)
    return it.predict_draws(chosen, _pixels(spark, LATTICE), LATTICE ** 2).withColumn("value", r("value"))
