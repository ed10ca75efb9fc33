"""Spatial intensity: quadrature, likelihood, fits, and summaries over posterior draws.

The random spatial field of the study is not modelled; the intensity is log-linear in depth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.normal import exp_link, norm_cdf
from sightline.functions.scalar import half_normal
from sightline.operators.detect import FERRY_RATE, SOCIAL_RATE
from sightline.operators.ranks import bounded_quantiles, group_quantiles, is_small

# True intercept and depth slope of the study's simulation.
BETA0, BETA_DEPTH = -4.0, -1.0
# The distance knots (0 to 7 km in five steps) and the evaluation grids in tenths.
DISTANCE_LIMIT, KNOTS = 7.0, 5
SOCIAL_TENTHS, FERRY_TENTHS = (-40, 30), (0, 70)

DRAWS_IN_ONE_GROUP = 4_096
CELL_BLOCKS = 64
NEWTON_STEPS = 25
BAND = {"m": 0.5, "q1": 0.025, "q2": 0.975}
QUARTILES = {"m": 0.5, "q25": 0.25, "q75": 0.75}


def log_intensity(depth: Column, b0: Column | float = BETA0, b1: Column | float = BETA_DEPTH) -> Column:
    b0, b1 = (F.lit(float(b)) if isinstance(b, (int, float)) else b for b in (b0, b1))
    return b0 + b1 * depth


def knot_step() -> float:
    return DISTANCE_LIMIT / (KNOTS - 1)


def hat_basis(df: DataFrame, distance: str = "dist_obs") -> DataFrame:
    """Degree-1 basis of a distance on the knots, one row per knot."""
    h = knot_step()
    knot = F.explode(F.sequence(F.lit(0), F.lit(KNOTS - 1))).alias("knot")
    value = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col(distance) - F.col("knot") * F.lit(h)) / F.lit(h))
    return df.select("*", knot).withColumn("basis", value)


def quadrature_transect(segments: DataFrame, step: float) -> DataFrame:
    """Integration rows along tracks times distance knots: midpoints along, trapezoid across."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2)))
    steps = F.greatest(F.ceil(F.col("length") / F.lit(float(step))), F.lit(1))
    along = segments.withColumn("length", length).withColumn("steps", steps)
    along = along.select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("j"))
    part = (F.col("j") + 0.5) / F.col("steps")
    rows = along.withColumns({
        "x": F.col("x1") + part * (F.col("x2") - F.col("x1")),
        "y": F.col("y1") + part * (F.col("y2") - F.col("y1")),
    }).select("*", F.explode(F.sequence(F.lit(0), F.lit(KNOTS - 1))).alias("knot"))
    edge = F.when(F.col("knot").isin(0, KNOTS - 1), 0.5).otherwise(1.0)
    h = F.lit(knot_step())
    return rows.withColumns({
        "dist_obs": F.col("knot") * h, "w": F.col("length") / F.col("steps") * h * edge,
    }).drop("x1", "y1", "x2", "y2", "length", "steps")


def pp_loglik(points: DataFrame, quadrature: DataFrame, params: list[tuple[float, float]]) -> DataFrame:
    """Point-process log-likelihood of each (b0, b1): sum of log intensity minus its integral.

    Both inputs carry ``depth`` and ``log_g`` (log detection), the quadrature also ``w``. The point
    sum is linear in the parameters, so three totals serve every parameter set.
    """
    sets = F.explode(F.array(*[F.struct(F.lit(a).alias("b0"), F.lit(b).alias("b1")) for a, b in params])).alias("s")
    sums = points.agg(F.count("*").alias("n"), F.sum("depth").alias("depth"), F.sum("log_g").alias("log_g"))
    at_points = sums.select("*", sets).select(
        F.col("s.b0").alias("b0"), F.col("s.b1").alias("b1"), "n",
        (F.col("n") * F.col("s.b0") + F.col("s.b1") * F.coalesce("depth", F.lit(0.0)) + F.coalesce("log_g", F.lit(0.0))).alias("points"),
    )
    rate = F.exp(log_intensity(F.col("depth"), F.col("s.b0"), F.col("s.b1")) + F.col("log_g"))
    integral = quadrature.select("w", "depth", "log_g", sets).groupBy(
        F.col("s.b0").alias("b0"), F.col("s.b1").alias("b1")
    ).agg(F.sum(F.col("w") * rate).alias("integral"))
    return at_points.join(integral, ["b0", "b1"]).withColumn("loglik", F.col("points") - F.col("integral"))


def poisson_intensity_fit(points: DataFrame, quadrature: DataFrame, steps: int = NEWTON_STEPS, tolerance: float = 1e-11) -> DataFrame:
    """Intercept and depth slope that maximise the joint point-process likelihood of all sources. One row.

    ``points`` holds the observed points with ``depth``, ``quadrature`` the integration rows of every source (area cells, or transect
    steps times distance knots) with ``w``, ``depth`` and ``log_g``, the log detection. The points enter by their number and their sum of
    depths; every Newton step is one aggregate over the quadrature, whatever its size, and steps end when the score equations hold to
    ``tolerance`` of the number of points. ``score0`` and ``score1`` are what is left of them, ``n_fitted`` is the integral.
    """
    seen = points.agg(F.count("*").alias("n"), F.coalesce(F.sum("depth"), F.lit(0.0)).alias("depth")).first()
    rows = quadrature.select("w", "depth", "log_g")

    def sums(b0: float, b1: float) -> tuple[float, float, float]:
        rate = F.col("w") * F.exp(log_intensity(F.col("depth"), b0, b1) + F.col("log_g"))
        found = rows.agg(F.sum(rate), F.sum(rate * F.col("depth")), F.sum(rate * F.col("depth") * F.col("depth"))).first()
        return tuple(float(v or 0.0) for v in found)

    kind = "intercept double, beta_depth double, n_points bigint, n_fitted double, score0 double, score1 double"
    whole = sums(0.0, 0.0)
    if not seen["n"] or not whole[0]:
        return points.sparkSession.createDataFrame([(None, None, seen["n"], None, None, None)], kind)
    b0, b1 = math.log(seen["n"] / whole[0]), 0.0
    for _ in range(steps):
        s0, s1, s2 = sums(b0, b1)
        g0, g1, det = seen["n"] - s0, seen["depth"] - s1, s0 * s2 - s1 * s1
        if max(abs(g0), abs(g1)) <= tolerance * seen["n"]:
            break
        if det <= 1e-12 * s0 * s2:  # depth does not vary: the intercept alone
            b0 += g0 / s0
            continue
        b0, b1 = b0 + (s2 * g0 - s1 * g1) / det, b1 + (s0 * g1 - s1 * g0) / det
    s0, s1, _ = sums(b0, b1)
    return points.sparkSession.createDataFrame([(b0, b1, seen["n"], s0, seen["n"] - s0, seen["depth"] - s1)], kind)


def binned_intensity(points: DataFrame, cells: DataFrame, area: float, per_unit: float = 4.0) -> DataFrame:
    """Points per unit area by depth band: both inputs carry ``depth``; ``cells`` cover the exposure."""
    band = F.floor(F.col("depth") * per_unit).cast("int").alias("band")
    exposure = cells.groupBy(band).agg((F.count("*") * F.lit(area)).alias("exposure"))
    hits = points.groupBy(band).agg(F.count("*").alias("n"))
    return exposure.join(hits, "band", "left").fillna(0, ["n"]).withColumn("rate", F.col("n") / F.col("exposure"))


# ---- draws ----------------------------------------------------------------------------------------

def _spread(draws: DataFrame) -> DataFrame:
    """Draws over all tasks before each is expanded: a few small rows become many, so one file block
    of draws would otherwise expand in one task."""
    tasks = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return draws.repartition(tasks, "draw")


def predict_draws(draws: DataFrame, pixels: DataFrame, n_cells: int, blocks: int | None = None) -> DataFrame:
    """exp(b0 + b1 depth) for every draw and pixel.

    ``pixels`` holds cell (0 .. n_cells - 1) and depth, and may hold a ``field`` term. Each draw
    generates the cell numbers, which then meet the pixel table, of at most ``n_cells`` rows, where they are. With ``blocks``, tasks
    share the cells instead of the draws: one task sees all draws of a cell, so a count by cell moves one row a cell.
    """
    field = F.coalesce("field", F.lit(0.0)) if "field" in pixels.columns else F.lit(0.0)
    value = F.exp(log_intensity(F.col("depth"), F.col("b0"), F.col("b1")) + field)
    own = draws.select("draw", "b0", "b1")
    if blocks is None:
        spread, low, high = _spread(own), F.lit(0), F.lit(n_cells - 1)
    else:
        size = -(-n_cells // blocks)
        numbers = F.explode(F.sequence(F.lit(0), F.lit((n_cells - 1) // size))).alias("block")
        spread = own.select("*", numbers).repartitionByRange(blocks, "block")
        low, high = F.col("block") * size, F.least((F.col("block") + 1) * size, F.lit(n_cells)) - 1
    expanded = spread.select("draw", "b0", "b1", F.explode(F.sequence(low, high)).alias("cell"))
    return expanded.join(F.broadcast(pixels), "cell").select("draw", "cell", value.alias("value"))


def curve_social(draws: DataFrame) -> DataFrame:
    """Phi(x / scale + loc) of every draw on the media-intensity grid."""
    lo, hi = SOCIAL_TENTHS
    spread = _spread(draws.select("draw", "loc", "theta_scale"))
    scaled = spread.select("draw", "loc", exp_link(F.col("theta_scale"), SOCIAL_RATE).alias("scale"))
    grid = scaled.select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("i"))
    return grid.select("draw", "i", norm_cdf(F.col("i") / F.lit(10.0) / F.col("scale") + F.col("loc")).alias("value"))


def curve_ferry(draws: DataFrame) -> DataFrame:
    """exp(-(x / sigma)^2 / 2) of every draw on the distance grid."""
    lo, hi = FERRY_TENTHS
    spread = _spread(draws.select("draw", "theta_sig"))
    scaled = spread.select("draw", exp_link(F.col("theta_sig"), FERRY_RATE).alias("sigma"))
    grid = scaled.select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("i"))
    return grid.select("draw", "i", half_normal(F.col("i") / F.lit(10.0), F.col("sigma")).alias("value"))


def over_draws(values: DataFrame, keys: list[str], probs: dict[str, float], draws: DataFrame) -> DataFrame:
    """Quantiles over draws. A group holds one value per draw: when the draws are few (checked) they
    are ranked in one aggregation buffer, otherwise by the distributed form, which moves counts instead of values."""
    if is_small(draws, DRAWS_IN_ONE_GROUP):
        return bounded_quantiles(values, keys, "value", probs)
    return group_quantiles(values, keys, "value", probs)


def relative_width(quartiles: DataFrame) -> DataFrame:
    """(q75 - q25) / median."""
    return quartiles.withColumn("rwpci", F.try_divide(F.col("q75") - F.col("q25"), F.col("m")))
