import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import detect, geo
from sightline.operators import intensity as it
from sightline.sources import fixtures as fx
from tests.conftest import SMALL

PTS = "id bigint, x double, y double"
SEGS = "line_id bigint, x1 double, y1 double, x2 double, y2 double"


def distance(p, s):
    dx, dy = s[3] - s[1], s[4] - s[2]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / n)) if n else 0.0
    return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)


@pytest.fixture(scope="module")
def cloud():
    """Points with a third of them in one spot, segments in two clumps and one degenerate."""
    rng = random.Random(5)
    points = [(i, 3.25, 4.5) if i % 3 == 0 else (i, rng.uniform(-50, 50), rng.uniform(0, 400)) for i in range(300)]
    lines = []
    for i in range(80):
        cx, cy = (-40, 20) if i % 2 else (30, 300)
        x, y = cx + rng.uniform(-5, 5), cy + rng.uniform(-5, 5)
        lines.append((i, x, y, x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)))
    return points, [*lines, (80, 0.0, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("size", [16, 81])
def test_nearest_line_both_ways(frame, cloud, size):
    points, lines = cloud[0], cloud[1][-size:]
    out = geo.nearest_line(frame(points, PTS), frame(lines, SEGS), "id").collect()
    assert len(out) == len(points)
    for r in out:
        assert r.dist_obs == pytest.approx(min(distance((r.id, r.x, r.y), s) for s in lines), abs=1e-9)
        assert r.dist_obs == pytest.approx(distance((r.id, r.x, r.y), lines[r.line_id - lines[0][0]]), abs=1e-9)


@pytest.mark.parametrize("local", [1000, 0])
def test_inside_polygon_both_ways(spark, frame, local):
    ring = [(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 10.0, 10.0), (1, 4, 0.0, 10.0),
            (2, 1, 4.0, 4.0), (2, 2, 6.0, 4.0), (2, 3, 6.0, 6.0), (2, 4, 4.0, 6.0)]
    edges = geo.ring_edges(frame(ring, "geom_id int, seq int, x double, y double"))
    points = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, -1.0, 5.0), (5, 0.0, 0.0), (6, 10.0, 10.0), (7, 3.0, 4.0)]
    kept = geo.inside_polygon(frame(points, PTS), edges, "id", local=local).collect()
    assert sorted(r.id for r in kept) == [1, 5, 7]  # in the hole and outside drop; a lower left vertex counts once


@pytest.mark.parametrize("local", [1000, 0])
def test_polygon_with_repeated_keys_and_null_places(frame, local):
    ring = [(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (1, 4, 10.0, 10.0), (1, 9, 0.0, 10.0)]
    edges = geo.ring_edges(frame(ring, "geom_id int, seq int, x double, y double"))
    points = [(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 20.0, 2.0), (2, None, 1.0), (3, 1.0, None), (4, 1.0, 1.0), (4, 1.0, 1.0)]
    kept = geo.inside_polygon(frame(points, PTS), edges, "id", local=local)
    assert kept.columns == ["id", "x", "y"]
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 1.0, 1.0), (1, 2.0, 2.0), (4, 1.0, 1.0), (4, 1.0, 1.0)]
    nothing = geo.inside_polygon(frame(points, PTS), edges.limit(0), "id", local=local)
    assert nothing.count() == 0


@pytest.mark.parametrize("most", [32, 1])
def test_nearest_line_edge_cases(frame, most):
    lines = [(9, 0.0, 1.0, 4.0, 1.0), (3, 0.0, -1.0, 4.0, -1.0), (5, 30.0, 30.0, 31.0, 30.0)]
    points = [(1, 2.0, 0.0), (1, 30.0, 29.0), (2, None, 1.0), (3, 1.0, None), (4, 2.0, 0.0), (4, 2.0, 0.0)]
    out = geo.nearest_line(frame(points, PTS), frame(lines, SEGS), "id", most=most)
    assert out.columns == ["id", "x", "y", "dist_obs", "line_id"]
    got = sorted(((r.id, r.dist_obs, r.line_id) for r in out.collect()), key=str)
    assert got == sorted([(1, 1.0, 3), (1, 1.0, 5), (2, None, None), (3, None, None), (4, 1.0, 3), (4, 1.0, 3)], key=str)
    empty = geo.nearest_line(frame(points, PTS), frame([], SEGS), "id", most=most)
    assert empty.count() == len(points) and empty.filter("dist_obs IS NOT NULL OR line_id IS NOT NULL").count() == 0


@pytest.mark.parametrize("most", [32, 1])
def test_null_ends_and_tiny_distances(frame, most):
    """The same rows however fine the lattice: a segment without an end does not count, squares need not underflow."""
    lines = [(1, None, 0.0, 5.0, 5.0), (4, 0.0, None, 1.0, 1.0), (2, 0.0, 3e-160, 1.0, 3e-160), (3, 0.0, -1e-160, 1.0, -1e-160),
             *((10 + i, 5.0 + i, 5.0, 6.0 + i, 5.0) for i in range(20))]
    points = [(1, 0.5, 0.0), (2, 5.0, -2.0), (3, float("nan"), 0.0), (4, float("inf"), 1.0), (5, 24.0, 6.0)]
    got = {r.id: (r.dist_obs, r.line_id) for r in geo.nearest_line(frame(points, PTS), frame(lines, SEGS), "id", most=most).collect()}
    assert got == {1: (1e-160, 3), 2: (pytest.approx(math.hypot(4, 2)), 2), 3: (None, None), 4: (None, None), 5: (1.0, 28)}


def test_lattice_follows_packed_segments_within_its_bound(frame):
    rng = random.Random(1)
    far = [(i, x, y, x + 0.1, y) for i in range(60) for x, y in [(rng.uniform(0, 100), rng.uniform(0, 100))]]
    packed = [(100 + i, x, y, x + 0.001, y) for i in range(1500) for x, y in [(rng.uniform(0, 1), rng.uniform(0, 1))]]
    cells = geo.segment_cells(frame(far + packed, SEGS), "line_id", 0.0, 0.0, 100.0)
    sizes = cells.select("level", F.size("candidates").alias("n")).collect()
    assert len({r.level for r in sizes}) > 1 and sum(r.n for r in sizes) < 64 * geo.SHARE * 1560
    points = [(i, rng.uniform(0, 2), rng.uniform(0, 2)) for i in range(60)] + [(60, 99.0, 99.0), (61, 0.0, 100.0)]
    got = {r.id: r.dist_obs for r in geo.nearest_line(frame(points, PTS), frame(far + packed, SEGS), "id").collect()}
    for p in points:
        assert got[p[0]] == pytest.approx(min(distance(p, s) for s in far + packed), abs=1e-9)


def test_overlay_outside_the_grid_is_zero(spark, frame):
    out = geo.point_grid_join(frame([(1, 1.0, 1.0), (2, 500.0, 1.0)], PTS), fx.depth_grid(spark), 2.0, 2.0)
    got = {r.id: r.surf for r in out.collect()}
    assert got[2] == 0.0 and got[1] == pytest.approx(1 + math.sin(1 / 15) * math.cos(1 / 20))


def test_segments_of_a_line(frame):
    out = geo.line_segments(frame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 1.0, 2.0)], "line_id int, seq int, x double, y double"))
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(1, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 1.0, 2.0)]


def test_segments_skip_missing_numbers(frame):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 4, 1.0, 2.0), (1, 5000, 2.0, 2.0), (1, 12000, 3.0, 3.0)]
    out = geo.line_segments(frame(rows, "line_id int, seq int, x double, y double"))
    assert sorted(r.seq for r in out.collect()) == [1, 2, 4, 5000]
    ring = geo.ring_edges(frame(rows, "geom_id int, seq int, x double, y double"))
    assert (1, 3.0, 3.0, 0.0, 0.0) in {tuple(r) for r in ring.collect()} and ring.count() == 5


def test_hat_basis_sums_to_one(spark):
    d = spark.range(71).select((F.col("id") / 10.0).alias("dist_obs"))
    sums = it.hat_basis(d).groupBy("dist_obs").agg(F.sum("basis").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_transect_weights_integrate_the_strip(frame):
    rows = it.quadrature_transect(frame([(1, 0.0, 0.0, 3.0, 4.0)], SEGS), 2.0)
    assert rows.agg(F.sum("w")).first()[0] == pytest.approx(5.0 * 7.0)


def test_fit_recovers_a_known_intensity(frame):
    """Points placed as the intensity exp(1 - 0.8 depth) asks, under a detection of exp(-1/2) in half the cells."""
    cells = [(2.0, d / 10, -0.5 * (d % 2)) for d in range(-20, 21) for _ in range(3)]
    points = [(d,) for w, d, g in cells for _ in range(round(4000 * w * math.exp(1 - 0.8 * d + g) / 40))]
    quadrature = frame([(100 * w, d, g) for w, d, g in cells], "w double, depth double, log_g double")
    out = it.poisson_intensity_fit(frame(points, "depth double"), quadrature).first()
    assert out.intercept == pytest.approx(1.0, abs=0.01) and out.beta_depth == pytest.approx(-0.8, abs=0.01)
    assert abs(out.score0) < 1e-6 and abs(out.score1) < 1e-6 and out.n_fitted == pytest.approx(out.n_points)
    none = it.poisson_intensity_fit(frame([], "depth double"), quadrature).first()
    assert none.n_points == 0 and none.intercept is None
    flat = it.poisson_intensity_fit(frame([(1.0,)] * 30, "depth double"), frame([(10.0, 1.0, 0.0)] * 2, "w double, depth double, log_g double")).first()
    assert flat.intercept == pytest.approx(math.log(1.5)) and flat.beta_depth == 0.0


def test_seeded_thinning_is_a_subset(spark):
    pts = detect.detect_social(fx.points(spark, SMALL).withColumn("surf", F.lit(0.0)))
    kept = detect.thin(pts, seed=3).count()
    assert 400 < kept < 600  # probability one half of 1 000 points


def test_draws_are_predicted_on_the_whole_lattice(spark):
    from sightline.plans import spatial

    draws, pixels = fx.draws(spark, SMALL), spatial._pixels(spark, 200)
    per_draw = spatial.predict_draws_lattice(spark, SMALL).collect()
    assert len(per_draw) == draws.count() and {x.n for x in per_draw} == {pixels.count()}
    assert pixels.count() > 100 * spatial._pixels(spark, 20).count() * 0.9
