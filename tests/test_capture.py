import pytest
from pyspark.sql import functions as F

from sightline.operators import abundance as ab
from sightline.operators import capture as cap
from sightline.operators import gof
from sightline.sources import fixtures as fx
from tests.conftest import MEDIUM, SMALL


@pytest.fixture(scope="module")
def captures(spark):
    return fx.captures(spark, SMALL, marks=None).cache()


def test_count_identities(captures):
    links = cap.link_counts(captures).cache()
    rows = cap.full_counts(links).collect()
    assert all(r.n == r.m + r.u for r in rows)
    assert sum(r.u for r in rows) == captures.select("id").distinct().count()
    released = {r.t: r.n for r in cap.m_array(links).groupBy("t").agg(F.sum("n").alias("n")).collect()}
    assert released == {r.t: r.n for r in rows if r.n}


def test_between_counts_against_the_definition(captures):
    seen = {}
    for r in captures.collect():
        seen.setdefault(r.id, set()).add(r.t)
    rows = cap.full_counts(cap.link_counts(captures)).collect()
    for r in rows:
        assert r.z == sum(1 for s in seen.values() if r.t not in s and min(s) < r.t < max(s))


def test_group_without_captures_keeps_its_occasion(frame):
    rows = [(1, 1, 1), (1, 3, 1), (2, 1, 2), (2, 2, 2), (2, 3, 2)]
    out = cap.full_counts(cap.link_counts(frame(rows, "id bigint, t int, grp int"), ["grp"]), ["grp"])
    got = {(r.grp, r.t): (r.n, r.z) for r in out.collect()}
    assert got[(1, 2)] == (0, 1) and got[(2, 2)] == (1, 0)


def test_known_fit_statistics(spark):
    links = cap.link_counts(fx.captures(spark, MEDIUM, marks=None))
    got = {r.test: (round(r.chi2, 2), r.dof) for r in gof.gof_summary(links).collect()}
    assert got == {"3sr": (10.40, 14), "3sm": (23.09, 19), "2ct": (22.40, 24), "2cl": (20.53, 23)}


def test_abundance_recovers_the_number_of_individuals(spark):
    est = ab.jolly_seber(cap.full_counts(cap.link_counts(fx.captures(spark, MEDIUM, marks=None))))
    inner = [r.n_hat for r in est.collect() if 2 <= r.t <= 24]
    assert len(inner) == 23 and all(abs(n - 1500) < 75 for n in inner)
    gross = ab.gross_total(est.withColumn("g", F.lit(1)), ["g"]).first().n_gross
    assert gross == pytest.approx(1500.2, abs=0.05)


def test_jackknife_replicates_equal_leaving_the_bucket_out(captures):
    caps = captures.withColumn("bucket", (F.col("id") % 5).cast("int")).cache()
    reps = ab.jackknife_counts(cap.full_counts(cap.link_counts(caps, ["grp", "bucket"]), ["grp", "bucket"]), ["grp"], 5)
    got = {(r.grp, r.t): (r.n, r.m, r.r, r.z) for r in reps.filter("bucket = 2").collect()}
    left = cap.full_counts(cap.link_counts(caps.filter("bucket <> 2"), ["grp"]), ["grp"]).collect()
    assert got == {(r.grp, r.t): (r.n, r.m, r.r, r.z) for r in left}


def test_interval_and_correction(frame):
    df = ab.lognormal_interval(frame([(100.0, 10.0)], "n_gross double, se double"))
    row = ab.mark_rate_correct(df, "n_gross", "se", F.lit(0.5), F.lit(80)).first()
    assert row.lower < 100 < row.upper and row.lower * row.upper == pytest.approx(10000)
    assert row.n_tot == 200 and row.se_tot == pytest.approx((200**2 * (0.01 + 0.5 / 40)) ** 0.5)


def test_counts_with_unsampled_occasions(spark, frame):
    seen = {1: (1, 4), 2: (2, 4), 3: (1, 2, 5), 4: (5,)}
    rows = [(i, 1, t) for i, ts in seen.items() for t in ts]
    captures = frame(rows, "id bigint, grp int, t int")
    plain = {r.t: r.z for r in cap.full_counts(cap.link_counts(captures)).collect()}
    grouped = {r.t: r.z for r in cap.full_counts(cap.link_counts(captures, ["grp"]), ["grp"]).collect()}
    assert plain == grouped == {1: 0, 2: 1, 4: 1, 5: 0}


def test_shifted_occasions_change_nothing(spark, frame):
    from sightline.operators import abundance as ab

    rows = [(i, 1, t) for i in range(60) for t in range(1, 9) if (i * 7 + t * t * 3) % 5 < 2]
    totals = []
    for shift in (0, 4):
        captures = frame([(i, g, t + shift) for i, g, t in rows], "id bigint, grp int, t int")
        counts = cap.full_counts(cap.link_counts(captures, ["grp"]), ["grp"])
        totals.append(ab.gross_total(ab.jolly_seber(counts, ["grp"]), ["grp"]).first().n_gross)
    assert totals[0] == totals[1] is not None


def test_occasions_are_ranked_from_the_data(frame):
    captures = frame([("a", 3), ("b", 7), ("a", 12), ("c", 7)], "id string, t int")
    ranked = cap.rank_occasions(captures)
    assert {(r.id, r.t, r.period) for r in ranked.collect()} == {("a", 1, 3), ("b", 2, 7), ("a", 3, 12), ("c", 2, 7)}
    assert [(r.t, r.gap) for r in cap.occasions(ranked).orderBy("t").collect()] == [(1, 4), (2, 5), (3, None)]
