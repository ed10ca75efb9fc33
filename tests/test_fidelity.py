import datetime as dt

from pyspark.sql import functions as F

from sightline.operators import calendar, counts, fidelity
from sightline.sources import fixtures as fx
from tests.conftest import SMALL

D = dt.date
DAYS = [D(2017, 1, 1), D(2017, 1, 11), D(2017, 3, 2), D(2018, 3, 2)]


def features(frame, rows):
    out = fidelity.fidelity_features(frame(rows, "id bigint, sdate date")).collect()
    return {r.id: r for r in out}


def test_edge_individuals(frame):
    rows = [(1, d) for d in DAYS] + [(2, DAYS[0]), (3, DAYS[3])]
    f = features(frame, rows)
    assert (f[1].span_time_rel, f[1].resight, f[1].sights, f[1].m_rate, f[1].y_rate) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert f[1].periodicity == 3 / 425
    assert (f[2].span_time_rel, f[2].periodicity, f[2].resight) == (0.0, 0.0, 0.0)
    assert (f[2].sights, f[2].m_rate, f[2].y_rate) == (0.25, 1 / 3, 0.5)
    assert f[3].resight == 0.0  # first seen on the last occasion


def test_empty_input(frame):
    assert features(frame, []) == {}


def test_periodicity_is_inverse_mean_gap(spark):
    days = fx.sighting_days(spark, SMALL)
    gaps = {r.id: r.mean_gap for r in fidelity.mean_gap(days).collect()}
    for r in fidelity.fidelity_features(days).collect():
        expected = 1 / gaps[r.id] if gaps[r.id] else 0.0
        assert abs(r.periodicity - expected) < 1e-12


def test_dense_form_gives_the_monthly_rate(spark):
    days = fx.sighting_days(spark, SMALL)
    dense = fidelity.dense_months(days, days.select("id").distinct())
    rate = {r.id: r.rate for r in dense.groupBy("id").agg({"observed": "avg"}).toDF("id", "rate").collect()}
    for r in fidelity.fidelity_features(days).collect():
        assert abs(r.m_rate - rate[r.id]) < 1e-12


def test_never_seen_individual_in_dense_form(frame):
    days = frame([(1, d) for d in DAYS], "id bigint, sdate date")
    dense = fidelity.dense_months(days, frame([(1,), (9,)], "id bigint"))
    assert {(r.id, r.observed) for r in dense.collect()} == {(1, 1), (9, 0)}


def test_dense_form_has_every_survey_day(frame):
    march = [D(2017, 3, 2), D(2017, 3, 5)]
    days = frame([(1, march[0]), (1, march[1]), (2, march[1])], "id bigint, sdate date")
    dense = fidelity.dense_days(days, frame([(1,), (2,), (9,)], "id bigint"))
    assert sorted((r.id, r.sdate, r.observed) for r in dense.collect()) == [
        (1, march[0], 1), (1, march[1], 1), (2, march[0], 0), (2, march[1], 1), (9, march[0], 0), (9, march[1], 0)]


def test_calendar(frame):
    days = frame([(1, d) for d in reversed(DAYS)] + [(2, DAYS[1])], "id bigint, sdate date")
    assert [(r.occ, r.time) for r in calendar.occasions(days).orderBy("sdate").collect()] == [(1, 0), (2, 10), (3, 60), (4, 425)]
    assert [r.gap for r in calendar.month_gaps(days).orderBy("month").collect()] == [2, 12]
    assert [tuple(r) for r in calendar.months_per_year(days).orderBy("y").collect()] == [(2017, 2), (2018, 1)]


def test_month_without_marked_individuals(frame):
    rows = [(1, "WM", D(2017, 1, 1)), (2, "UM", D(2017, 1, 1)), (2, "UM", D(2017, 2, 1))]
    out = counts.distinct_individuals(frame(rows, "id bigint, mark_level string, sdate date"))
    got = {(r.y, r.m): (r.n, r.n_wm, r.theta) for r in out.collect()}
    assert got == {(None, None): (2, 1, 0.5), (2017, None): (2, 1, 0.5), (2017, 1): (2, 1, 0.5), (2017, 2): (1, 0, 0.0)}


def test_dense_days_spread_over_tasks(spark, frame, monkeypatch):
    """However few bytes the sightings take, a task generates the days of a bounded number of individuals, whole ones."""
    monkeypatch.setattr(fidelity, "IDS_IN_A_TASK", 20, raising=False)
    days = frame([(i, D(2017, 1 + i % 12, 1 + j)) for i in range(400) for j in range(2)], "id bigint, sdate date")
    dense = fidelity.dense_days(days, days.select("id").distinct()).withColumn("task", F.spark_partition_id())
    held = dense.groupBy("id").agg(F.count_distinct("task").alias("tasks"), F.max("task").alias("task"), F.count("*").alias("n")).collect()
    assert {(r.tasks, r.n) for r in held} == {(1, 24)} and len(held) == 400
    counts = [sum(r.task == t for r in held) for t in {r.task for r in held}]
    assert max(counts) <= 60 and len(counts) > 10
