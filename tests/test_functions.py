import math

import pytest
from pyspark.sql import functions as F

from sightline.functions import normal
from sightline.functions.scalar import lognormal_factor, na_to_zero, ratio_or_zero, round_half_even


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def test_norm_cdf_against_erfc(spark):
    rows = spark.range(-3600, 3601).select((F.col("id") / 100.0).alias("x"))
    out = rows.select("x", normal.norm_cdf(F.col("x")).alias("p"), normal.log_norm_cdf(F.col("x")).alias("lp")).collect()
    for row in out:
        assert row.p == pytest.approx(phi(row.x), abs=1e-14)
        if row.x < 0:
            assert row.lp == pytest.approx(math.log(phi(row.x)), rel=1e-7)


def test_log_tail_beyond_underflow(spark):
    x = spark.range(1).select(normal.log_norm_cdf(F.lit(-50.0)).alias("far"), normal.norm_cdf(F.lit(-50.0)).alias("p"))
    row = x.first()
    assert row.p == 0.0 and row.far == pytest.approx(-1254.8313, abs=1e-3)


def test_exp_link_is_the_exponential_quantile(spark):
    out = spark.range(1).select(normal.exp_link(F.lit(0.3), 0.5).alias("v"), normal.exp_link(F.lit(-9.0), 1.0).alias("tiny")).first()
    assert out.v == pytest.approx(-math.log(1 - phi(0.3)) / 0.5)
    assert 0 < out.tiny < 1e-18


def test_quantile():
    assert normal.norm_quantile(0.975) == pytest.approx(1.959963984540054)


def test_scalar_helpers(frame):
    df = frame([(1.0, 0.0, 2.5), (float("nan"), 2.0, 3.5), (None, None, None)], "a double, b double, c double")
    out = df.select(
        na_to_zero("a").alias("a"), ratio_or_zero(F.lit(1), F.col("b")).alias("q"), round_half_even("c").alias("c")
    ).collect()
    assert [tuple(r) for r in out] == [(1.0, 0.0, 2.0), (0.0, 0.5, 4.0), (0.0, 0.0, None)]
    assert df.limit(1).select(lognormal_factor(F.lit(10.0), F.lit(0.0), 1.96).alias("c")).first().c == 1.0
