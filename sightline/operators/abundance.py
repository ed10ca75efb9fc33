"""Closed-form open-population abundance, its jackknife covariance and mark-rate correction.

These are Jolly-Seber estimators, not the maximum-likelihood POPAN fit: the same data and the same
quantities (abundance per occasion, survival, entries, gross total), a different estimator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.normal import norm_quantile
from sightline.functions.scalar import lognormal_factor, round_half_even

COUNTS = ("n", "m", "r", "z")


def jolly_seber(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bias-adjusted Jolly-Seber estimates per occasion from n, m, r, z (no losses on capture),
    for the occasions strictly between the first and the last.

    Survival may exceed 1 and entries be negative; nothing is clamped.
    """
    by = by or []
    n, m, r, z = (F.col(c).cast("double") for c in COUNTS)
    along = Window.partitionBy(*by).orderBy("t")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    interior = (F.col("t") > F.min("t").over(whole)) & (F.col("t") < F.max("t").over(whole))
    est = counts.withColumn("m_hat", F.when(interior, m + (n + 1) * z / (r + 1)))
    est = est.withColumns({
        "p": F.try_divide(m, F.col("m_hat")),
        "n_hat": (n + 1) * F.col("m_hat") / (m + 1),
    })
    following = {c: F.lead(c).over(along) for c in ("m_hat", "n_hat")}
    est = est.withColumn("phi", F.try_divide(following["m_hat"], F.col("m_hat") - m + n))
    return est.withColumn("b", following["n_hat"] - F.col("phi") * F.col("n_hat"))


def survival_per_unit(estimates: DataFrame, occasions: DataFrame) -> DataFrame:
    """Survival per unit of time: the step's phi to the power 1 / gap, from the table of occasions (t, period, gap)."""
    known = estimates.join(occasions.select("t", "period", "gap"), "t")
    unit = F.when(F.col("phi") >= 0, F.pow(F.col("phi"), 1 / F.col("gap")))
    return known.withColumn("phi_unit", unit)


def gross_total(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Gross entrants per group: abundance at the study's second occasion plus later entries, each corrected
    for those that die before they can be seen."""
    phi = F.col("phi")
    factor = F.when(phi == 1, F.lit(1.0)).when(phi > 0, F.try_divide(F.log(phi), phi - 1))
    place = F.col("place")
    return (
        estimates.withColumns({
            "place": F.row_number().over(Window.partitionBy(*by).orderBy("t")),
            "k": F.count("*").over(Window.partitionBy(*by)),
        }).groupBy(*by)
        .agg(
            F.sum(F.when(place == 2, F.col("n_hat"))).alias("n2"),
            F.sum(F.when((place >= 2) & (place <= F.col("k") - 3), F.col("b") * factor)).alias("entries"),
        )
        .select(*by, (F.col("n2") + F.coalesce("entries", F.lit(0.0))).alias("n_gross"))
    )


def jackknife_counts(counts: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Counts of each delete-one-bucket replicate.

    ``counts`` holds n, m, r, z by (by, t, bucket). Counts add over individuals, so a replicate is
    the total less one bucket: no individual is copied to the replicates that keep it.
    """
    total = counts.groupBy(*by, "t").agg(*[F.sum(c).alias(f"all_{c}") for c in COUNTS])
    each = total.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    own = counts.select(*by, "t", "bucket", *COUNTS)
    return each.join(own, [*by, "t", "bucket"], "left").select(
        *by, "t", "bucket",
        *[(F.col(f"all_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS],
    )


def jackknife_covariance(replicates: DataFrame, group: str, value: str, buckets: int) -> DataFrame:
    """Covariance of the group estimates over the replicates, scaled by buckets - 1."""
    left = replicates.select("bucket", F.col(group).alias("g_i"), F.col(value).alias("v_i"))
    right = replicates.select("bucket", F.col(group).alias("g_j"), F.col(value).alias("v_j"))
    return left.join(right, "bucket").groupBy("g_i", "g_j").agg(
        (F.covar_pop("v_i", "v_j") * F.lit(float(buckets - 1))).alias("cov")
    )


def total_with_covariance(gross: DataFrame, cov: DataFrame) -> DataFrame:
    """Sum over groups and its standard error with all covariances, as one row."""
    total = gross.agg(F.sum("n_gross").alias("n_gross"))
    se = cov.agg(F.sqrt(F.sum("cov")).alias("se"))
    return total.select("n_gross", se.scalar().alias("se"))


def lognormal_interval(df: DataFrame, estimate: str = "n_gross", se: str = "se", alpha: float = 0.05) -> DataFrame:
    c = lognormal_factor(F.col(estimate), F.col(se), norm_quantile(1 - alpha / 2))
    return df.withColumn("c", c).withColumns({
        "lower": F.try_divide(F.col(estimate), F.col("c")), "upper": F.col(estimate) * F.col("c"),
    })


def with_group_se(gross: DataFrame, cov: DataFrame, group: str = "grp") -> DataFrame:
    own = cov.filter("g_i = g_j").select(F.col("g_i").alias(group), F.sqrt("cov").alias("se"))
    return gross.join(own, group)


def ci_table(groups: DataFrame, total: DataFrame, rates: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Labelled lower, estimate, upper, rounded half to even; the total has ``pos`` 0.

    ``labels`` name the groups from the highest to the lowest ``rate``; one row per group, so the ranking is small.
    """
    place = F.row_number().over(Window.orderBy(F.desc("rate"), "grp"))
    ranked = rates.select("grp", F.get(F.array(*map(F.lit, labels)), place - 1).alias("label"))
    groups, name = groups.join(ranked, "grp", "left"), F.col("label")
    rows = total.select(F.lit(0).alias("pos"), F.lit("Total").alias("label"), "lower", "n_gross", "upper").unionByName(
        groups.select(F.col("grp").alias("pos"), name.alias("label"), "lower", "n_gross", "upper")
    )
    return rows.select(
        "pos", "label", *[round_half_even(c).alias(c) for c in ("lower", "n_gross", "upper")]
    )


def mark_rate_correct(
    df: DataFrame, estimate: str, se: str, theta: Column, n_observed: Column, alpha: float = 0.05
) -> DataFrame:
    """Scale an estimate of marked individuals to all, with the delta-method error of the mark rate."""
    n_tot = F.try_divide(F.col(estimate), theta)
    relative = F.try_divide(F.col(se), F.col(estimate))
    marks = F.try_divide(1 - theta, n_observed * theta)
    out = df.withColumns({"n_tot": n_tot, "se_tot": F.sqrt(n_tot * n_tot * (relative * relative + marks))})
    factor = lognormal_factor(F.col("n_tot"), F.col("se_tot"), norm_quantile(1 - alpha / 2))
    return out.withColumn("c_tot", factor)
