"""Survey calendar: occasions, elapsed time, sampled months, effort.

Every table here has at most one row per calendar day of the study, whatever the number of
sightings, so an unpartitioned window over it is bounded (all of Spark's DATE range is 3.7 M days).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occasions(days: DataFrame, date: str = "sdate") -> DataFrame:
    """Distinct survey days with their rank and the days since the first one."""
    in_order = Window.orderBy(date)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return days.select(date).distinct().select(
        date,
        F.row_number().over(in_order).alias("occ"),
        F.datediff(date, F.min(date).over(whole)).alias("time"),
    )


def elapsed_days(days: DataFrame, date: str = "sdate") -> DataFrame:
    """Running sum of the gaps between survey days."""
    in_order = Window.orderBy(date)
    gap = F.coalesce(F.datediff(date, F.lag(date).over(in_order)), F.lit(0))
    step = days.select(date).distinct().withColumn("gap", gap)
    return step.select(date, F.sum("gap").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("elapsed"))


def sampled_months(days: DataFrame, date: str = "sdate") -> DataFrame:
    """One row per sampled month: its first day, the first survey day in it, and the survey days."""
    month = F.trunc(date, "month")
    return (
        days.select(date).distinct()
        .groupBy(month.alias("month"))
        .agg(F.min(date).alias("first_date"), F.count("*").alias("n_days"))
    )


def month_gaps(days: DataFrame, date: str = "sdate") -> DataFrame:
    """Months between consecutive sampled months."""
    before = F.lag("month").over(Window.orderBy("month"))
    return (
        sampled_months(days, date)
        .withColumn("gap", F.months_between("month", before).cast("int"))
        .filter("gap IS NOT NULL").select("month", "gap")
    )


def months_per_year(days: DataFrame, date: str = "sdate") -> DataFrame:
    return sampled_months(days, date).groupBy(F.year("month").alias("y")).agg(F.count("*").alias("n_months"))


def effort_months(effort: DataFrame) -> DataFrame:
    """Effort keyed by the first day of its month, with the logarithm used as detection covariate."""
    return effort.select(
        F.make_date("y", "m", F.lit(1)).alias("month"), "n", F.log(F.col("n").cast("double")).alias("log_n")
    )
