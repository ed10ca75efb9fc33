"""Site-fidelity metrics of each individual, from the sparse sighting matrix.

Zeros of the dense matrix only enter the denominators, so the operators read the sightings and take
the number of occasions, months and years from the calendar. A never-seen individual has no row here;
``dense_months`` and ``dense_days`` restore it where it matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalar import one_row, ratio_or_zero
from sightline.operators.calendar import occasions, sampled_months

FEATURES = ("span_time_rel", "periodicity", "resight", "sights", "m_rate", "y_rate")
IDS_IN_A_TASK = 8192


def individual_history(days: DataFrame) -> DataFrame:
    """First and last day, number of days, months and years with a sighting.

    ``days`` holds distinct (id, sdate). One exchange by id serves the month, year and individual
    levels; counts replace the distinct counts because each level is already unique.
    """
    month = (
        days.repartition("id")
        .groupBy("id", F.trunc("sdate", "month").alias("month"))
        .agg(F.count("*").alias("n"), F.min("sdate").alias("first"), F.max("sdate").alias("last"))
    )
    year = month.groupBy("id", F.year("month").alias("y")).agg(
        F.sum("n").alias("n"), F.count("*").alias("months"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    return year.groupBy("id").agg(
        F.sum("n").alias("n_sights"), F.sum("months").alias("n_months"), F.count("*").alias("n_years"),
        F.min("first").alias("first_date"), F.max("last").alias("last_date"),
    )


def fidelity_features(days: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The six metrics of every individual.

    ``periodicity`` is one over the mean gap between sightings; the gaps telescope, so it is
    (n - 1) / (last - first). Metrics with a zero denominator (seen once, first seen on the last
    occasion) are 0. With ``ids``, individuals without any sighting have a row too: their span is NULL, the rest 0.
    """
    calendar = occasions(days)
    totals = one_row(
        calendar,
        n_occ=F.count("*"),
        max_time=F.max("time"),
        n_months=F.count_distinct(F.trunc("sdate", "month")),
        n_years=F.count_distinct(F.year("sdate")),
    )
    first = calendar.select(F.col("sdate").alias("first_date"), F.col("occ").alias("first_occ"))
    again = F.col("n_sights") - 1
    span = F.datediff("last_date", "first_date")
    seen = individual_history(days).join(first, "first_date").select(
        "id",
        ratio_or_zero(span, totals["max_time"]).alias("span_time_rel"),
        ratio_or_zero(again, span).alias("periodicity"),
        ratio_or_zero(again, totals["n_occ"] - F.col("first_occ")).alias("resight"),
        ratio_or_zero(F.col("n_sights"), totals["n_occ"]).alias("sights"),
        ratio_or_zero(F.col("n_months"), totals["n_months"]).alias("m_rate"),
        ratio_or_zero(F.col("n_years"), totals["n_years"]).alias("y_rate"),
    )
    if ids is None:
        return seen
    return ids.select("id").distinct().join(seen, "id", "left").fillna(0.0, list(FEATURES[1:]))


def mean_gap(days: DataFrame) -> DataFrame:
    """Mean days between consecutive sightings; NULL when seen once."""
    before = F.lag("sdate").over(Window.partitionBy("id").orderBy("sdate"))
    return days.withColumn("gap", F.datediff("sdate", before)).groupBy("id").agg(
        F.avg("gap").alias("mean_gap"), F.count("*").alias("n")
    )


def dense_months(days: DataFrame, ids: DataFrame) -> DataFrame:
    """Every individual in every sampled month with a 0/1 indicator.

    Each id generates its own row of months from a calendar array (at most one entry per month of
    the study), so no join multiplies the tables.
    """
    months = one_row(sampled_months(days), all=F.array_sort(F.collect_list("month")))
    full = ids.select("id", F.explode(months["all"]).alias("month"))
    seen = days.select("id", F.trunc("sdate", "month").alias("month")).distinct().withColumn("hit", F.lit(1))
    return full.join(seen, ["id", "month"], "left").select(
        "id", "month", F.coalesce("hit", F.lit(0)).alias("observed")
    )


def day_bits(days: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, bits): for each individual a string of 0 and 1 over the survey days in order, as long as the calendar.

    A task holds about ``IDS_IN_A_TASK`` individuals, all rows of each: short strings become many rows, and sums by individual need no shuffle.
    """
    calendar = occasions(days).select("sdate", (F.col("occ") - 1).alias("place"))
    tasks = -(-max(1, ids.count()) // IDS_IN_A_TASK)
    length = one_row(calendar, n=F.count("*"))
    seen = days.select("id", "sdate").distinct().join(calendar, "sdate").repartition(tasks, "id").groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    # Each sighting is the zeros since the one before, and a one; the rest of the calendar is zeros.
    ones = F.transform("places", lambda p, i: F.concat(
        F.repeat(F.lit("0"), p - F.coalesce(F.get("places", i - 1), F.lit(-1)) - 1), F.lit("1")))
    bits = F.rpad(F.coalesce(F.array_join(ones, ""), F.lit("")), length["n"].cast("int"), F.lit("0"))
    return ids.select("id").repartition(tasks, "id").join(seen, "id", "left").select("id", bits.alias("bits"))


def dense_days(days: DataFrame, ids: DataFrame) -> DataFrame:
    """The complete matrix: every individual on every survey day with a 0/1 indicator.

    Rows are generated from the bit string of their individual, where it is: only the sightings are shuffled, never the matrix.
    """
    calendar = one_row(occasions(days), all=F.array_sort(F.collect_list("sdate")))
    marks = F.transform(F.split("bits", ""), lambda b: b.cast("int"))
    each = day_bits(days, ids).select("id", F.explode(F.arrays_zip(calendar["all"].alias("sdate"), marks.alias("observed"))).alias("d"))
    return each.select("id", F.col("d.sdate").alias("sdate"), F.col("d.observed").alias("observed"))
