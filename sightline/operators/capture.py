"""Capture-recapture counts from distinct (id, t) captures.

An individual has at most one capture per occasion, so every per-individual window or array is
bounded by the number of occasions, and all counts end up in tables over occasions (times groups).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalar import one_row


def resight_links(captures: DataFrame) -> DataFrame:
    """Each capture with the previous and the next occasion of the same individual."""
    history = Window.partitionBy("id").orderBy("t")
    return captures.withColumns({"prev": F.lag("t").over(history), "next": F.lead("t").over(history)})


def link_counts(captures: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Captures counted by (t, seen before, next): the sufficient table of every statistic below."""
    return resight_links(captures).groupBy(
        *(by or []), "t", F.col("prev").isNotNull().alias("before"), "next"
    ).agg(F.count("*").alias("n"))


def occasion_counts(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per occasion: n seen, u first captures, m recaptures, r seen again later, s seen both before and after."""
    n = F.col("n")
    return links.groupBy(*(by or []), "t").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(~F.col("before"), n).otherwise(0)).alias("u"),
        F.sum(F.when(F.col("before"), n).otherwise(0)).alias("m"),
        F.sum(F.when(F.col("next").isNotNull(), n).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("before") & F.col("next").isNotNull(), n).otherwise(0)).alias("s"),
    )


def narrow(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Link counts over fewer grouping columns."""
    return links.groupBy(*(by or []), "t", "before", "next").agg(F.sum("n").alias("n"))


def at_occasions(links: DataFrame, by: list[str], entries: list[dict[str, Column]]) -> DataFrame:
    """Sum link contributions booked at several occasions each.

    Every entry names an occasion ``t``, a condition ``when`` and the amounts to add there, so one
    pass over the links and one aggregation replace a join per statistic.
    """
    amounts = sorted({k for e in entries for k in e} - {"t", "when"})
    booked = F.array(*[
        F.struct(
            F.when(e.get("when", F.lit(True)), e["t"]).alias("t"),
            *[e.get(a, F.lit(0)).cast("bigint").alias(a) for a in amounts],
        )
        for e in entries
    ])
    rows = links.select(*by, F.explode(booked).alias("e")).select(*by, "e.*").filter("t IS NOT NULL")
    return rows.groupBy(*by, "t").agg(*[F.sum(a).alias(a) for a in amounts])


def gap_entries() -> list[dict[str, Column]]:
    """Book +n at t + 1 and -n at next for every gap: z is the running sum of ``d``.

    A gap (t, next) is open from t + 1 until next, so no row is repeated over its interior.
    """
    gap = (F.col("next") - F.col("t")) > 1
    return [
        {"t": F.col("t") + 1, "when": gap, "d": F.col("n")},
        {"t": F.col("next"), "when": gap, "d": -F.col("n")},
    ]


def running_gaps(df: DataFrame, by: list[str]) -> DataFrame:
    """Replace the bookings ``d`` by z, the individuals seen before and after t but not at t."""
    upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("z", F.sum("d").over(upto)).drop("d")


def rank_occasions(captures: DataFrame, period: str = "t") -> DataFrame:
    """Captures with ``t`` the rank of their sampled period, from 1; the period itself is kept as ``period``."""
    listed = one_row(captures.select(period).distinct(), all=F.array_sort(F.collect_list(period)))
    kept = captures.withColumn("period", F.col(period)).withColumn("listed", listed["all"])
    return kept.withColumn("t", F.array_position("listed", F.col("period")).cast("int")).drop("listed")


def occasions(captures: DataFrame, period: str = "period") -> DataFrame:
    """(t, period, gap): every sampled occasion with the time to the next one; as long as the calendar."""
    return captures.select("t", period).distinct().withColumn(
        "gap", F.lead(period).over(Window.orderBy("t")) - F.col(period))


def full_counts(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, u, m, r, s and z for every sampled occasion of the study (and group), 0 where nothing was seen.

    ``links`` are link counts over ``by``. Occasions are the numbers ``t`` that occur; others may be left out between
    them, and bookings on those enter the running sum before they are dropped. Groups repeat the short occasion list by
    a generator.
    """
    by = by or []
    n, before, later = F.col("n"), F.col("before"), F.col("next").isNotNull()

    def count(condition: Column) -> Column:
        return F.when(condition, n).otherwise(0)

    own = {"t": F.col("t"), "n": n, "u": count(~before), "m": count(before), "r": count(later), "s": count(before & later)}
    counts = at_occasions(links, by, [own, *gap_entries()])
    listed = one_row(links, all=F.collect_set("t"))
    if by:
        grid = links.select(*by).distinct().withColumn("t", F.explode(listed["all"]))
        empty = grid.withColumns({c: F.lit(0).cast("bigint") for c in counts.columns if c not in (*by, "t")})
        counts = counts.unionByName(empty).groupBy(*by, "t").agg(*[F.sum(c).alias(c) for c in counts.columns if c not in (*by, "t")])
    found = running_gaps(counts, by).withColumn("listed", listed["all"])
    return found.filter(F.array_contains("listed", F.col("t"))).drop("listed")


def m_array(links: DataFrame) -> DataFrame:
    """Releases at t first resighted at ``next``; NULL next counts those never seen again."""
    return links.groupBy("t", "next").agg(F.sum("n").alias("n"))


def capture_history(captures: DataFrame) -> DataFrame:
    """One 0/1 string per individual over the sampled occasions in date order."""
    occ = one_row(captures.select("t").distinct(), all=F.array_sort(F.collect_list("t")))
    seen = captures.groupBy("id", "grp").agg(F.collect_set("t").alias("seen")).withColumn("occ", occ["all"])
    marks = F.transform("occ", lambda t: F.when(F.array_contains("seen", t), "1").otherwise("0"))
    return seen.select("id", "grp", F.array_join(marks, "").alias("ch"))


def pivot_history(captures: DataFrame, occasions: list[int]) -> DataFrame:
    """One 0/1 column per occasion; the column list is explicit, so no extra job finds it."""
    wide = captures.withColumn("one", F.lit(1)).groupBy("id", "grp").pivot("t", occasions).agg(F.max("one"))
    return wide.select(
        "id", "grp", *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).alias(f"t{t:02d}") for t in occasions]
    )
