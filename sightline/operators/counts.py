"""Counts of individuals, mark rates, histograms, key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sightline.functions.scalar import one_row, ratio_or_zero
from sightline.session import settle


def seen_by_month(sightings: DataFrame) -> DataFrame:
    """Distinct (id, mark level, y, m)."""
    return sightings.select(
        "id", "mark_level", F.year("sdate").alias("y"), F.month("sdate").alias("m")
    ).distinct()


def distinct_individuals(sightings: DataFrame) -> DataFrame:
    """Distinct individuals overall, by year and by month, with the well-marked ones and their share.

    Each individual-month is listed under its month, its year and the whole study, and deduplicated
    there with a map-side combine; after that plain counts replace the distinct counts, and the
    overall level is spread over tasks like the others. NULL y, m mark the higher levels.
    """
    none = F.lit(None).cast("int")
    levels = F.array(*[
        F.struct(y.alias("y"), m.alias("m")) for y, m in ((F.col("y"), F.col("m")), (F.col("y"), none), (none, none))
    ])
    listed = seen_by_month(sightings).select("id", "mark_level", F.explode(levels).alias("at"))
    counted = listed.select("id", "mark_level", "at.y", "at.m").distinct().groupBy("y", "m").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("mark_level") == "WM", 1)).alias("n_wm")
    )
    return counted.withColumn("theta", ratio_or_zero(F.col("n_wm"), F.col("n")))


def density_histogram(df: DataFrame, group: str, value: str, bins: int = 30) -> DataFrame:
    """Density of ``value`` per group on one set of equal bins over the whole range."""
    span = one_row(df, lo=F.min(value), hi=F.max(value))
    width = ((span["hi"] - span["lo"]) / F.lit(float(bins))).alias("width")
    binned = df.select(group, (F.col(value) - span["lo"]).alias("offset"), width).select(
        group, "width",
        F.least(F.floor(F.coalesce(F.try_divide("offset", "width"), F.lit(0.0))), F.lit(bins - 1))
        .cast("int").alias("bin"),
    )
    counts = binned.groupBy(group, "bin", "width").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    return counts.join(sizes, group).select(
        group, "bin", "n", F.try_divide(F.col("n").cast("double"), F.col("size") * F.col("width")).alias("density")
    )


def key_check(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their count and the number of rows in the table."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    total = one_row(df, n=F.count("*"))
    return per_key.filter("n > 1").select(key, "n", total["n"].alias("n_rows"))


def numeric_means(df: DataFrame, by: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every numeric column, found from the schema."""
    by = by or []
    numeric = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in (*by, *skip)
    ]
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])


def cluster_profile(features: DataFrame, labels: DataFrame, group: str = "grp") -> DataFrame:
    """Size and mean features of each cluster."""
    labelled = features.join(labels, "id").drop("id")
    sized = labelled.withColumn("size", F.lit(1))
    numeric = [c for c in labelled.columns if c != group]
    return sized.groupBy(group).agg(
        F.count("*").alias("size"), *[F.avg(c).alias(c) for c in numeric]
    )


def factor_codes(df: DataFrame, column: str) -> DataFrame:
    """Level codes of a string column in sorted order, from 1; NULL has no code.

    Distinct levels are range partitioned at sampled splitters and numbered inside their range; the counts of the ranges, of which
    there are as many as shuffle partitions, give the carry. So no task holds all levels, whatever their beginnings are.
    """
    levels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranged = settle(levels.repartitionByRange(column).withColumn("range", F.spark_partition_id()), "levels")
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(column))
    coded = ranged.join(carry, "range").select(column, (own + F.col("carry")).cast("int").alias(f"{column}_code"))
    return df.join(coded, column, "left").select(*df.columns, f"{column}_code")


def keep_with_probability(df: DataFrame, p: str, u: str | None = None, seed: int = 0) -> DataFrame:
    """Keep each row with its own probability; ``u`` names a stored uniform, else ``rand(seed)``.

    Spark would push the filter below the columns that make up ``p`` and evaluate them again for each
    mention; a random column in the projection, here at worst a random zero, keeps it above them.
    """
    draw = F.rand(seed) if u is None else F.col(u) + F.rand(seed) * F.lit(0.0)
    return df.withColumn("draw_u", draw).filter(F.col("draw_u") < F.col(p)).drop("draw_u")


def sample_rows(df: DataFrame, key: str, size: int) -> DataFrame:
    """``size`` rows chosen by a hash of an integer key: repeatable, and a distributed top-k."""
    u = (F.col(key).cast("bigint") * 1103515245 + 12345) % 2147483648
    return df.orderBy(u, key).limit(size)


def stack_labelled(frames: dict[str, DataFrame], label: str = "param") -> DataFrame:
    """Union of tables with a column naming the source of each row."""
    tagged = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
