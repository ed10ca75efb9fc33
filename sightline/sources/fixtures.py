"""Stand-in sighting tables derived from the base tables (see FIXTURES.md for the SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.sources.tables import scan_table

# The study area ring and the three ferry lines of FIXTURES.md.
AREA_RING = (
    (1, 2.5, 3.5), (2, 60.5, 1.5), (3, 97.5, 20.5), (4, 80.5, 50.5),
    (5, 95.5, 90.5), (6, 50.5, 70.5), (7, 10.5, 95.5), (8, 20.5, 40.5),
)
FERRY_LINES = (
    (1, 1, 0.5, 10.5), (1, 2, 50.5, 15.5), (1, 3, 99.5, 5.5),
    (2, 1, 20.5, 0.5), (2, 2, 30.5, 40.5), (2, 3, 60.5, 90.5),
    (3, 1, 70.5, 2.5), (3, 2, 75.5, 60.5),
)
FIRST_YEAR = 1995
POINTS_PER_TRACK = 50
JACKKNIFE_BUCKETS = 20


def _values(spark: SparkSession, rows, columns: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS v({columns})")


def sighting_days(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (id, sdate): the sparse sighting matrix.

    The shuffle is on both columns, so copies of one individual spread over tasks, and after it an
    individual has at most one row per survey day.
    """
    return (
        scan_table(spark, folder, "orders")
        .select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("sdate"))
        .distinct()
    )


def individuals(spark: SparkSession, folder: str) -> DataFrame:
    """One row per individual: mark level, age class, and the fixed group derived from age class."""
    segment = F.col("c_mktsegment")
    age = F.col("c_nationkey") % 3
    return scan_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(segment.isin("BUILDING", "MACHINERY", "FURNITURE"), "WM")
        .when(segment == "AUTOMOBILE", "FM").otherwise("UM").alias("mark_level"),
        F.when(age == 0, "adult").when(age == 1, "juvenile").otherwise("calf").alias("age_class"),
        F.when(age == 0, 1).when(age == 1, 2).otherwise(3).alias("grp"),
    )


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    """The sighting matrix in sparse form with individual attributes and total sighting days."""
    sex = F.col("id") % 3
    counted = sighting_days(spark, folder).withColumn("tot", F.count("*").over(Window.partitionBy("id")))
    return counted.join(individuals(spark, folder).drop("grp"), "id").select(
        "id", "mark_level", "age_class",
        F.when(sex == 0, "F").when(sex == 1, "M").otherwise("U").alias("gender"),
        "sdate", F.lit(1).alias("observed"), "tot",
    )


def _quarter_occasion(date: Column) -> Column:
    return ((F.year(date) - FIRST_YEAR) * 4 + F.quarter(date)).cast("int")


def _month_occasion(date: Column) -> Column:
    return ((F.year(date) - FIRST_YEAR) * 12 + F.month(date)).cast("int")


def captures(
    spark: SparkSession, folder: str, marks: tuple[str, ...] | None = ("WM",), period: str = "quarter"
) -> DataFrame:
    """Distinct (id, t) with the group of the individual, for the chosen mark levels (None = all)."""
    occasion = _quarter_occasion if period == "quarter" else _month_occasion
    seen = scan_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"), occasion(F.col("o_orderdate")).alias("t")
    ).distinct()
    who = individuals(spark, folder)
    if marks is not None:
        who = who.filter(F.col("mark_level").isin(*marks))
    return seen.join(who.select("id", "grp"), "id")


def effort_days(spark: SparkSession, folder: str) -> DataFrame:
    """Survey days per month. Deduplicated by day first, so the second count is over the calendar."""
    day = scan_table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return day.groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(F.count("*").alias("n"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Sighting points on a 100 x 100 km map, with two key-derived uniforms for repeatable thinning."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts")).cast("int")
    modulus = 2147483648
    event, key = F.col("event_type"), F.col("event_id")

    def uniform(a: int, c: int) -> Column:
        return ((key * F.lit(a).cast("bigint") + c) % F.lit(modulus)).cast("double") / F.lit(float(modulus))

    return scan_table(spark, folder, "events").select(
        "event_id",
        F.to_date("ts").alias("pdate"),
        (second / F.lit(864.0)).alias("x"),
        (F.col("value") / F.lit(5.0)).alias("y"),
        F.when(event.isin("view", "click"), "Social")
        .when(event.isin("purchase", "signup"), "FERRY").otherwise("UNIRM").alias("stype"),
        F.when(F.col("user_id") % 2 == 0, "Stenella coeruleoalba").otherwise("Tursiops truncatus").alias("species"),
        uniform(1103515245, 12345).alias("u1"),
        uniform(22695477, 1).alias("u2"),
    )


def track_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """Survey tracks: consecutive sighting points form polylines of a fixed number of vertices."""
    key = F.col("event_id")
    return points(spark, folder).select(
        F.floor(key / POINTS_PER_TRACK).alias("line_id"),
        (key % POINTS_PER_TRACK + 1).cast("int").alias("seq"), "x", "y",
    )


def area_vertices(spark: SparkSession) -> DataFrame:
    return _values(spark, AREA_RING, "seq, x, y").select(
        F.lit(1).alias("geom_id"), "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    )


def ferry_vertices(spark: SparkSession) -> DataFrame:
    return _values(spark, FERRY_LINES, "line_id, seq, x, y").select(
        "line_id", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    )


def lattice(spark: SparkSession, nx: int = 50, ny: int = 50, dx: float = 2.0, dy: float = 2.0) -> DataFrame:
    """Cell centres of a regular lattice with its lower left corner at (0, 0)."""
    cell = spark.range(nx * ny).select(
        (F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy")
    )
    return cell.select(
        "ix", "iy", ((F.col("ix") + 0.5) * F.lit(dx)).alias("x"), ((F.col("iy") + 0.5) * F.lit(dy)).alias("y")
    )


def depth_grid(spark: SparkSession, nx: int = 50, ny: int = 50) -> DataFrame:
    cells = lattice(spark, nx, ny, 100.0 / nx, 100.0 / ny)
    return cells.withColumn(
        "z", F.lit(1.0) + F.sin(F.col("x") / F.lit(15.0)) * F.cos(F.col("y") / F.lit(20.0))
    )


def social_grid(spark: SparkSession) -> DataFrame:
    """Media intensity; every 17th diagonal has no cell."""
    x, y = F.col("x") - 30, F.col("y") - 10
    return depth_grid(spark).filter((F.col("ix") + F.col("iy")) % 17 != 0).withColumn(
        "z", F.lit(2.0) * F.exp(-(x * x + y * y) / 800) - F.lit(0.5)
    )


def draws(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior draws of the detection and intensity parameters."""
    def component(k: int) -> Column:
        return F.element_at("embedding", k).cast("double")

    return scan_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("draw"),
        (component(1) * 4).alias("theta_scale"),
        component(2).alias("loc"),
        (component(3) * 4).alias("theta_sig"),
        (component(4) - 4).alias("b0"),
        (component(5) - 1).alias("b1"),
    )
