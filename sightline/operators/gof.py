"""Goodness-of-fit components of the time-dependent capture-recapture model, pooled to 2 x 2 tables.

Each test compares two classes of individuals at an occasion by what happens to them next. All four
are sums over ``link_counts`` (at most occasions squared rows) and the z counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.capture import at_occasions, gap_entries, running_gaps


def _chi2(tables: DataFrame) -> DataFrame:
    """Pearson chi-square of cells a, b, c, d; dof 1 where no margin is empty."""
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    cross = a * d - b * c
    return tables.withColumns({
        "chi2": F.when(margins > 0, (a + b + c + d) * cross * cross / margins).otherwise(F.lit(0.0)),
        "dof": F.when(margins > 0, 1).otherwise(0).cast("bigint"),
    })


def gof_tables(links: DataFrame) -> DataFrame:
    """The 2 x 2 table of every test at every occasion, from one aggregation of the links.

    ``t`` ranks the sampled occasions (``rank_occasions``), so t + 1 is the next occasion however long the gap.

    * 3sr - seen before or not, against seen later or not;
    * 3sm - among those seen later: seen before or not, against next seen at t + 1 or after it;
    * 2ct - known alive around t: seen at t or not, against next seen at t + 1 or after it;
    * 2cl - as 2ct among those not seen at t + 1, against next seen at t + 2 or after it.

    Individuals alive but unseen at t with next sighting at t + 1 (t + 2) are the links that end there
    and are longer than 1 (2); the others follow from z, so no gap is expanded.
    """
    n, before, delay = F.col("n"), F.col("before"), F.col("next") - F.col("t")
    fates = {"1": delay == 1, "2": delay == 2, "3": delay > 2, "never": F.col("next").isNull()}
    own = {"t": F.col("t")}
    for fate, hit in fates.items():
        own[f"old_{fate}"] = F.when(before & hit, n).otherwise(0)
        own[f"new_{fate}"] = F.when(~before & hit, n).otherwise(0)
    ends = [{"t": F.col("next") - k, "when": delay > k, f"unseen_{k}": n} for k in (1, 2)]
    alive = running_gaps(at_occasions(links, [], [own, *ends, *gap_entries()]), [])

    def total(prefix: str, *names: str) -> Column:
        return sum((F.col(f"{prefix}_{f}") for f in names[1:]), F.col(f"{prefix}_{names[0]}"))

    seen = {f: F.col(f"old_{f}") + F.col(f"new_{f}") for f in ("1", "2", "3")}
    unseen = {"1": F.col("unseen_1"), "2": F.col("unseen_2"), "3": F.col("z") - F.col("unseen_1") - F.col("unseen_2")}
    cells = {
        "3sr": (total("old", "1", "2", "3"), F.col("old_never"), total("new", "1", "2", "3"), F.col("new_never")),
        "3sm": (F.col("old_1"), total("old", "2", "3"), F.col("new_1"), total("new", "2", "3")),
        "2ct": (seen["1"], seen["2"] + seen["3"], unseen["1"], unseen["2"] + unseen["3"]),
        "2cl": (seen["2"], seen["3"], unseen["2"], unseen["3"]),
    }
    listed = F.explode(F.array(*[
        F.struct(F.lit(test).alias("test"), *[c.alias(x) for x, c in zip("abcd", abcd)]) for test, abcd in cells.items()
    ]))
    return _chi2(alive.select("t", listed.alias("e")).select("t", "e.*"))


TESTS = ("3sr", "3sm", "2ct", "2cl")


def gof_summary(links: DataFrame) -> DataFrame:
    """Chi-square and degrees of freedom of each test."""
    return gof_tables(links).groupBy("test").agg(F.sum("chi2").alias("chi2"), F.sum("dof").alias("dof"))


def c_hat(links: DataFrame) -> DataFrame:
    """Overdispersion: total chi-square over total degrees of freedom."""
    return gof_tables(links).agg(F.sum("chi2").alias("chi2"), F.sum("dof").alias("dof")).withColumn(
        "c_hat", F.try_divide(F.col("chi2"), F.col("dof").cast("double"))
    )
