"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_zero(c: str | Column) -> Column:
    """NULL and NaN become 0."""
    c = as_column(c)
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0 or either side is NULL."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def xlogy(x: Column, y: Column) -> Column:
    """x * log(y) with 0 * log(0) = 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def round_half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(as_column(c), digits)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_row(df: DataFrame, **aggregates: Column) -> Column:
    """Whole-table aggregates as one scalar subquery: read the fields with ``result["name"]``."""
    fields = [c.alias(name) for name, c in aggregates.items()]
    return df.agg(F.struct(*fields).alias("totals")).scalar()


def half_normal(distance: Column, sigma: float | Column) -> Column:
    """exp(-(d / sigma)^2 / 2)."""
    return F.exp(log_half_normal(distance, sigma))


def log_half_normal(distance: Column, sigma: float | Column) -> Column:
    scaled = distance / (F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma)
    return F.pow(scaled, F.lit(2.0)) * F.lit(-0.5)


def lognormal_factor(estimate: Column, se: Column, z: float) -> Column:
    """Multiplicative half-width of a log-normal interval: exp(z sqrt(log(1 + (se / N)^2)))."""
    cv = F.try_divide(se, estimate)
    return F.exp(F.lit(z) * F.sqrt(F.log(F.lit(1.0) + cv * cv)))


