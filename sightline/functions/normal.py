"""Normal distribution as plain column arithmetic (stays inside whole-stage codegen).

Spark SQL has no erf, so the lower tail uses the rational approximation of Hart as published by
G. West, "Better approximations to cumulative normal functions" (2005); absolute error about 2e-16.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational form, highest power first, and its cut-offs.
NUMERATOR = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
RATIONAL_BELOW = 7.07106781186547
UNDERFLOW_ABOVE = 37.0
ROOT_TWO_PI = 2.506628274631


def _horner(coefficients: tuple[float, ...], z: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * z + F.lit(c)
    return value


def _tail(z: Column) -> Column:
    """P(Z < -z) for z >= 0."""
    density = F.exp(-z * z / 2)
    rational = density * _horner(NUMERATOR, z) / _horner(DENOMINATOR, z)
    fraction = z + F.lit(0.65)
    for k in (4, 3, 2, 1):
        fraction = z + F.lit(float(k)) / fraction
    return (
        F.when(z > UNDERFLOW_ABOVE, F.lit(0.0))
        .when(z < RATIONAL_BELOW, rational)
        .otherwise(density / (fraction * ROOT_TWO_PI))
    )


def norm_cdf(x: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """P(N(mean, sd) <= x)."""
    z = x if (mean, sd) == (0.0, 1.0) else (x - F.lit(mean)) / F.lit(sd)
    side = F.signum(z)  # 1 - tail on the right, tail on the left, with the tail written once
    return F.lit(0.5) * (F.lit(1.0) + side) - side * _tail(F.abs(z))


def log_norm_cdf(x: Column) -> Column:
    """log P(Z <= x), with its own branch where the tail underflows."""
    far = -x * x / 2 - F.log(-x) - 0.5 * math.log(2 * math.pi)
    tail = _tail(F.abs(x))
    return F.when(x < -UNDERFLOW_ABOVE, far).when(x > 0, F.log1p(-tail)).otherwise(F.log(tail))


def norm_upper(x: Column) -> Column:
    """P(Z > x), accurate in the upper tail."""
    return norm_cdf(-x)


def norm_quantile(p: float) -> float:
    """Standard normal quantile of a plan parameter."""
    return NormalDist().inv_cdf(p)


def exp_link(x: Column, rate: float) -> Column:
    """Map a standard normal variable to an exponential one with the given rate.

    The exponential quantile of Phi(x) is -log(1 - Phi(x)) / rate = -log(Phi(-x)) / rate.
    """
    return -log_norm_cdf(-x) / F.lit(float(rate))
