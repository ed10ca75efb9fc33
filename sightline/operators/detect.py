"""Detection probabilities and thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.normal import log_norm_cdf, norm_cdf
from sightline.functions.scalar import half_normal, log_half_normal
from sightline.operators.counts import keep_with_probability

# The true detection parameters of the study's simulation.
SOCIAL_SCALE, SOCIAL_LOCATION, FERRY_SIGMA = 0.5, 0.0, 2.0
# Rates of the exponential priors of the two detection scales.
SOCIAL_RATE, FERRY_RATE = 1.0, 0.5


def detect_social(df: DataFrame, dens: str = "surf", location: float = SOCIAL_LOCATION, scale: float = SOCIAL_SCALE) -> DataFrame:
    """Detection from media intensity: Phi((dens - location) / scale)."""
    return df.withColumn("pdetect", norm_cdf(F.col(dens), location, scale))


def detect_ferry(df: DataFrame, distance: str = "dist_obs", sigma: float = FERRY_SIGMA) -> DataFrame:
    """Half-normal detection by distance from the track."""
    return df.withColumn("pdetect", half_normal(F.col(distance), sigma))


def log_detect_social(dens: Column, scale: float | Column, shift: float | Column) -> Column:
    """log Phi(dens / scale + shift)."""
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    shift = F.lit(float(shift)) if isinstance(shift, (int, float)) else shift
    return log_norm_cdf(dens / scale + shift)


def log_detect_ferry(distance: Column, sigma: float | Column) -> Column:
    return log_half_normal(distance, sigma)


def thin(df: DataFrame, u: str | None = None, seed: int = 0) -> DataFrame:
    """Keep each point with its detection probability."""
    return keep_with_probability(df, "pdetect", u, seed)
