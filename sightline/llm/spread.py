"""Joins and buckets whose hot keys are spread over tasks.

A key is hot when it holds more than one row in ``PARTS`` (and more than ``LEAST`` rows), so there are never more than ``PARTS``
hot keys, whatever the input: their rows on the other side are sent to every task, and all other keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import settle

PARTS = 1024
LEAST = 64


def hot_keys(df: DataFrame, on: list[str], least: int = LEAST) -> DataFrame:
    """The hot values of the columns ``on``: at most ``PARTS`` rows, written."""
    counts = settle(df.groupBy(*on).agg(F.count("*").alias("rows_")).filter(F.col("rows_") > least), "frequent")
    bound = max(least, (df.count() if not counts.isEmpty() else 0) // PARTS)
    return settle(counts.filter(F.col("rows_") > bound).select(*on), "hot")


def join_spread(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", least: int = LEAST) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; keys are not null. ``how`` is inner or left."""
    hot = hot_keys(left, on, least)
    few = right.join(F.broadcast(hot), on, "left_semi")
    return left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how).unionByName(
        left.join(F.broadcast(hot), on, "left_anti").join(right, on, how))
