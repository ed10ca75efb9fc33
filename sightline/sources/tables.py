"""Scans and sinks: Parquet with a declared schema, delimited text, partitioned output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

SIGHTING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("mark_level", T.StringType()),
    T.StructField("age_class", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("sdate", T.DateType()),
    T.StructField("observed", T.IntegerType()),
    T.StructField("tot", T.LongType()),
])

GRID_SCHEMA = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
])


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the base tables, without schema inference."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def scan_matrix(spark: SparkSession, path: str, schema: T.StructType = SIGHTING_SCHEMA) -> DataFrame:
    """A persisted sighting, effort or cluster table; column pruning and filters reach the files."""
    return spark.read.schema(schema).parquet(path)


def scan_delimited(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = False, sep: str = " "
) -> DataFrame:
    """Whitespace-delimited text with a declared schema, with or without a header line.

    Files with a leading row-number column declare it as the first field of ``schema``.
    """
    return spark.read.csv(
        path, schema=schema, sep=sep, header=header,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True,
    )


def sink_delimited(df: DataFrame, path: str, header: bool = False, sep: str = " ") -> str:
    df.write.csv(path, sep=sep, header=header, mode="errorifexists")
    return path


def sink_table(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write a labelled table for the next job, one folder per label where asked."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path
