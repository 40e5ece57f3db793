"""Readers for the driver's Parquet tables and for metric / alert stores."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.timeutil import epoch_micros

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; projection and filters push into the Parquet scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every driver table as a temporary view under its own name."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_metrics(
    spark: SparkSession,
    path: str,
    metric_type: str | None = None,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read one metric type out of the shared metric store.

    The store may be partitioned by ``metric_type``; the equality then prunes
    partitions, otherwise it becomes a pushed Parquet filter on
    ``metadata.name``.  JSON input is read with a declared schema (no
    inference pass over the data).
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if "_source" in df.columns:
        df = flatten_hits(df)
    if metric_type is None:
        return df
    if "metric_type" in df.columns:
        return df.where(F.col("metric_type") == metric_type)
    return df.where(F.col("metadata.name") == metric_type)


def flatten_hits(df: DataFrame) -> DataFrame:
    """``{_id, _source{…}, sort}`` -> ``{_id, …}``; ``sort`` dropped (S3)."""
    return df.select("_id", "_source.*")


# The time column of each alert table (None = not time-filtered).
ALERT_TIME_COLUMNS = {"alert_rules": None, "alert_messages": "created", "alert_history": "timestamp"}


def read_alerts(spark: SparkSession, path: str, alert_type: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read one alert table."""
    if alert_type not in ALERT_TIME_COLUMNS:
        raise ValueError(f"unknown alert type {alert_type!r}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    return flatten_hits(df) if "_source" in df.columns else df


def to_utc_timestamp_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast ``timestamp_ntz`` columns to instants, reading them as UTC."""
    out = df
    for c in columns:
        if isinstance(df.schema[c].dataType, T.TimestampNTZType):
            out = out.withColumn(c, F.timestamp_micros(epoch_micros(df, c)))
    return out


def normalize_registry(df: DataFrame) -> DataFrame:
    """Registry rows as the console lists them (S7): a missing name reads
    ``Unknown``, missing flags read false."""
    out = df.withColumn("name", F.coalesce(F.col("name"), F.lit("Unknown")))
    for flag in ("enabled", "monitored"):
        if flag in df.columns:
            out = out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


RUN_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("base_name", T.StringType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("query_index", T.IntegerType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("seq", T.LongType()),  # order of execution
        T.StructField("is_warmup", T.BooleanType()),
        T.StructField("measured_iteration", T.IntegerType()),
        T.StructField("took", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark run logs (JSON Lines) with a declared schema."""
    return spark.read.schema(RUN_SCHEMA).json(path)
