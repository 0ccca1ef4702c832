"""Caches as Parquet tables that only grow: the newest row of a key counts, and each row keeps the time at which it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .findings import latest, unexpired

#: Seconds for which each kind of row holds.
SECONDS = {"ast": 24 * 3600, "vulnerability": 7 * 24 * 3600, "scan": 3600}


def written(rows: DataFrame, path: str, kind: str, now=None) -> None:
    """rows (key, value) are added; older rows of other keys keep their times."""
    at = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    rows.select("key", "value", F.lit(kind).alias("kind"), at.alias("created_at"), F.lit(SECONDS[kind]).cast("long").alias("ttl_secs")).write.mode("append").partitionBy("kind").parquet(path)


def read(spark: SparkSession, path: str, kind: str, now) -> DataFrame:
    """The newest row of each key that still holds; other kinds aren't read."""
    rows = spark.read.schema("key string, value string, created_at timestamp, ttl_secs long, kind string").parquet(path).where(F.col("kind") == kind)
    return unexpired(latest(rows, ["key"]), now)


def stats(rows: DataFrame) -> DataFrame:
    """Different keys of each kind."""
    return rows.groupBy("kind").agg(F.count_distinct("key").alias("entries"))
