"""Scans of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = "repo string, path string, content string"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def secrets_by_repository(files: DataFrame) -> DataFrame:
    """A running count of hard-coded values of each repository; its state is a row for each."""
    found = F.size(F.filter(F.regexp_extract_all("content", F.lit(text.ASSIGNMENT), 2), text.looks_secret))
    return files.groupBy("repo").agg(F.count("*").alias("files"), F.sum(found).cast("long").alias("secrets"))
