"""Streams of text files through the same parsers as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import json_map, parse_regex


def stream_json(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """`json` maps of the lines of files as they arrive; lines that are no objects are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(json_map("value").alias("json")).where("json IS NOT NULL")


def stream_regex(spark: SparkSession, path: str, pattern: str, names: list[str], max_files: int = 1000) -> DataFrame:
    return parse_regex(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), "value", pattern, names)


def windowed_counts(rows: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """window start, key, n: counts in tumbling windows; rows later than `late` are dropped, and closed windows' state with them."""
    w = F.window(time, width)
    return rows.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
