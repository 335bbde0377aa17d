"""Lists and objects in a session's configuration, as compressed JSON text."""

from __future__ import annotations

import base64
import gzip
import json

from pyspark.sql import SparkSession


def put(spark: SparkSession, key: str, value) -> None:
    spark.conf.set(key, base64.b64encode(gzip.compress(json.dumps(value).encode(), mtime=0)).decode())


def get(spark: SparkSession, key: str, default=None):
    text = spark.conf.get(key, None)
    return default if text is None else json.loads(gzip.decompress(base64.b64decode(text)))


def put_once(spark: SparkSession, key: str, value: str) -> None:
    """Sets a name that must not change: fails if it is another already."""
    before = spark.conf.get(key, None)
    if before not in (None, value):
        raise ValueError(f"{key} is {before}, not {value}")
    spark.conf.set(key, value)
