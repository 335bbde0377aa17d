"""Columnar records with field ids: columns are found by id, so that names and order may change between writers.

Files are Parquet with field ids in their schema. What a record has beyond the known fields stays, as bytes, in one
more column (`UNKNOWN`), from which a reader with a wider schema takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "__unknown_fields"


def with_ids(schema: T.StructType, ids: dict[str, int]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, {"parquet.field.id": ids[f.name]}) for f in schema.fields])


def write_columns(df: DataFrame, path: str, ids: dict[str, int], mode: str = "error", partition_by: list[str] = ()) -> None:
    """Each column under its field id. Ids must be given for all columns, and differ."""
    if missing := set(df.columns) - ids.keys():
        raise ValueError(f"no field ids for {sorted(missing)}")
    if len({ids[c] for c in df.columns}) < len(df.columns):
        raise ValueError("two columns have one field id")
    spark = df.sparkSession
    marked = df.select(*[F.col(c).alias(c, metadata={"parquet.field.id": ids[c]}) for c in df.columns])
    before = spark.conf.get("spark.sql.parquet.fieldId.write.enabled")
    spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
    try:
        marked.write.mode(mode).partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set("spark.sql.parquet.fieldId.write.enabled", before)


def read_columns(spark: SparkSession, path: str, schema: T.StructType, ids: dict[str, int]) -> DataFrame:
    """The schema's columns by field id, null where a file has none; only what a query uses is read.

    Sets the session to read by field id, which leaves files without ids as they are.
    """
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    return spark.read.schema(with_ids(schema, ids)).parquet(path)
