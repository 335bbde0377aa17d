"""Relational pieces that record jobs are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path


def present_in(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that occur in others, all columns compared null-safe by name. Spark broadcasts others by its size only."""
    names = rows.columns
    right = others.select(*[F.col(c).alias(f"__{c}") for c in names]).distinct()
    on = None
    for c in names:
        same = rows[c].eqNullSafe(right[f"__{c}"])
        on = same if on is None else on & same
    return rows.join(right, on, "left_semi")


def word_count(lines: DataFrame, text: str) -> DataFrame:
    """word, n: words are runs without white space; counted on the map side first."""
    words = lines.select(F.explode(F.split(F.col(text), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def map_sums(rows: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """key, total: long sums of a string map's values by key; strict: a value that is no number fails."""
    pairs = rows.select(F.explode(column).alias("key", "v"))
    v = F.col("v").cast("long") if strict else F.col("v").try_cast("long")
    return pairs.groupBy("key").agg(F.sum(v).alias("total"))


def nested_counts(rows: DataFrame, key: str, items: str) -> DataFrame:
    """key, n: how many items a key's arrays hold, keys without items left out."""
    return rows.select(key, F.explode(items)).groupBy(key).agg(F.count("*").alias("n"))


def byte_order(c: str | Column) -> Column:
    """Sorts as unsigned bytes."""
    return (F.col(c) if isinstance(c, str) else c).cast("binary")


def length_first(c: str | Column) -> list[Column]:
    """Sorts shorter values first, then by signed bytes: the upper half of the bytes before the lower."""
    b = byte_order(c)
    flipped = F.transform(F.split(F.hex(b), "(?<=\\G..)"), lambda h: F.when(h >= "80", F.concat(F.lit("0"), h)).otherwise(F.concat(F.lit("1"), h)))
    return [F.octet_length(b), F.array_join(flipped, "")]


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the total order of its rows; ties in any order.

    No task sees all rows, as it would in a window without partitions: rows are dealt into ranges and stored with their
    range's number; places are counted inside the ranges and added to the sizes of those before.
    """
    spark = df.sparkSession
    at = new_path(spark, "ranges")
    keys = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    keyed = df.select(*df.columns, *keys)
    by = [F.col(f"__o{i}") for i in range(len(order))]
    keyed.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()).write.parquet(at)
    rows = spark.read.parquet(at)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("n"))
    first = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    return rows.withColumn("__inside", inside).join(first, "__range").select(*df.columns, (F.col("__first") + F.col("__inside")).alias(name))
