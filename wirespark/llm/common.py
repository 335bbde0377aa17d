"""What the corpus operators share: the shared folder, staged tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import new_path

#: Rows of an Arrow batch that carries texts, so that a worker holds few long ones at once.
TEXT_BATCH = 512


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by staged()."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(df: DataFrame, f: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """mapInArrow with f given batches of at most TEXT_BATCH rows."""

    def small(batches):
        def cut():
            for b in batches:
                for i in range(0, b.num_rows, TEXT_BATCH):
                    yield b.slice(i, TEXT_BATCH)

        yield from f(cut())

    ship(df.sparkSession)
    return df.mapInArrow(small, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame, most_mb: int = 64) -> DataFrame:
    """df, dealt to all cores if it lies in fewer files than there are cores, of up to most_mb a core.

    A small file is often one row group, which is one task however many cores are idle. Larger tables stay as they are.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(cores) if size <= cores * (most_mb << 20) else df


def is_small(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows; looks at no more than one row beyond them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """df hinted for broadcast if it has at most so many (narrow) rows; else unchanged, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df
