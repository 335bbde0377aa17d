"""SequenceFiles as two-column DataFrames."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .rcfile import write_vint

#: Column types by Writable class.
WRITABLES = {"IntWritable": T.IntegerType(), "LongWritable": T.LongType(), "FloatWritable": T.FloatType(), "DoubleWritable": T.DoubleType(), "BooleanWritable": T.BooleanType(), "Text": T.StringType(), "BytesWritable": T.BinaryType(), "NullWritable": T.NullType()}
#: How a column type is written.
WRITTEN = {"IntegerType": "IntWritable", "LongType": "LongWritable", "FloatType": "FloatWritable", "DoubleType": "DoubleWritable", "BooleanType": "BooleanWritable", "StringType": "Text", "BinaryType": "BytesWritable"}
PACKAGE = "org.apache.hadoop.io."
#: Records between two sync markers.
GROUP = 64


def sized(b: bytes) -> bytes:
    return write_vint(len(b)) + b


#: Bytes of a value by Writable class.
ENCODED = {
    "IntWritable": lambda v: struct.pack(">i", v),
    "LongWritable": lambda v: struct.pack(">q", v),
    "FloatWritable": lambda v: struct.pack(">f", v),
    "DoubleWritable": lambda v: struct.pack(">d", v),
    "BooleanWritable": lambda v: struct.pack(">?", v),
    "Text": lambda v: sized(v.encode("utf-8", "surrogatepass")),
    "BytesWritable": lambda v: struct.pack(">i", len(v)) + v,
}


def read_pairs(spark: SparkSession, path: str, key: str = "Text", value: str = "Text", columns: list[str] | None = None, splits: int = 0) -> DataFrame:
    """key and value; columns: which of the two, in order. Both are named by their Writable classes.

    Files that end within a record fail, unless spark.files.ignoreCorruptFiles was set when the application began.
    """
    for name in columns or []:
        if name not in ("key", "value"):
            raise ValueError(f"a pair has no {name}")
    rdd = spark.sparkContext.sequenceFile(path, PACKAGE + key, PACKAGE + value, minSplits=splits or None)
    schema = T.StructType([T.StructField("key", WRITABLES[key]), T.StructField("value", WRITABLES[value])])
    clean = rdd.map(lambda kv: tuple(bytearray(x) if isinstance(x, (bytes, bytearray)) else x for x in kv))
    return spark.createDataFrame(clean, schema).select(*(columns or ["key", "value"]))


def read_raw_pairs(spark: SparkSession, path: str) -> DataFrame:
    """key and value as the bytes that their Writables wrote, whatever classes those are; none is loaded."""
    rdd = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.SequenceFileAsBinaryInputFormat", PACKAGE + "BytesWritable", PACKAGE + "BytesWritable")
    return spark.createDataFrame(rdd.map(lambda kv: (bytearray(kv[0]), bytearray(kv[1]))), "key binary, value binary")


def write_pairs(df: DataFrame, path: str, codec: str | None = None, mode: str = "error") -> None:
    """Two columns as keys and values; rows with a null in either are left out.

    Without a codec, Spark's text sink writes the files: records in groups that end with the sync marker, whose last
    byte is the sink's line separator. With one (a Hadoop compression class) the values are compressed in blocks by
    Hadoop's own writer, which has no DataFrame sink: one of the few RDD paths, and without long columns.
    """
    if len(df.columns) != 2:
        raise ValueError(f"a pair has two columns, not {len(df.columns)}")
    for f in df.schema.fields:
        if type(f.dataType).__name__ not in WRITTEN or codec and isinstance(f.dataType, T.LongType):
            raise ValueError(f"{f.name} can't be written as {f.dataType.simpleString()}")
    kinds = [WRITTEN[type(f.dataType).__name__] for f in df.schema.fields]
    rows = df.toDF("key", "value").where(F.col("key").isNotNull() & F.col("value").isNotNull())
    if codec:
        settings = {"mapreduce.output.fileoutputformat.compress": "true", "mapreduce.output.fileoutputformat.compress.codec": codec, "mapreduce.output.fileoutputformat.compress.type": "BLOCK"}
        rows.rdd.map(tuple).saveAsNewAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat", *[PACKAGE + k for k in kinds], conf=settings)
        return
    sync = hashlib.md5(" ".join(kinds).encode()).digest()[:15] + b"\x01"
    header = b"SEQ\x06" + b"".join(sized(PACKAGE.encode() + k.encode()) for k in kinds) + bytes(6) + sync
    key, value = (ENCODED[k] for k in kinds)

    def run(batches):
        start = True
        for b in batches:
            records = [struct.pack(">ii", len(k) + len(v), len(k)) + k + v for k, v in zip(map(key, b.column("key").to_pylist()), map(value, b.column("value").to_pylist()))]
            groups = [b"".join(records[i : i + GROUP]) + b"\xff\xff\xff\xff" + sync[:-1] for i in range(0, len(records), GROUP)]
            yield pa.RecordBatch.from_arrays([pa.array([header[:-1]] * start + groups, pa.binary())], ["v"])
            start = False

    ship(df.sparkSession)
    rows.mapInArrow(run, "v binary").select(F.col("v").cast("string")).write.mode(mode).option("lineSep", "\x01").text(path)
