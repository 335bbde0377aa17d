"""Binary records in block files and in lines of base64, of any codec, read and written by Spark's own text source.

A block is a 16-byte marker, the size of what follows as a little-endian 32-bit number, and an envelope in Protocol
Buffer form {1: version, 2: class name, 3: repeated bytes of records}. Reading takes the marker as the text source's
line separator, so that files are listed, split by byte ranges and decompressed as any text is; a line is a block.
Writing ends the envelope with its version field, whose last byte serves as the line separator of the text sink.

Only the codec's own work is done in Python, in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .thrift_codec import DecodeError
from .text import base64_bytes, base64_line
from .tolerance import ErrorBudget

#: Fixed values of the format.
MARKER = bytes([0x29, 0xD8, 0xD5, 0x06, 0x58, 0xCD, 0x4C, 0x29, 0xB2, 0xBC, 0x57, 0x99, 0x21, 0x71, 0xBD, 0xFF])
VERSION = 1
RECORDS_IN_BLOCK = 100
#: Files whose beginnings are looked at together.
SNIFFERS = 32


class Raw:
    """The codec of records that stay bytes."""

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField("bytes", T.BinaryType())])

    def decode(self, data: bytes) -> dict:
        return {"bytes": data}

    def encode(self, value) -> bytes | None:
        v = value.get("bytes") if isinstance(value, dict) else value[0]
        return None if v is None else bytes(v)


# The envelope.
def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise DecodeError("a number doesn't end")
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def block(class_name: str, records: Iterable[bytes]) -> bytes:
    """A whole block, whose last byte is VERSION."""
    name = class_name.encode()
    body = b"\x12" + varint(len(name)) + name + b"".join(b"\x1a" + varint(len(r)) + r for r in records) + b"\x08" + varint(VERSION)
    return MARKER + struct.pack("<i", len(body)) + body


def records_of(framed: bytes) -> tuple[str, list[bytes]]:
    """Class name and records of a block without its marker. What follows the stated size is passed over."""
    if len(framed) < 4:
        raise DecodeError("a block without size")
    (size,) = struct.unpack_from("<i", framed)
    if size < 0 or size > len(framed) - 4:
        raise DecodeError(f"a block of {size} bytes has {len(framed) - 4}")
    data, at, name, out = framed[4 : 4 + size], 0, "", []
    while at < len(data):
        tag, at = read_varint(data, at)
        if tag & 7 == 0:
            _, at = read_varint(data, at)
            continue
        if tag & 7 != 2:
            raise DecodeError(f"tag {tag} in a block")
        n, at = read_varint(data, at)
        if at + n > len(data):
            raise DecodeError("a block ends within a record")
        if tag >> 3 == 2:
            name = data[at : at + n].decode("utf-8", "replace")
        elif tag >> 3 == 3:
            out.append(data[at : at + n])
        at += n
    return name, out


# Layouts.
def is_block_file(spark: SparkSession, path: str) -> bool:
    """True if the (decompressed) file begins with the marker; else it is taken for lines of base64."""
    hadoop = spark._jvm.org.apache.hadoop
    at, conf = hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    stream = at.getFileSystem(conf).open(at)
    try:
        packed = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        source = packed.createInputStream(stream) if packed is not None else stream
        return bytes(source.readNBytes(len(MARKER))) == MARKER
    finally:
        stream.close()


def listed(spark: SparkSession, path: str | list[str]) -> list[str]:
    return spark.read.option("recursiveFileLookup", "true").text(path).inputFiles()


def framed_records(spark: SparkSession, path: str | list[str], layout: str = "auto") -> DataFrame:
    """One column, `framed`: blocks (without markers) of block files, or records of base64 lines; and `is_block`.

    layout: block, b64line, or auto, which looks at the beginning of each file.
    """
    if layout not in ("auto", "block", "b64line"):
        raise ValueError(f"no layout {layout}")
    paths = [path] if isinstance(path, str) else list(path)
    if layout == "auto":
        files = listed(spark, paths)
        # A few bytes of each file, many files at a time: what waits here is the file system.
        with ThreadPoolExecutor(SNIFFERS) as pool:
            blocks = [f for f, is_block in zip(files, pool.map(lambda f: is_block_file(spark, f), files)) if is_block]
        lines = sorted(set(files) - set(blocks))
        parts = [framed_records(spark, p, kind) for kind, p in (("block", blocks), ("b64line", lines)) if p]
        if not parts:
            return spark.createDataFrame([], "framed binary, is_block boolean")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if layout == "block":
        rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MARKER.decode("latin-1")).option("recursiveFileLookup", "true").text(paths)
        return rows.where(F.octet_length("value") > 0).select(F.col("value").cast("binary").alias("framed"), F.lit(True).alias("is_block"))
    rows = spark.read.option("recursiveFileLookup", "true").text(paths).where(F.octet_length(F.trim("value")) > 0)
    # A line that is no base64 is a bad record: it goes on as a null.
    return rows.select(base64_bytes("value").alias("framed"), F.lit(False).alias("is_block"))


def named_records(spark: SparkSession, path: str | list[str], threshold: float = 0.0001, least: int = 2, early: bool = False) -> DataFrame:
    """class_name (as the block says), record (bytes, undecoded) of block files that may hold any classes. Bad blocks are tolerated by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = ErrorBudget(threshold, least, early)
        for b in batches:
            for data in b.column("framed").to_pylist():
                try:
                    name, records = records_of(data)
                    budget.good()
                except DecodeError as e:
                    budget.bad(e)
                    continue
                records = [r for r in records if r]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(records), pa.string()), pa.array(records, pa.binary())], ["class_name", "record"])
        budget.close()

    framed = framed_records(spark, path, "block").select("framed")
    ship(spark)
    return framed.mapInArrow(run, "class_name string, record binary")


class Counters:
    """What a scan saw, over all partitions: records, errors, empty records. Retried tasks count again."""

    def __init__(self, spark: SparkSession):
        self.records, self.errors, self.empty = (spark.sparkContext.accumulator(0) for _ in range(3))

    def values(self) -> dict[str, int]:
        return {"Records Read": self.records.value, "Errors": self.errors.value, "Records Skipped": self.empty.value}


def read_records(spark: SparkSession, path: str | list[str], codec, layout: str = "auto", threshold: float = 0.0001, least: int = 2, early: bool = False, counters: Counters | None = None) -> DataFrame:
    """A DataFrame of the codec's columns. Empty records vanish; bad ones are tolerated as ErrorBudget says, by partition."""
    return decoded(framed_records(spark, path, layout), codec, threshold, least, early, counters)


def decoded(framed: DataFrame, codec, threshold: float = 0.0001, least: int = 2, early: bool = False, counters: Counters | None = None) -> DataFrame:
    kind = codec.spark_schema()
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget, empty = ErrorBudget(threshold, least, early), 0
        for b in batches:
            rows = []
            for data, whole in zip(b.column("framed").to_pylist(), b.column("is_block").to_pylist()):
                try:
                    if data is None:
                        raise DecodeError("no base64")
                    records = records_of(data)[1] if whole else [data]
                except DecodeError as e:
                    budget.bad(e)
                    continue
                for r in records:
                    if not r:
                        empty += 1
                        continue
                    try:
                        rows.append(codec.decode(r))
                        budget.good()
                    except DecodeError as e:
                        budget.bad(e)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)
        if counters:
            counters.records.add(budget.records - budget.errors)
            counters.errors.add(budget.errors)
            counters.empty.add(empty)
        budget.close()

    ship(framed.sparkSession)
    return framed.mapInArrow(run, kind)


def encoded(df: DataFrame, codec) -> DataFrame:
    """One binary column, `record`: a row each, by position; rows that are null as a whole are dropped."""
    wanted = codec.spark_schema()
    if len(df.columns) > len(wanted):
        raise ValueError(f"{len(df.columns)} columns for {len(wanted)} fields")
    names = [f.name for f in wanted][: len(df.columns)]

    def run(batches):
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            out = [None if all(v is None for v in row) else codec.encode(dict(zip(names, map(plain, row)))) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r in out if r is not None], pa.binary())], ["record"])

    ship(df.sparkSession)
    return df.mapInArrow(run, "record binary")


def check_schema(df: DataFrame, codec) -> None:
    """Fails unless df has the codec's columns with their types, in order."""
    want, got = codec.spark_schema(), df.schema
    bare = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    if bare(want) != bare(got):
        raise ValueError(f"expected {want.simpleString()}, not {got.simpleString()}")


def plain(v):
    """Arrow's maps come as lists of pairs."""
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def write_records(df: DataFrame, path: str, codec, layout: str = "block", class_name: str = "", mode: str = "error", compression: str = "none", in_block: int = RECORDS_IN_BLOCK) -> None:
    records = encoded(df, codec)
    writer = lambda d: d.write.mode(mode).option("compression", compression)
    if layout == "b64line":
        writer(records.select(base64_line("record").alias("value"))).text(path)
        return
    if layout != "block":
        raise ValueError(f"no layout {layout}")

    def run(batches):
        held: list[bytes] = []
        for b in batches:
            held += b.column(0).to_pylist()
            full = len(held) - len(held) % in_block
            if full:
                yield pa.RecordBatch.from_arrays([pa.array([block(class_name, held[i : i + in_block])[:-1] for i in range(0, full, in_block)], pa.binary())], ["value"])
                held = held[full:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(class_name, held)[:-1]], pa.binary())], ["value"])

    blocks = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    writer(blocks).option("lineSep", chr(VERSION)).text(path)
