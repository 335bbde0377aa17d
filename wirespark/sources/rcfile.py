"""RCFiles (row groups of columns, each cell a run of bytes), read and written by Spark's own text source.

A file is a header with metadata and a 16-byte sync marker, then row groups; an escape and the marker may stand between
any two. As with block files, reading takes escape and marker as the text source's line separator: a line holds the row
groups between two of them, so files are split by byte ranges. The marker is each file's own, so files with one marker
are read together. Writing gives all files of a DataFrame one marker, ends each row group with it, and uses the marker's
last byte as the sink's line separator.

Only the columns that are asked for are decompressed.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .records import listed, plain
from .thrift_codec import Codec, DecodeError

# Fixed values of the format.
MAGIC, ESCAPE = b"RCF\x01", b"\xff\xff\xff\xff"
COLUMN_NUMBER = "hive.io.rcfile.column.number"
CODECS = {"org.apache.hadoop.io.compress.DefaultCodec": 15, "org.apache.hadoop.io.compress.GzipCodec": 31}

#: Metadata key of the field ids.
IDS = "wirespark.field.ids"
UNKNOWN = -1


def write_vint(n: int) -> bytes:
    """Hadoop's variable-length numbers."""
    if -112 <= n <= 127:
        return struct.pack("b", n)
    sign, n = (-120, ~n) if n < 0 else (-112, n)
    body = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return struct.pack("b", sign - len(body)) + body


def read_vint(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data):
        raise DecodeError("a number is missing")
    (first,) = struct.unpack_from("b", data, at)
    if first >= -112:
        return first, at + 1
    size = -(first + 120) if first < -120 else -(first + 112)
    if at + 1 + size > len(data):
        raise DecodeError("a number doesn't end")
    n = int.from_bytes(data[at + 1 : at + 1 + size], "big")
    return (~n if first < -120 else n), at + 1 + size


def write_text(s: str) -> bytes:
    b = s.encode()
    return write_vint(len(b)) + b


def read_text(data: bytes, at: int) -> tuple[str, int]:
    n, at = read_vint(data, at)
    if n < 0 or at + n > len(data):
        raise DecodeError("a text doesn't end")
    return data[at : at + n].decode("utf-8", "replace"), at + n


class Header:
    def __init__(self, metadata: dict[str, str], sync: bytes, codec: str | None = None):
        self.metadata, self.sync, self.codec = metadata, sync, codec

    def to_bytes(self) -> bytes:
        packed = b"\x01" + write_text(self.codec) if self.codec else b"\x00"
        pairs = b"".join(write_text(k) + write_text(v) for k, v in self.metadata.items())
        return MAGIC + packed + struct.pack(">i", len(self.metadata)) + pairs + self.sync

    @classmethod
    def read(cls, data: bytes) -> tuple[Header, int]:
        if data[:4] != MAGIC or len(data) < 9:
            raise DecodeError("no RCFile")
        at, codec = 5, None
        if data[4]:
            codec, at = read_text(data, at)
        (n,) = struct.unpack_from(">i", data, at)
        at, pairs = at + 4, {}
        for _ in range(n):
            k, at = read_text(data, at)
            pairs[k], at = read_text(data, at)
        if at + 16 > len(data):
            raise DecodeError("a header doesn't end")
        return cls(pairs, bytes(data[at : at + 16]), codec), at + 16

    @property
    def columns(self) -> int:
        return int(self.metadata[COLUMN_NUMBER])

    @property
    def ids(self) -> list[int]:
        """Field ids by column; a file without them can't be read by field."""
        if IDS not in self.metadata:
            raise ValueError("the file has no field ids")
        return json.loads(self.metadata[IDS])

    def pack(self, data: bytes) -> bytes:
        if not self.codec:
            return data
        z = zlib.compressobj(wbits=CODECS[self.codec])
        return z.compress(data) + z.flush()

    def unpack(self, data: bytes) -> bytes:
        return zlib.decompress(data, wbits=CODECS[self.codec]) if self.codec else data


def run_lengths(sizes: list[int]) -> bytes:
    out, i = b"", 0
    while i < len(sizes):
        j = i
        while j + 1 < len(sizes) and sizes[j + 1] == sizes[i]:
            j += 1
        out += write_vint(sizes[i]) + (write_vint(~(j - i)) if j > i else b"")
        i = j + 1
    return out


def row_group(header: Header, columns: list[list[bytes]]) -> bytes:
    """A row group of equally long columns of cells."""
    key, values = write_vint(len(columns[0])), b""
    for cells in columns:
        whole = b"".join(cells)
        packed, sizes = header.pack(whole), run_lengths([len(c) for c in cells])
        key += write_vint(len(packed)) + write_vint(len(whole)) + write_vint(len(sizes)) + sizes
        values += packed
    packed_key = header.pack(key)
    return struct.pack(">iii", len(packed_key) + len(values) if header.codec else len(key) + len(values), len(key), len(packed_key)) + packed_key + values


def row_groups(header: Header, data: bytes, wanted: list[int]) -> Iterator[list[list[bytes]]]:
    """The wanted columns' cells of each row group in data; columns beyond the file's are None."""
    at = 0
    while at < len(data):
        if at + 12 > len(data):
            raise DecodeError("a row group doesn't end")
        _, key_size, packed_size = struct.unpack_from(">iii", data, at)
        at += 12
        if packed_size < 0 or at + packed_size > len(data):
            raise DecodeError("a row group's key doesn't end")
        key = header.unpack(data[at : at + packed_size])
        at += packed_size
        if len(key) != key_size:
            raise DecodeError("a row group's key has another size")
        rows, k = read_vint(key, 0)
        got = {}
        for c in range(header.columns):
            packed, k = read_vint(key, k)
            _, k = read_vint(key, k)
            n, k = read_vint(key, k)
            if c in wanted:
                whole, sizes, i = header.unpack(data[at : at + packed]), [], k
                while i < k + n:
                    v, i = read_vint(key, i)
                    sizes += [sizes[-1]] * ~v if v < 0 else [v]
                if len(sizes) != rows or sum(sizes) != len(whole):
                    raise DecodeError(f"column {c} has other cells than stated")
                cells, place = [], 0
                for s in sizes:
                    cells.append(whole[place : place + s])
                    place += s
                got[c] = cells
            k += n
            at += packed
        if at > len(data):
            raise DecodeError("a row group's values don't end")
        yield [got.get(c, [None] * rows) for c in wanted]


def headers(spark: SparkSession, path: str | list[str]) -> dict[str, Header]:
    """Of each file, read on the driver: a few hundred bytes of each."""
    out = {}
    hadoop = spark._jvm.org.apache.hadoop
    for f in listed(spark, path):
        at = hadoop.fs.Path(f)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.getFileStatus(at).getLen():  # what a writer without rows leaves
            continue
        stream = fs.open(at)
        try:
            data, want = b"", 4096
            while True:
                data += bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, want)))
                try:
                    out[f] = Header.read(data)[0]
                    break
                except (DecodeError, struct.error):
                    if len(data) < want or data[:4] != MAGIC:
                        raise
                    want *= 2
        finally:
            stream.close()
    return out


def by_sync(found: dict[str, Header]) -> list[tuple[Header, list[str]]]:
    groups: dict[bytes, list[str]] = defaultdict(list)
    for f, h in found.items():
        groups[h.to_bytes()].append(f)
    return [(Header.read(b)[0], sorted(fs)) for b, fs in sorted(groups.items())]


def scan(spark: SparkSession, header: Header, files: list[str], wanted: list[int], schema: T.StructType, make) -> DataFrame:
    """make(cells of the wanted columns, a row each) -> dict of a row."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for data in b.column("v").to_pylist():
                start = Header.read(data)[1] if data.startswith(MAGIC) else 0
                for cells in row_groups(header, data[start:], wanted):
                    rows = [make(r) for r in zip(*cells)]
                    for i in range(0, len(rows), 4096):
                        yield pa.RecordBatch.from_pylist(rows[i : i + 4096], arrow)

    ship(spark)
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", (ESCAPE + header.sync).decode("latin-1")).text(files)
    return lines.where(F.octet_length("value") > 0).select(F.col("value").cast("binary").alias("v")).mapInArrow(run, schema)


def union(parts: list[DataFrame], spark: SparkSession, schema: T.StructType) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_columns(spark: SparkSession, path: str | list[str], columns: list[int] | None = None) -> DataFrame:
    """c0, c1, ... binary: the cells of the columns, in the order asked for; an empty cell is null, as is a missing column's."""
    found = by_sync(headers(spark, path))
    wanted = columns if columns is not None else list(range(max([h.columns for h, _ in found], default=0)))
    schema = T.StructType([T.StructField(f"c{c}", T.BinaryType()) for c in wanted])
    make = lambda row: {f"c{c}": v or None for c, v in zip(wanted, row)}
    return union([scan(spark, h, fs, wanted, schema, make) for h, fs in found], spark, schema)


def resolved(ids: list[int], fields: dict[str, int]) -> tuple[dict[str, int], bool]:
    """Stored column by field name; and whether fields without one must be looked for among the unknown ones."""
    place = {i: c for c, i in enumerate(ids) if i > 0}
    known = {name: place[i] for name, i in fields.items() if i in place}
    return known, len(known) < len(fields) and UNKNOWN in ids


def read_records(spark: SparkSession, path: str | list[str], codec: Codec) -> DataFrame:
    """Rows of a Thrift struct stored a field a column, found by field id. codec.columns chooses fields.

    Fields that have no column come from the bytes of unknown fields, if the file keeps them; else they are null.
    """
    fields = {f.name: f for f in codec.schema.structs[codec.name] if codec.columns is None or f.name in codec.columns}
    schema = codec.spark_schema()
    parts = []
    for header, files in by_sync(headers(spark, path)):
        known, more = resolved(header.ids, {n: f.number for n, f in fields.items()})
        names = list(known)
        wanted = [known[n] for n in names] + ([header.ids.index(UNKNOWN)] if more else [])

        def make(row, names=names, more=more):
            out = dict.fromkeys(fields)
            if more and row[-1]:
                out |= {k: v for k, v in codec.decode(row[-1]).items() if v is not None and k in out}
            for n, cell in zip(names, row):
                if cell:
                    codec.data = cell
                    out[n], _ = codec.read(fields[n].kind, 0)
            return out

        parts.append(scan(spark, header, files, wanted, schema, make))
    return union(parts, spark, schema)


def store(df: DataFrame, path: str, header: Header, make, rows: int, mode: str) -> None:
    """make(row values) -> cells."""
    def run(batches):
        ends = (ESCAPE + header.sync)[:-1]
        first, held = True, []

        def groups(last: bool):
            nonlocal held
            while len(held) >= rows or last and held:
                some, held = held[:rows], held[rows:]
                yield row_group(header, [list(c) for c in zip(*some)]) + ends

        for b in batches:
            held += [make([plain(v) for v in r]) for r in zip(*[c.to_pylist() for c in b.columns])]
            made = ([header.to_bytes()[:-1]] if first else []) + list(groups(False))
            first = False
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["v"])
        if made := list(groups(True)):
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["v"])

    ship(df.sparkSession)
    df.mapInArrow(run, "v binary").select(F.col("v").cast("string")).write.mode(mode).option("lineSep", header.sync[-1:].decode()).text(path)


def new_header(columns: int, metadata: dict[str, str], codec: str | None) -> Header:
    if codec is not None and codec not in CODECS:
        raise ValueError(f"no codec {codec}")
    pairs = {COLUMN_NUMBER: str(columns)} | metadata
    return Header(pairs, hashlib.md5(json.dumps(pairs, sort_keys=True).encode()).digest()[:15] + b"\x01", codec)


def write_columns(df: DataFrame, path: str, codec: str | None = None, metadata: dict[str, str] | None = None, rows: int = 4096, mode: str = "error") -> None:
    """Each column's values as the bytes of their strings, or as they are if binary; nulls are empty cells."""
    cells = df.select(*[F.coalesce(F.col(c) if k == "binary" else F.col(c).cast("string").cast("binary"), F.lit(b"")).alias(f"c{i}") for i, (c, k) in enumerate(df.dtypes)])
    store(cells, path, new_header(len(df.columns), metadata or {}, codec), lambda row: row, rows, mode)


def write_records(df: DataFrame, path: str, codec: Codec, compression: str | None = None, unknown: str | None = None, rows: int = 4096, mode: str = "error") -> None:
    """Rows of a Thrift struct, a cell for each top-level field; unknown: a binary column with a struct's bytes of other fields."""
    fields = codec.schema.structs[codec.name]
    names = [f.name for f in fields if f.name in df.columns]
    kinds = {f.name: f.kind for f in fields}
    ids = [next(f.number for f in fields if f.name == n) for n in names] + [UNKNOWN]

    def make(row):
        out = []
        for n, v in zip(names, row):
            cell = bytearray()
            if v is not None:
                codec.write(kinds[n], v, cell)
            out.append(bytes(cell))
        return [*out, bytes(row[len(names)] or b"")]

    last = F.col(unknown) if unknown else F.lit(None).cast("binary")
    store(df.select(*names, last.alias("__unknown")), path, new_header(len(ids), {IDS: json.dumps(ids)}, compression), make, rows, mode)
