"""How each kind of stored value becomes a column and back: names with arguments, as job options state them."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import kv
from . import casts, vector


@dataclass(frozen=True)
class Converter:
    """writable: the class of the file; load: stored -> column; store: (column, its type) -> what is written."""

    writable: str
    load: Callable[[Column], Column]
    store: Callable[[Column, str], Column]


def unsupported(kind: str, name: str):
    raise TypeError(f"{name} can't hold {kind}")


def integer(c: Column, kind: str) -> Column:
    """Strings are parsed, longs wrap, floating numbers are cut and saturate."""
    if kind in ("float", "double"):
        return casts.float_to_int(c)
    if kind == "string":
        return casts.parsed(c, "int")
    return casts.wrapped_int(c) if kind in ("bigint", "int", "smallint", "tinyint") else unsupported(kind, "int")


def long(c: Column, kind: str) -> Column:
    if kind in ("float", "double"):
        return casts.float_to_long(c)
    if kind == "string":
        return casts.parsed(c, "bigint")
    return c.cast("bigint") if kind in ("bigint", "int", "smallint", "tinyint") else unsupported(kind, "long")


def number(name: str):
    return lambda c, kind: c.cast(name) if kind in ("string", "bigint", "int", "smallint", "tinyint", "float", "double") else unsupported(kind, name)


def written(c: Column, kind: str) -> Column:
    return casts.as_text(c, kind.startswith(("struct", "array", "map")))


def same(c: Column) -> Column:
    return c


REGISTRY: dict[str, Callable[..., Converter]] = {
    "int": lambda: Converter("IntWritable", same, integer),
    "long": lambda: Converter("LongWritable", same, long),
    "float": lambda: Converter("FloatWritable", same, number("float")),
    "double": lambda: Converter("DoubleWritable", same, number("double")),
    "text": lambda: Converter("Text", same, written),
    "bytes": lambda: Converter("BytesWritable", same, lambda c, kind: c if kind == "binary" else unsupported(kind, "bytes")),
    "null": lambda: Converter("NullWritable", lambda c: F.lit(None).cast("string"), lambda c, kind: F.lit(None)),
    "vector": lambda *a: vector_converter(*a),
}


def vector_converter(*options: str) -> Converter:
    """Vectors as JSON text. Options: -cardinality N, -dense, -sparse, -sequential, -floatPrecision."""
    left, size = list(options), None
    if "-cardinality" in left:
        at = left.index("-cardinality")
        size = int(left[at + 1])
        del left[at : at + 2]
    if bad := set(left) - {"-dense", "-sparse", "-sequential", "-floatPrecision"}:
        raise ValueError(f"no options {sorted(bad)}")
    dense, sparse, single = "-dense" in left, "-sparse" in left, "-floatPrecision" in left
    vector.check(size, dense, sparse, "-sequential" in left)
    kind = "float" if single else "double"
    if dense:
        load = lambda c: (lambda v: v if size is None else vector.exact(v, size))(F.from_json(c, f"array<{kind}>"))
    else:
        load = lambda c: vector.dense_to_sparse(F.from_json(c, f"array<{kind}>"), single)

    def store(c: Column, stored: str) -> Column:
        if stored.startswith("struct"):
            return F.to_json(vector.sparse_to_dense(c, size, single))
        return F.to_json(c if size is None else vector.resized(c, size, single))

    return Converter("Text", load, store)


def converter(options: str = "") -> Converter:
    """`-c name args...` or `--converter name args...`; text without options."""
    words = shlex.split(options)
    if not words:
        return REGISTRY["text"]()
    if words[0] not in ("-c", "--converter") or len(words) < 2:
        raise ValueError(f"no converter in {options!r}")
    if words[1] not in REGISTRY:
        raise ValueError(f"no converter {words[1]}, but {', '.join(sorted(REGISTRY))}")
    return REGISTRY[words[1]](*words[2:])


def load_pairs(spark: SparkSession, path: str, key: str = "", value: str = "", columns: list[str] | None = None) -> DataFrame:
    """key and value of SequenceFiles by converters."""
    if columns is not None and not columns:
        raise ValueError("no columns")
    k, v = converter(key), converter(value)
    rows = kv.read_pairs(spark, path, k.writable, v.writable)
    return rows.select(k.load(F.col("key")).alias("key"), v.load(F.col("value")).alias("value")).select(*(columns or ["key", "value"]))


def store_pairs(df: DataFrame, path: str, key: str = "", value: str = "", codec: str | None = None) -> None:
    """Two columns to SequenceFiles by converters; rows with a null in either are left out."""
    if len(df.columns) != 2:
        raise ValueError(f"a pair has two columns, not {len(df.columns)}")
    (a, ka), (b, kb) = df.dtypes
    rows = df.select(converter(key).store(F.col(a), ka).alias("key"), converter(value).store(F.col(b), kb).alias("value"))
    kv.write_pairs(rows, path, codec)
