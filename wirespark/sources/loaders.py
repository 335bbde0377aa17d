"""One entrance to the record sources: what a file holds is told by the codec, how by the layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import proto_codec, records, thrift_codec


def codec_of(idl: str, name: str, **options):
    """The codec of a Thrift struct or a Protocol Buffers message, told by which of the two declares the name."""
    try:
        schema = thrift_codec.parse(idl)
        if name in schema.structs and "message" not in idl.split():
            return thrift_codec.Codec(schema, name, **options)
    except ValueError:
        pass
    file = proto_codec.parse(idl)
    if not any(name.split(".")[0] == m.name for m in file.message_type):
        raise ValueError(f"{name} is neither a struct nor a message of this text")
    return proto_codec.Codec(file, name, **options)


def load(spark: SparkSession, path, idl: str, name: str, columns: list[str] | None = None, layout: str = "auto", enum_as_int: bool = False, bool_as_int: bool = True, **tolerance) -> DataFrame:
    """Records of a declared type from block files, base64 lines or both; columns in the order asked for."""
    codec = codec_of(idl, name, columns=columns, enum_as_int=enum_as_int, bool_as_int=bool_as_int)
    missing = set(columns or ()) - set(codec.spark_schema().names)
    if missing:
        raise ValueError(f"{name} has no {', '.join(sorted(missing))}")
    rows = records.read_records(spark, path, codec, layout, **tolerance)
    return rows.select(*columns) if columns else rows


def register(spark: SparkSession, view: str, path, idl: str, name: str, **options) -> DataFrame:
    """The same as a view for SQL: the type's text and name stand for a table's serialization class."""
    df = load(spark, path, idl, name, **options)
    df.createOrReplaceTempView(view)
    return df


def load_script(idl: str, name: str, **options) -> str:
    """The type's columns as DDL, for people to read."""
    return ",\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in codec_of(idl, name, **options).spark_schema().fields)
