"""Text sources and sinks: lines, delimited fields, JSON maps, regular expressions, W3C logs, literals and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Definitions of W3C formats up to which they are broadcast to the lines; beyond, both sides are shuffled.
BROADCAST_DEFINITIONS = 20_000


def read_lines(spark: SparkSession, path, max_bytes: int | None = None, recursive: bool = False, **options) -> DataFrame:
    """`value` string: a row for each line, cut to max_bytes bytes. Compression follows the files' suffixes."""
    rows = spark.read.options(recursiveFileLookup=str(recursive).lower(), **options).text(path)
    if max_bytes is None:
        return rows
    return rows.select(F.expr(f"CAST(substring(CAST(value AS BINARY), 1, {int(max_bytes)}) AS STRING)").alias("value"))


def delimiter(text: str) -> str:
    """The character that a written delimiter stands for: one character, \\t, or \\x or \\u and a decimal number."""
    if len(text) == 1:
        return text
    if text[:1] == "\\" and len(text) > 1:
        if text[1:] == "t":
            return "\t"
        if text[1] in "xu" and text[2:].isdigit():
            return chr(int(text[2:]))
    raise ValueError(f"no delimiter: {text!r}")


def read_delimited(spark: SparkSession, path, schema: str | T.StructType, sep: str = "\\t", **options) -> DataFrame:
    """Fields of lines without quoting; what can't be cast is null."""
    return spark.read.options(sep=delimiter(sep), quote="", mode="PERMISSIVE", **options).schema(schema).csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\\t", mode: str = "error", compression: str = "none") -> None:
    joined = F.concat_ws(delimiter(sep), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(joined.alias("value")).write.mode(mode).option("compression", compression).text(path)


def json_map(text: str | Column, null_as_empty: bool = False, strict_numbers: bool = False) -> Column:
    """A JSON object's members as map<string,string>; null for anything else, and for text that is no JSON.

    strict_numbers: null as well if the object has an integer of over 19 digits.
    """
    column = F.col(text) if isinstance(text, str) else text
    got = F.from_json(column, "map<string,string>")
    if strict_numbers:
        got = F.when(~F.exists(F.map_values(got), lambda v: F.coalesce(v.rlike(r"^-?\d{20,}$"), F.lit(False))), got)
    return F.transform_values(got, lambda k, v: F.coalesce(v, F.lit(""))) if null_as_empty else got


def json_nested(text: str | Column) -> Column:
    """A JSON object as a VARIANT, for access by path; null where there is none."""
    column = F.col(text) if isinstance(text, str) else text
    got = F.try_parse_json(column)
    return F.when(F.schema_of_variant(got).startswith("OBJECT"), got)


def read_json(spark: SparkSession, path, nested: bool = False, null_as_empty: bool = False, strict_numbers: bool = True, seen: Observation | None = None, **options) -> DataFrame:
    """`json`: a map, or a VARIANT with nested, for each line that is a JSON object; other lines are left out.

    seen gets the counts LinesRead, LinesJsonDecoded and LinesParseError.
    """
    rows = spark.read.options(**options).text(path)
    rows = rows.select((json_nested("value") if nested else json_map("value", null_as_empty, strict_numbers)).alias("json"))
    return observed(rows, seen, F.col("json").isNotNull(), "LinesRead", "LinesJsonDecoded", "LinesParseError").where("json IS NOT NULL")


def observed(rows: DataFrame, seen: Observation | None, good: Column, every: str, kept: str, lost: str) -> DataFrame:
    """rows, with counts of all, of the good and of the others for an Observation."""
    if seen is None:
        return rows
    return rows.observe(seen, F.count(F.lit(1)).alias(every), F.count_if(good).alias(kept), F.count_if(~F.coalesce(good, F.lit(False))).alias(lost))


def write_json(df: DataFrame, column: str, path: str, keys: list[str] | None = None, mode: str = "error", compression: str = "none") -> None:
    """A map column as a JSON object a line, with the named keys only if given."""
    m = F.col(column)
    kept = m if keys is None else F.map_filter(m, lambda k, v: k.isin(*keys))
    df.select(F.to_json(kept, {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).option("compression", compression).text(path)


def base64_line(c: str | Column) -> Column:
    """Base64 without line breaks, whatever the session says about them."""
    return F.regexp_replace(F.base64(c), r"[\r\n]+", "")


def base64_bytes(c: str | Column) -> Column:
    """The bytes of a base64 text without what isn't base64 at its ends; null if it is none within."""
    text = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[^A-Za-z0-9+/=]+|[^A-Za-z0-9+/=]+$", "")
    return F.try_to_binary(text, F.lit("base64"))


def write_pairs_text(df: DataFrame, path: str, sep: str = "\\t", mode: str = "error", compression: str = "none") -> None:
    """Lines of key, separator and value; a null in either leaves out both it and the separator."""
    key, value = [F.col(c).cast("string") for c in df.columns]
    line = F.when(key.isNull(), value).when(value.isNull(), key).otherwise(F.concat(key, F.lit(delimiter(sep)), value))
    df.select(F.coalesce(line, F.lit("")).alias("value")).write.mode(mode).option("compression", compression).text(path)


def regex_fields(text: str | Column, pattern: str, groups: int) -> list[Column]:
    """What each group of the first find matched, '' where a group had no part in it."""
    column = F.col(text) if isinstance(text, str) else text
    pattern = pattern.replace("\\\\", "\\")
    return [F.regexp_extract(column, pattern, i + 1) for i in range(groups)]


def parse_regex(df: DataFrame, text: str, pattern: str, names: list[str], seen: Observation | None = None) -> DataFrame:
    """Columns by group for the rows in which pattern is found; other rows are left out.

    seen gets the counts Lines, MatchedRegexLines and UnmatchedRegexLines.
    """
    single = pattern.replace("\\\\", "\\")
    df = observed(df, seen, F.col(text).rlike(single), "Lines", "MatchedRegexLines", "UnmatchedRegexLines")
    return df.where(F.col(text).rlike(single)).select(*[c.alias(n) for c, n in zip(regex_fields(text, pattern, len(names)), names)])


def read_regex(spark: SparkSession, path, pattern: str, names: list[str], **options) -> DataFrame:
    return parse_regex(spark.read.options(**options).text(path), "value", pattern, names)


def w3c_definitions(spark: SparkSession, path) -> DataFrame:
    """crc, names: the field lists of a definition file, a line each (crc, then names)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("crc"), parts.alias("names"))


def parse_w3c(lines: DataFrame, definitions: DataFrame, text: str = "value") -> DataFrame:
    """`data` map: fields by name, chosen by each line's leading crc; lines that fit no definition are left out.

    Definitions are few (one for each version of a log's format), so lines are looked up where they are read: dealt by
    crc, all lines of a format would meet in one task. They are counted before, as Spark doesn't know every table's size.
    """
    definitions = definitions.select("crc", "names")
    if definitions.limit(BROADCAST_DEFINITIONS + 1).count() <= BROADCAST_DEFINITIONS:
        definitions = F.broadcast(definitions)
    parts = lines.select(F.split(F.trim(text), r"\s+").alias("parts")).withColumn("crc", F.col("parts")[0])
    joined = parts.join(definitions, "crc").where(F.size("parts") == F.size("names"))
    rest = lambda c: F.slice(c, 2, F.size(c) - 1)
    return joined.select(F.map_from_arrays(rest(F.col("names")), rest(F.col("parts"))).alias("data"))


def location_tuple(spark: SparkSession, text: str, sep: str = ",") -> DataFrame:
    """One row of as many string columns as text has parts; trailing empty parts count."""
    parts = text.split(sep)
    return spark.range(1).select(*[F.lit(p).alias(f"_{i}") for i, p in enumerate(parts)])


def integer_range(spark: SparkSession, least: int, most: int, splits: int = 1) -> DataFrame:
    """`value`: the integers from least to most, both included, in at most so many partitions of equal length."""
    if least > most:
        raise ValueError(f"{least} > {most}")
    if splits < 1:
        raise ValueError("at least one split")
    n = most - least + 1
    each = -(-n // splits)
    return spark.range(least, most + 1, 1, -(-n // each)).withColumnRenamed("id", "value")
