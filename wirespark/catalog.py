"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import casts, inflect, invoke, vector
from .operators import counters as side_counters
from .operators import relational, search
from .sources import columnar, cross_idl, kv, loaders, proto_codec, rcfile, records, text, thrift_codec
from .storage import new_path
from .streaming import lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of (spark, table) under its name, with its SQL; table(name) reads a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = sql
        return f

    return add


# JSON.
@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) AS n FROM events GROUP BY 1")
def json_flat_sum(spark, table):
    rows = table("events").select("event_type", text.json_map("props").alias("json"))
    return rows.groupBy("event_type").agg(F.sum(F.expr("try_cast(json['k'] AS BIGINT)")).alias("sum_k"), F.count("*").alias("n"))


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_key_count(spark, table):
    return table("events").select(F.explode(text.json_map("props")).alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT 'k' AS key, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events")
def json_word_count(spark, table):
    return relational.map_sums(table("events").select(text.json_map("props").alias("json")), "json")


@query("SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events")
def json_distinct_values(spark, table):
    return table("events").select(text.json_map("props")["k"].alias("k")).distinct()


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_store_whitelist(spark, table):
    """Stored with a whitelist of keys, loaded again."""
    at = new_path(spark, "json")
    rows = table("events").select(F.map_concat(text.json_map("props"), F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("type"), F.col("event_type"))).alias("m"))
    text.write_json(rows, "m", at, ["id", "k"])
    return text.read_json(spark, at).select(F.col("json")["id"].cast("long").alias("event_id"), F.col("json")["k"].alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_nested_variant(spark, table):
    rows = table("events").select("event_id", text.json_nested(F.concat(F.lit('{"a":{"b":['), "props", F.lit("]}}"))).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.a.b[0].k", "bigint").alias("k"))


# Text.
@query(r"SELECT page_id, regexp_extract(url, '^(\w+)://([^/]+)(/[^?]*)?', 1) AS scheme, regexp_extract(url, '^(\w+)://([^/]+)(/[^?]*)?', 2) AS host, regexp_extract(url, '^(\w+)://([^/]+)(/[^?]*)?', 3) AS path FROM pages WHERE regexp_matches(url, '^(\w+)://([^/]+)(/[^?]*)?')")
def regex_extract_url(spark, table):
    pages = table("pages").select("page_id", "url")
    fields = text.regex_fields("url", r"^(\w+)://([^/]+)(/[^?]*)?", 3)
    return pages.where(F.col("url").rlike(r"^(\w+)://([^/]+)(/[^?]*)?")).select("page_id", *[c.alias(n) for c, n in zip(fields, ("scheme", "host", "path"))])


@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(spark, table):
    return relational.word_count(table("documents"), "text")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def delimited_roundtrip(spark, table):
    at = new_path(spark, "delimited")
    text.write_delimited(table("nation"), at, "\\x124", compression="bzip2")
    return text.read_delimited(spark, at, "n_nationkey int, n_name string, n_regionkey int", "|")


@query("SELECT substring(c_custkey || ' ' || c_name, 1, 12) AS value FROM customer")
def line_truncation(spark, table):
    at = new_path(spark, "lines")
    table("customer").select(F.concat_ws(" ", "c_custkey", "c_name").alias("value")).write.option("compression", "gzip").text(at)
    return text.read_lines(spark, at, max_bytes=12)


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CAST(user_id AS VARCHAR) AS \"user\" FROM events WHERE user_id % 2 = 0 UNION ALL SELECT CAST(event_id AS VARCHAR), event_type, NULL FROM events WHERE user_id % 2 = 1")
def w3c_parse(spark, table):
    """Two formats of lines, and lines of neither, which fall out."""
    even = F.concat_ws(" ", F.lit("487077199"), "event_id", "event_type", "user_id")
    odd = F.concat_ws("\t", F.lit("99"), "event_id", "event_type")
    events = table("events")
    lines = events.select(F.when(F.col("user_id") % 2 == 0, even).otherwise(odd).alias("value")).union(events.select(F.concat_ws(" ", F.lit("99"), "event_id", "event_type", F.lit("more")))).union(events.select(F.concat_ws(" ", F.lit("12345"), "event_id", "event_type")))
    known = spark.createDataFrame([("487077199", ["crc", "id", "kind", "user"]), ("99", ["crc", "id", "kind"])], "crc string, names array<string>")
    return text.parse_w3c(lines, known).select(*[F.col("data")[c].alias(c) for c in ("id", "kind", "user")])


@query("SELECT range AS value FROM range(-6, 85)")
def int_range(spark, table):
    return text.integer_range(spark, -6, 84, 7)


@query("SELECT 'a' AS _0, 'b\tc' AS _1, '' AS _2")
def location_tuple(spark, table):
    return text.location_tuple(spark, "a,b\tc,")


# Relational demonstrations.
@query("SELECT c_name FROM customer")
def order_names(spark, table):
    return table("customer").select("c_name").orderBy("c_name")


@query("SELECT c_custkey, row_number() OVER (ORDER BY encode(c_name), c_custkey) AS place FROM customer")
def record_sort(spark, table):
    return relational.numbered(table("customer").select("c_custkey", "c_name"), [relational.byte_order("c_name"), F.col("c_custkey")]).select("c_custkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY length(p_name), p_name, p_partkey) AS place FROM part")
def length_first_sort(spark, table):
    return relational.numbered(table("part").select("p_partkey", "p_name"), [*relational.length_first("p_name"), F.col("p_partkey")]).select("p_partkey", "place")


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join_broadcast(spark, table):
    big = table("orders").where("o_totalprice > 300000").select("o_custkey").distinct()
    customers = table("customer")
    return customers.join(big, customers["c_custkey"] == big["o_custkey"], "left_semi")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3)")
def present_records(spark, table):
    """Whole records that occur among those of a nested list."""
    nation = table("nation")
    book = nation.where("n_regionkey IN (1, 3)").groupBy("n_regionkey").agg(F.collect_list(F.struct(*nation.columns)).alias("people"))
    return relational.present_in(nation, book.select(F.explode("people").alias("p")).select("p.*"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def explode_count(spark, table):
    nested = table("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    return relational.nested_counts(nested, "l_orderkey", "lines")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_distinct(spark, table):
    rich = table("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table("lineitem").select("l_suppkey").join(rich, "l_suppkey", "left_semi").distinct()


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def group_all_sum(spark, table):
    return table("lineitem").agg(F.sum("l_linenumber").alias("total"))


# Vectors.
@query("SELECT vec_id, i - 1 AS \"index\", CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) WHERE embedding[i] <> 0")
def vector_dense_to_sparse(spark, table):
    rows = table("embeddings").select("vec_id", vector.dense_to_sparse("embedding").alias("v"))
    return rows.select("vec_id", F.explode("v.entries").alias("e")).select("vec_id", F.col("e.index").cast("long").alias("index"), "e.value")


@query("SELECT vec_id, i - 1 AS \"index\", CASE WHEN embedding[i] > 0 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)")
def vector_sparse_to_dense(spark, table):
    v = vector.dense_to_sparse("embedding")
    positive = F.struct(v["cardinality"].alias("cardinality"), F.filter(v["entries"], lambda e: e["value"] > 0).alias("entries"))
    rows = table("embeddings").select("vec_id", positive.alias("v")).select("vec_id", vector.sparse_to_dense("v").alias("d"))
    return rows.select("vec_id", F.posexplode("d").alias("index", "value")).select("vec_id", F.col("index").cast("long").alias("index"), "value")


@query("SELECT vec_id, i - 1 AS \"index\", CAST(coalesce(embedding[i], 0) AS DOUBLE) AS value FROM embeddings, unnest(range(1, 71)) AS t(i)")
def vector_resize(spark, table):
    rows = table("embeddings").select("vec_id", vector.resized("embedding", 70).alias("d"))
    return rows.select("vec_id", F.posexplode("d").alias("index", "value")).select("vec_id", F.col("index").cast("long").alias("index"), "value")


# Search.
SEARCHES = ["+the +that -of", "+la +(de que)", "und", '"in the"', "+nothing_has_this"]
WORDS = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
HITS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
h AS (
SELECT 0 AS query_index, doc_id FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'that') AND NOT list_contains(w, 'of')
UNION ALL SELECT 1, doc_id FROM d WHERE list_contains(w, 'la') AND (list_contains(w, 'de') OR list_contains(w, 'que'))
UNION ALL SELECT 2, doc_id FROM d WHERE list_contains(w, 'und')
UNION ALL SELECT 3, doc_id FROM d WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' in the '))
"""


@query(HITS + "SELECT query_index, doc_id, n_chars FROM h JOIN documents USING (doc_id)")
def search_collect(spark, table):
    docs = table("documents")
    return search.collect_all(search.index(docs, "text", "doc_id"), docs.select("doc_id", "n_chars"), SEARCHES, "doc_id")


@query(HITS + "SELECT CAST(q.range AS INTEGER) AS query_index, count(doc_id) AS hits FROM range(0, 5) q LEFT JOIN h ON h.query_index = q.range GROUP BY 1")
def search_count(spark, table):
    return search.count_hits(search.index(table("documents"), "text", "doc_id"), SEARCHES, "doc_id")


@query(HITS + "SELECT CAST(q.range AS INTEGER) AS query_index, count(doc_id) AS hits FROM range(0, 5) q LEFT JOIN h ON h.query_index = q.range GROUP BY 1")
def search_merged(spark, table):
    """The same counts from two stored indexes that were merged."""
    at = [new_path(spark, "index") for _ in range(3)]
    docs = table("documents")
    for path, part in zip(at, (docs.where("lang = 'en'"), docs.where("lang <> 'en' OR lang IS NULL"))):
        search.write_index(search.index(part, "text", "doc_id"), path)
    search.merge_indexes(spark, at[:2], at[2])
    return search.count_hits(spark.read.parquet(at[2]), SEARCHES, "doc_id")


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({WORDS}) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def search_top_terms(spark, table):
    return search.ranked_terms(search.index(table("documents"), "text", "doc_id"), 20)


# Inflection and casts.
@query(r"SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_name, ' ', 'X'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g')) AS word FROM part")
def inflect_underscore(spark, table):
    return table("part").select("p_partkey", inflect.underscore(F.replace("p_name", F.lit(" "), F.lit("X"))).alias("word"))


@query("SELECT n_nationkey, upper(substring(n_name, 1, 1)) || lower(substring(replace(n_name, '_', 'x'), 2)) || 'Name' AS word, lower(replace(n_name, '_', 'x')) || 'Name' AS lower_word FROM nation")
def inflect_camelize(spark, table):
    word = F.concat(F.translate(F.lower("n_name"), "_", "x"), F.lit("_name"))
    return table("nation").select("n_nationkey", inflect.camelize(word).alias("word"), inflect.camelize(word, True).alias("lower_word"))


@query("SELECT r_regionkey, CASE WHEN regexp_matches(lower(r_name), '[^aeiouy]y$') THEN regexp_replace(r_name, '[yY]$', 'ies') WHEN regexp_matches(lower(r_name), 's$') THEN r_name ELSE r_name || 's' END AS word FROM region")
def inflect_pluralize(spark, table):
    return table("region").select("r_regionkey", inflect.pluralize("r_name").alias("word"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 100 IN (11, 12, 13) THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS word FROM part")
def inflect_ordinalize(spark, table):
    return table("part").select("p_partkey", inflect.ordinalize("p_size").alias("word"))


@query("SELECT o_orderkey, CAST(((o_orderkey * 1000003 + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS narrow FROM orders")
def int_narrow(spark, table):
    return table("orders").select("o_orderkey", casts.wrapped_int(F.col("o_orderkey") * 1000003).alias("narrow"))


@query("SELECT doc_id, to_base64(encode(text)) AS b64, text AS back FROM documents")
def base64_roundtrip(spark, table):
    rows = table("documents").select("doc_id", text.base64_line(F.encode("text", "utf-8")).alias("b64"))
    return rows.select("doc_id", "b64", F.expr("CAST(try_to_binary(b64, 'base64') AS STRING)").alias("back"))


# Records.
CUSTOMER_PROTO = """
message Customer {
  required int64 c_custkey = 1;
  optional string c_name = 2;
  optional int32 c_nationkey = 3;
  optional double c_acctbal = 4;
  optional string c_mktsegment = 5;
}
"""
CUSTOMER_THRIFT = """
struct Customer { 1: required i64 c_custkey, 2: string c_name, 3: i32 c_nationkey, 4: double c_acctbal, 5: string c_mktsegment }
"""
CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def customer_codec(kind: str, **options):
    return proto_codec.Codec(proto_codec.parse(CUSTOMER_PROTO), "Customer", **options) if kind == "proto" else thrift_codec.Codec(thrift_codec.parse(CUSTOMER_THRIFT), "Customer", **options)


def roundtrip(spark, table, kind: str, layout: str, compression: str = "none") -> DataFrame:
    at = new_path(spark, f"{kind}-{layout}")
    records.write_records(table("customer"), at, customer_codec(kind), layout, "Customer", compression=compression)
    return records.read_records(spark, at, customer_codec(kind), layout)


@query(CUSTOMERS)
def proto_block_roundtrip(spark, table):
    return roundtrip(spark, table, "proto", "block")


@query(CUSTOMERS)
def proto_b64_roundtrip(spark, table):
    return roundtrip(spark, table, "proto", "b64line", "bzip2")


@query(CUSTOMERS)
def thrift_block_roundtrip(spark, table):
    return roundtrip(spark, table, "thrift", "block", "gzip")


@query(CUSTOMERS)
def thrift_b64_roundtrip(spark, table):
    return roundtrip(spark, table, "thrift", "b64line")


@query(CUSTOMERS)
def multi_format_scan(spark, table):
    """One scan over block files and base64 files; each is told by its beginning."""
    at, codec, customers = new_path(spark, "multi"), customer_codec("thrift"), table("customer")
    records.write_records(customers.where("c_custkey % 2 = 0"), f"{at}/a", codec, "block", "Customer")
    records.write_records(customers.where("c_custkey % 2 = 1"), f"{at}/b", codec, "b64line")
    return records.read_records(spark, at, codec, "auto")


@query("SELECT count(*) AS n, CAST(sum(octet_length(encode(c_name))) AS BIGINT) AS name_bytes FROM customer")
def raw_records(spark, table):
    at = new_path(spark, "raw")
    records.write_records(table("customer").select(F.col("c_name").cast("binary")), at, records.Raw())
    return records.read_records(spark, at, records.Raw()).agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("name_bytes"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def projection_pushdown(spark, table):
    """Fields that aren't asked for are skipped in the records, not decoded."""
    at = new_path(spark, "projection")
    records.write_records(table("customer"), at, customer_codec("thrift"))
    return records.read_records(spark, at, customer_codec("thrift", columns=["c_custkey", "c_acctbal"]))


@query(CUSTOMERS + " WHERE c_custkey % 10 <> 0")
def bad_record_tolerance(spark, table):
    """Every tenth record is cut to three quarters, and is bad; empty ones stand among them, and the decoder skips those."""
    codec = customer_codec("thrift")
    whole = records.encoded(table("customer"), codec)
    key = F.conv(F.hex(F.expr("substring(record, 4, 8)")), 16, 10).cast("long")
    cut = whole.select(F.when(key % 10 == 0, F.expr("substring(record, 1, CAST(octet_length(record) * 3 / 4 AS INT))")).otherwise(F.col("record")).alias("framed"))
    framed = cut.union(spark.range(500).select(F.lit("").cast("binary")))
    return records.decoded(framed.select("framed", F.lit(False).alias("is_block")), codec, threshold=0.5)


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0")
def hardened_thrift_decode(spark, table):
    """Every seventh record states a string of 2 GB: a bad record, not memory asked for."""
    codec = customer_codec("thrift")
    whole = records.encoded(table("customer"), codec)
    key = F.conv(F.hex(F.expr("substring(record, 4, 8)")), 16, 10).cast("long")
    huge = F.expr("overlay(record PLACING X'7FFFFFFF' FROM 15 FOR 4)")
    framed = whole.select(F.when(key % 7 == 0, huge).otherwise(F.col("record")).alias("framed"), F.lit(False).alias("is_block"))
    return records.decoded(framed, codec, threshold=0.5).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0")
def proto_bad_utf8_tolerance(spark, table):
    """Every seventh name isn't UTF-8: a bad record."""
    raw = proto_codec.Codec(proto_codec.parse(CUSTOMER_PROTO.replace("string c_name", "bytes c_name")), "Customer")
    rows = table("customer").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, F.unhex(F.lit("FF41"))).otherwise(F.col("c_name").cast("binary")))
    framed = records.encoded(rows, raw).select(F.col("record").alias("framed"), F.lit(False).alias("is_block"))
    return records.decoded(framed, customer_codec("proto"), threshold=0.5).select("c_custkey")


PRIORITY = "enum Priority { URGENT = 1, HIGH, MEDIUM, NOT_SPECIFIED, LOW } struct Order { 1: i64 o_orderkey, 2: Priority priority }"


def orders_with_enum(spark, table, as_int: bool) -> DataFrame:
    codec = thrift_codec.Codec(thrift_codec.parse(PRIORITY), "Order", enum_as_int=as_int)
    label = F.regexp_replace(F.regexp_replace("o_orderpriority", r"^\d-", ""), " ", "_")
    framed = records.encoded(table("orders").select("o_orderkey", label.alias("priority")), codec)
    return records.decoded(framed.select(F.col("record").alias("framed"), F.lit(False).alias("is_block")), codec)


@query("SELECT o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders")
def enum_as_int(spark, table):
    return orders_with_enum(spark, table, True)


@query("SELECT o_orderkey, replace(substring(o_orderpriority, 3), ' ', '_') AS priority FROM orders")
def enum_as_name(spark, table):
    return orders_with_enum(spark, table, False)


@query("SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def dynamic_proto_map_entries(spark, table):
    """A map as repeated entry messages, encoded and decoded."""
    codec = proto_codec.Codec(proto_codec.parse("message Event { optional int64 event_id = 1; message Entry { required string key = 1; required string value = 2; } repeated Entry props = 2; }"), "Event")
    rows = table("events").select("event_id", F.map_entries(text.json_map("props")).alias("props"))
    framed = records.encoded(rows, codec).select(F.col("record").alias("framed"), F.lit(False).alias("is_block"))
    return records.decoded(framed, codec).select("event_id", F.explode("props").alias("e")).select("event_id", "e.key", "e.value")


@query("SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_regionkey <> 2")
def sequencefile_roundtrip(spark, table):
    """Pairs with a null in either half are left out."""
    at = new_path(spark, "sequence")
    kv.write_pairs(table("nation").select("n_nationkey", F.when(F.col("n_regionkey") != 2, F.col("n_name"))), at)
    return kv.read_pairs(spark, at, "IntWritable", "Text")


@query("SELECT n_nationkey, nullif(n_name, 'FRANCE') AS n_name, n_regionkey FROM nation")
def columnar_roundtrip(spark, table):
    at, nation = new_path(spark, "columns"), table("nation")
    columnar.write_columns(nation.withColumn("n_name", F.nullif(F.col("n_name"), F.lit("FRANCE"))), at, {"n_nationkey": 1, "n_name": 2, "n_regionkey": 3})
    return columnar.read_columns(spark, at, nation.schema, {"n_nationkey": 1, "n_name": 2, "n_regionkey": 3})


@query("SELECT n_name AS label, n_nationkey AS id, CAST(NULL AS VARCHAR) AS later FROM nation WHERE n_regionkey = 1")
def columnar_evolution(spark, table):
    """Columns found by field id under other names and in another order; one that older files lack is null."""
    at = new_path(spark, "evolution")
    columnar.write_columns(table("nation"), at, {"n_nationkey": 1, "n_name": 2, "n_regionkey": 3})
    wider = T.StructType([T.StructField("label", T.StringType()), T.StructField("region", T.IntegerType()), T.StructField("id", T.IntegerType()), T.StructField("later", T.StringType())])
    return columnar.read_columns(spark, at, wider, {"id": 1, "label": 2, "region": 3, "later": 9}).where("region = 1").select("label", "id", "later")


@query("SELECT n_nationkey, nullif(n_name, 'FRANCE') AS n_name FROM nation")
def rcfile_roundtrip(spark, table):
    """Two of three columns; an empty cell is a null."""
    at = new_path(spark, "rcfile")
    rcfile.write_columns(table("nation").withColumn("n_name", F.nullif(F.col("n_name"), F.lit("FRANCE"))), at, "org.apache.hadoop.io.compress.DefaultCodec")
    cells = rcfile.read_columns(spark, at, [0, 1])
    return cells.select(F.col("c0").cast("string").cast("int").alias("n_nationkey"), F.col("c1").cast("string").alias("n_name"))


@query(CUSTOMERS)
def rcfile_records(spark, table):
    at = new_path(spark, "rcfile-records")
    rcfile.write_records(table("customer"), at, customer_codec("thrift"), "org.apache.hadoop.io.compress.GzipCodec")
    return rcfile.read_records(spark, at, customer_codec("thrift"))


@query("SELECT c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS later FROM customer")
def rcfile_evolution(spark, table):
    """Read with another struct: fields by id, one of them not written yet."""
    at = new_path(spark, "rcfile-evolution")
    rcfile.write_records(table("customer"), at, customer_codec("thrift"))
    later = thrift_codec.Codec(thrift_codec.parse("struct Later { 4: double c_acctbal, 9: string later, 1: i64 c_custkey }"), "Later")
    return rcfile.read_records(spark, at, later).select("c_custkey", "c_acctbal", "later")


@query(CUSTOMERS)
def thrift_to_proto(spark, table):
    """Structs written as the messages that their schema converts to, and read as those."""
    schema = thrift_codec.parse(CUSTOMER_THRIFT)
    codec = proto_codec.Codec(cross_idl.message_file(schema, "Customer"), "Customer")
    at = new_path(spark, "converted")
    records.write_records(table("customer"), at, codec, "block", "Customer")
    return records.read_records(spark, at, codec)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def loader_view(spark, table):
    """Records behind a view, for SQL."""
    at = new_path(spark, "loader")
    records.write_records(table("customer"), at, customer_codec("proto"), "b64line")
    loaders.register(spark, "stored_customers", at, CUSTOMER_PROTO, "Customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM stored_customers GROUP BY 1")


@query("SELECT n_nationkey AS key FROM nation")
def sequencefile_raw(spark, table):
    """Keys as the bytes that were written."""
    at = new_path(spark, "sequence-raw")
    kv.write_pairs(table("nation").select("n_nationkey", "n_name"), at)
    return kv.read_raw_pairs(spark, at).select(F.conv(F.hex("key"), 16, 10).cast("int").alias("key"))


@query("SELECT r_regionkey, CAST(length(r_name) AS INTEGER) AS size, replace(r_name, 'A', '*') AS starred FROM region")
def reflect_invoke(spark, table):
    size = invoke.invoke_python("builtins.len", F.col("r_name"), returns="int", spark=spark)
    return table("region").select("r_regionkey", size.alias("size"), invoke.invoke_instance("str.replace", F.col("r_name"), F.lit("A"), F.lit("*")).alias("starred"))


@query("SELECT o_orderkey, CAST(abs(o_custkey - 500) AS BIGINT) AS far FROM orders")
def java_invoke(spark, table):
    return table("orders").select("o_orderkey", invoke.invoke_static("java.lang.Math.abs", F.col("o_custkey") - 500, returns="long").alias("far"))


# Protocol Buffers of the third syntax.
PROTO3 = """
syntax = "proto3"; package shop;
enum Size { UNKNOWN = 0; SMALL = 1; LARGE = 2; }
message Part {
  int64 p_partkey = 1; string p_name = 2; Size size = 3; reserved 4;
  oneof price { double p_retailprice = 5; string on_request = 6; }
  map<string, int64> counts = 7;
}
"""


def part_codec() -> proto_codec.Codec:
    return proto_codec.Codec(proto_codec.parse(PROTO3), "Part")


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN 'LARGE' ELSE 'SMALL' END AS size, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_retailprice END AS p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN 'ask' ELSE '' END AS on_request FROM part")
def proto3_roundtrip(spark, table):
    """Fields without labels, an enum and a oneof of which one member is set."""
    at, ask = new_path(spark, "proto3"), F.col("p_partkey") % 3 == 0
    rows = table("part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, "LARGE").otherwise("SMALL").alias("size"), F.when(~ask, F.col("p_retailprice")).alias("p_retailprice"), F.when(ask, "ask").alias("on_request"))
    records.write_records(rows, at, part_codec())
    return records.read_records(spark, at, part_codec()).drop("counts")


@query("SELECT p_partkey, 'size' AS key, CAST(p_size AS BIGINT) AS value FROM part UNION ALL SELECT p_partkey, p_name, p_partkey * 2 FROM part")
def proto_map_roundtrip(spark, table):
    at = new_path(spark, "proto-map")
    maps = F.create_map(F.lit("size"), F.col("p_size").cast("long"), F.col("p_name"), F.col("p_partkey").cast("long") * 2)
    rows = table("part").select("p_partkey", *[F.lit(None).cast(t).alias(n) for n, t in (("p_name", "string"), ("size", "string"), ("p_retailprice", "double"), ("on_request", "string"))], maps.alias("counts"))
    records.write_records(rows, at, part_codec())
    return records.read_records(spark, at, part_codec()).select("p_partkey", F.explode("counts").alias("key", "value"))


@query("SELECT 'Customer' AS class_name, count(*) AS n, min(c_custkey) AS least, max(c_custkey) AS most FROM customer UNION ALL SELECT 'Part', count(*), min(p_partkey), max(p_partkey) FROM part")
def named_blocks(spark, table):
    """Blocks of two classes in one folder, told apart by the name in the blocks and decoded each by its own codec."""
    at = new_path(spark, "named")
    records.write_records(table("customer"), f"{at}/a", customer_codec("proto"), class_name="Customer")
    records.write_records(table("part").select("p_partkey", "p_name"), f"{at}/b", part_codec(), class_name="Part")
    found = records.named_records(spark, at)
    parts = []
    for name, key, codec in (("Customer", "c_custkey", customer_codec("proto", columns=["c_custkey"])), ("Part", "p_partkey", part_codec())):
        own = found.where(F.col("class_name") == name).select(F.col("record").alias("framed"), F.lit(False).alias("is_block"))
        parts.append(records.decoded(own, codec).agg(F.lit(name).alias("class_name"), F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most")))
    return parts[0].union(parts[1])


@query("SELECT c_custkey, c_acctbal FROM customer")
def loader_columns(spark, table):
    """A Thrift struct's text in place of a codec; columns in the order asked for."""
    at = new_path(spark, "loader-columns")
    records.write_records(table("customer"), at, customer_codec("thrift"))
    return loaders.load(spark, at, CUSTOMER_THRIFT, "Customer", columns=["c_acctbal", "c_custkey"])


# Words.
WORDS = ["cats", "com.x.PersonAddresses", "boxes", "order_ids", "Max_uptime"]


def fixed_words(spark, table) -> DataFrame:
    return table("region").select("r_regionkey", F.element_at(F.array(*map(F.lit, WORDS)), F.col("r_regionkey") + 1).alias("word"))


def as_sql(**columns: list[str]) -> str:
    return "SELECT r_regionkey, " + ", ".join(f"({v})[r_regionkey + 1] AS {k}" for k, v in columns.items()) + " FROM region"


@query(as_sql(singular=["cat", "com.x.PersonAddress", "box", "order_id", "Max_uptime"], bare=["cats", "PersonAddresses", "boxes", "order_ids", "Max_uptime"], dashed=["cats", "com.x.PersonAddresses", "boxes", "order-ids", "Max-uptime"]))
def inflect_singularize(spark, table):
    return fixed_words(spark, table).select("r_regionkey", inflect.singularize("word").alias("singular"), inflect.depackage("word").alias("bare"), inflect.dasherize("word").alias("dashed"))


@query(as_sql(foreign=["cats_id", "person_addresses_id", "boxes_id", "order_ids_id", "max_uptime_id"], joined=["catsid", "person_addressesid", "boxesid", "order_idsid", "max_uptimeid"], cls=["Cat", "PersonAddress", "Box", "OrderId", "MaxUptime"]))
def inflect_keys_and_classes(spark, table):
    w = fixed_words(spark, table)
    return w.select("r_regionkey", inflect.foreign_key("word").alias("foreign"), inflect.foreign_key("word", False).alias("joined"), inflect.classify("word").alias("cls"))


@query("SELECT n_nationkey, upper(substring(n_name, 1, 1)) || lower(substring(n_name, 2)) AS capital, upper(substring(n_name, 1, 1)) || lower(substring(n_name, 2)) || ' key' AS human, upper(substring(n_name, 1, 1)) || lower(substring(n_name, 2)) || ' Key' AS title, lower(n_name) || '_keys' AS tbl FROM nation WHERE NOT contains(n_name, ' ') AND NOT contains(n_name, '_')")
def inflect_titles(spark, table):
    rows = table("nation").where("NOT contains(n_name, ' ') AND NOT contains(n_name, '_')").withColumn("w", F.concat(F.lower("n_name"), F.lit("_key")))
    return rows.select("n_nationkey", inflect.capitalize("n_name").alias("capital"), inflect.humanize("w").alias("human"), inflect.titleize("w").alias("title"), inflect.tableize("w").alias("tbl"))


# Casts.
@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CASE WHEN l_extendedprice * 100000 >= 2147483647 THEN 2147483647 ELSE CAST(trunc(l_extendedprice * 100000) AS INTEGER) END AS held, CAST(l_quantity AS VARCHAR) = CAST(l_quantity AS VARCHAR) AS same FROM lineitem")
def casts_saturate(spark, table):
    price = F.col("l_extendedprice").cast("double")
    return table("lineitem").select("l_orderkey", "l_linenumber", casts.float_to_long(price).alias("whole"), casts.float_to_int(price * 100000).alias("held"), (casts.as_text("l_quantity") == F.col("l_quantity").cast("string")).alias("same"))


@query("SELECT o_orderkey, o_clerk_size AS size, back FROM (SELECT o_orderkey, strlen(o_orderpriority) AS o_clerk_size, o_orderpriority AS back FROM orders)")
def casts_sized_bytes(spark, table):
    """Bytes behind their length; one byte too many makes it no such value."""
    body = F.col("o_orderpriority").cast("binary")
    framed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), body)
    rows = table("orders").select("o_orderkey", F.octet_length(casts.sized_bytes(framed)).cast("long").alias("size"), casts.sized_bytes(framed).cast("string").alias("back"), casts.sized_bytes(F.concat(framed, body)).alias("none"))
    return rows.where("none IS NULL").drop("none")


@query("SELECT o_orderkey, TRY_CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS number, TRY_CAST(o_orderpriority AS INTEGER) AS bad FROM orders")
def casts_parse(spark, table):
    return table("orders").select("o_orderkey", casts.parsed(F.substring("o_orderpriority", 1, 1), "int", False).alias("number"), casts.parsed("o_orderpriority", "int", False).alias("bad"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_nested_group(spark, table):
    """Grouped by a property within a property."""
    wrapped = table("events").select(F.concat(F.lit('{"outer": '), F.col("props"), F.lit("}")).alias("line"))
    return wrapped.select(text.json_nested("line").alias("v")).groupBy(F.expr("try_variant_get(v, '$.outer.k', 'string')").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type = 'click') AS clicks FROM events")
def counters(spark, table):
    """Counted as a side result of the rows' own way to a table."""
    rows, seen = side_counters.counted(table("events"), "Events", n=F.lit(True), high=F.col("value") > 50, clicks=F.col("event_type") == "click")
    rows.write.parquet(new_path(spark, "counted"))
    return spark.createDataFrame([tuple(seen.get[k] for k in ("n", "high", "clicks"))], "n long, high long, clicks long")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def stream_json_counts(spark, table):
    """A stream of files through the JSON parser, counted as it comes, until all files are read."""
    at, name = new_path(spark, "stream"), f"counts_{uuid.uuid4().hex[:8]}"
    table("events").select("props").repartition(3).write.text(at)
    counts = lines.stream_json(spark, at, 1).select(F.col("json")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("SELECT c_custkey, c_name FROM customer")
def text_pairs(spark, table):
    """Lines of key, tab and value."""
    at = new_path(spark, "pairs")
    text.write_pairs_text(table("customer").select("c_custkey", "c_name"), at)
    parts = F.split("value", "\t")
    return spark.read.text(at).select(parts[0].cast("long").alias("c_custkey"), parts[1].alias("c_name"))
