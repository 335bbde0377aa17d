import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespark.operators import counters, relational, search
from wirespark.plans import inspect
from wirespark.sources import columnar, kv
from wirespark.storage import new_path
from wirespark.streaming import lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(1, "the shield of achilles"), (2, "to dusty death. macbeth"), (3, "a shield a shield"), (4, "dusty  death"), (5, None)]
    return spark.createDataFrame(rows, "doc long, text string")


def hits(shelf, q):
    return sorted(r.doc for r in search.search(search.index(shelf, "text", "doc"), [q], "doc").collect())


def test_queries(shelf):
    assert hits(shelf, "+(macbeth achilles)") == [1, 2]
    assert hits(shelf, "+macbeth +achilles") == []
    assert hits(shelf, "+shield") == [1, 3]
    assert hits(shelf, "+dusty +death.") == [2]
    assert hits(shelf, "shield -achilles") == [3]
    assert hits(shelf, "dusty shield") == [1, 2, 3, 4]
    assert hits(shelf, '"dusty death"') == [4]
    assert hits(shelf, '+("a shield" macbeth)') == [2, 3]
    assert hits(shelf, "-shield") == [] and hits(shelf, "") == []
    assert search.query_lines("+hello -goodbye\n+test\n\n +こにちは ") == ["+hello -goodbye", "+test", "+こにちは"]


def test_counts_and_merge(spark, shelf):
    at = [new_path(spark, "test-index") for _ in range(3)]
    for a, p in zip(at, (shelf.where("doc < 3"), shelf.where("doc >= 3"))):
        search.write_index(search.index(p, "text", "doc"), a)
    search.merge_indexes(spark, at[:2], at[2])
    got = search.count_hits(spark.read.parquet(at[2]), ["+shield", "+none", "dusty"], "doc").orderBy("query_index").collect()
    assert [tuple(r) for r in got] == [(0, 2), (1, 0), (2, 2)]
    assert search.collect_all(spark.read.parquet(at[2]), shelf, ["+shield"], "doc").count() == 2


def brute(texts, q):
    """Documents that a query finds, by scanning each one's words."""
    out = []
    for doc, text in texts:
        words = text.split()
        has = lambda clause: any(list(o) == words[i : i + len(o)] for o in clause.options for i in range(len(words)))  # noqa: B023, E731
        by = {sign: [has(c) for c in search.parse_query(q) if c.sign == sign] for sign in ("+", "-", "")}
        if not any(by["-"]) and (all(by["+"]) if by["+"] else any(by[""])):
            out.append(doc)
    return out


def test_search_equals_brute_force(spark):
    pick = random.Random(7)
    texts = [(i, pick.choice([" ", "\n\t", "\x0b "]).join(pick.choices("abcdef", k=pick.randint(0, 12)))) for i in range(300)]
    queries = ["+a", "+a +b -c", "a b", "a -b", '"a b"', '+"a b c" -"c d"', '+("a b" "b a") +f', '"a a"', "-a", "", "+(a zz) b", "zz", '+a +"b zz"']
    postings = search.index(spark.createDataFrame(texts, "doc long, text string").repartition(3), "text", "doc")
    got = search.search(postings, queries, "doc").collect()
    assert len(got) == len(set(got))
    assert [sorted(r.doc for r in got if r.query_index == q) for q in range(len(queries))] == [brute(texts, x) for x in queries]
    many = search.search(postings, ["+a " + " ".join(f"-z{i}" for i in range(search.FILTER_TERMS)), "b"], "doc").collect()
    assert sorted(map(tuple, many)) == [(0, d) for d in brute(texts, "a")] + [(1, d) for d in brute(texts, "b")]


def test_terms_are_split_as_spark_splits(spark):
    odd = " a\x0bb\u00a0c\x1cd\x85e\u2028f\u3000g\r\fé  \U0001f600 "
    docs = spark.createDataFrame([("x", odd), (None, "h"), ("y", None), ("z", ""), ("z", "h")], "name string, text string").coalesce(1)
    rows = search.index(docs, "text", "name").collect()
    want = docs.select(F.explode(F.split("text", r"\s+")).alias("t")).where("t <> ''").distinct().collect()
    assert sorted(r.term for r in rows if r.term) == sorted(r.t for r in want)
    assert [r["keys"] for r in rows if r.term is None] == [["x", None, "y", "z", "z"]]
    assert [(r.docs, r.places) for r in rows if r.term == "h"] == [([1, 4], [0, 0])]


def test_segments_hold_every_document_once(monkeypatch):
    monkeypatch.setattr(search, "SEGMENT_BYTES", 10)
    monkeypatch.setattr(search, "SEGMENT_DOCS", 4)
    texts = ["abc", "", None, "x" * 50, "de f", "ghij", "k", "lm", "", "", "", "", "", "é" * 5, "n"]
    for step in (1, 2, 4, 15):
        batches = [pa.record_batch({"text": pa.array(texts[i : i + step], pa.string()), "key": pa.array(range(i, min(i + step, 15)))}) for i in range(0, 15, step)]
        got = [*search.segments(iter(batches))]
        assert [k for _, keys in got for k in keys.to_pylist()] == [*range(15)]
        assert [x for t, _ in got for x in t.to_pylist()] == [(x or "").encode() for x in texts]
        assert all(0 < len(t) <= 4 and (len(t) == 1 or sum(map(len, t.to_pylist())) <= 10) for t, _ in got)


def test_index_has_a_row_for_each_term_of_a_segment(spark):
    # Before, a row for each occurrence: merging two indexes wrote, dealt and sorted all of them twice.
    docs = spark.range(0, 600, 1, 2).select(F.col("id").alias("doc"), F.repeat(F.lit("a b c d e "), 50).alias("text"))
    at = [new_path(spark, "test-index") for _ in range(3)]
    for a, p in zip(at, (docs.where("doc < 300"), docs.where("doc >= 300"))):
        search.write_index(search.index(p, "text", "doc"), a)
    search.merge_indexes(spark, at[:2], at[2])
    merged = spark.read.parquet(at[2])
    assert merged.count() <= 4 * 6 and search.ranked_terms(merged, 1).first().n == 600 * 50
    got = search.search(merged, ['"e a b" +c', "d -a"], "doc")
    assert any("term" in f and "In" in f for f in inspect.pushed_filters(got))
    assert sorted(map(tuple, got.collect())) == [(0, d) for d in range(600)]


def test_hits_are_collected_without_dealing_occurrences(spark, shelf):
    # Before, each occurrence was dealt and hashed by its place, then again by document.
    got = search.collect_all(search.index(shelf, "text", "doc"), shelf, ['"dusty death"', "shield"], "doc")
    assert inspect.shuffles(search.search(search.index(shelf, "text", "doc"), ["shield"], "doc")) == 2
    assert "start" not in inspect.text(got) and "Generate" not in inspect.text(got)
    assert sorted(map(tuple, got.collect())) == [(0, 4, "dusty  death"), (1, 1, "the shield of achilles"), (1, 3, "a shield a shield")]


def test_counting_hits_deals_segments_and_hits_only(spark):
    # Before, the occurrences of the queries' terms were dealt, by their places.
    docs = spark.range(0, 50, 1, 2).select(F.col("id").alias("doc"), F.when(F.col("id") % 5 > 0, F.repeat(F.lit("in the "), 2000)).alias("text"))
    got = search.count_hits(search.index(docs, "text", "doc"), ['"in the"', '"the the"', "+in -the", "the"], "doc")
    deals = inspect.text(got).count("Exchange hashpartitioning(")
    keys = [x for x in ("segment", "query_index") if f"Exchange hashpartitioning({x}#" in inspect.text(got)]
    assert keys == ["segment", "query_index"] and deals <= 4 and "start" not in inspect.text(got)
    assert sorted(map(tuple, got.collect())) == [(0, 40), (1, 0), (2, 0), (3, 40)]


def test_relational(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "x string, y int")
    book = spark.createDataFrame([("a", 1), (None, 2), ("a", 1), ("b", 4)], "x string, y int")
    assert sorted(map(str, relational.present_in(df, book).collect())) == sorted(map(str, df.where("y < 3").collect()))
    words = relational.word_count(spark.createDataFrame([(" a b\ta ",), (None,), ("",)], "t string"), "t")
    assert dict(words.collect()) == {"a": 2, "b": 1}
    maps = spark.sql("SELECT map('k', '1', 'j', 'x') AS m UNION ALL SELECT map('k', '2')")
    assert dict(relational.map_sums(maps, "m", strict=False).collect()) == {"k": 3, "j": None}
    with pytest.raises(Exception):
        relational.map_sums(maps, "m").collect()
    raw = spark.createDataFrame([(bytearray(b),) for b in (b"\x01\x02", b"\xff", b"\x01", b"\x80\x00", b"")], "b binary")
    assert [bytes(r.b) for r in raw.orderBy(*relational.length_first("b")).collect()] == [b"", b"\xff", b"\x01", b"\x80\x00", b"\x01\x02"]
    assert [bytes(r.b) for r in raw.orderBy(relational.byte_order("b")).collect()] == [b"", b"\x01", b"\x01\x02", b"\x80\x00", b"\xff"]


def test_counters(spark):
    df, seen = counters.counted(spark.range(10), "lines", even=F.col("id") % 2 == 0, large=F.col("id") > 7)
    assert df.count() == 10 and seen.get == {"even": 5, "large": 2}


def test_pairs(spark):
    at = new_path(spark, "test-pairs")
    df = spark.createDataFrame([(0, "one, two"), (1, None), (None, "x"), (2, "five, six")], "k int, v string")
    kv.write_pairs(df, at, "org.apache.hadoop.io.compress.GzipCodec")
    assert sorted(map(tuple, kv.read_pairs(spark, at, "IntWritable").collect())) == [(0, "one, two"), (2, "five, six")]
    assert kv.read_pairs(spark, at, "IntWritable", columns=["value"]).columns == ["value"]
    with pytest.raises(ValueError):
        kv.read_pairs(spark, at, columns=["other"])
    with pytest.raises(ValueError):
        kv.write_pairs(spark.range(1), at)
    raw = new_path(spark, "test-pairs")
    kv.write_pairs(spark.createDataFrame([(bytearray(b"\x00k"), bytearray(b"v"))], "k binary, v binary"), raw)
    assert [bytes(x) for x in kv.read_pairs(spark, raw, "BytesWritable", "BytesWritable").first()] == [b"\x00k", b"v"]


def test_columns_by_id(spark):
    at = new_path(spark, "test-columns")
    columnar.write_columns(spark.createDataFrame([(1, "a", 2.5)], "x int, y string, z double"), at, {"x": 10, "y": 20, "z": 30})
    schema = T.StructType([T.StructField("z2", T.DoubleType()), T.StructField("w", T.StringType()), T.StructField("x2", T.IntegerType())])
    got = columnar.read_columns(spark, at, schema, {"z2": 30, "w": 40, "x2": 10})
    assert tuple(got.first()) == (2.5, None, 1)
    assert inspect.read_columns(got.select("x2")) == {"x2"}
    with pytest.raises(ValueError):
        columnar.write_columns(spark.range(1), at, {})


def test_plans_push_down(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    df = events.where("event_type = 'view'").select("user_id")
    assert inspect.read_columns(df) == {"event_type", "user_id"}
    assert any("event_type" in f for f in inspect.pushed_filters(df))
    assert inspect.shuffles(df) == 0 and inspect.python_nodes(df) == []


def test_streams(spark):
    at = new_path(spark, "test-stream")
    rows = spark.read.parquet(f"{SF}/events.parquet").select(F.to_json(F.struct("ts", "event_type")).alias("value"))
    rows.union(spark.createDataFrame([("noise",)], "value string")).write.text(at)
    parsed = lines.stream_json(spark, at).select(F.col("json")["ts"].cast("timestamp").alias("ts"), F.col("json")["event_type"].alias("kind"))
    q = lines.windowed_counts(parsed, "ts", "kind", "1 day", "1 day").writeStream.format("memory").queryName("seen").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM seen").first()[0] == 1000
    found = lines.stream_regex(spark, at, '"event_type":"(\\w+)"', ["kind"]).writeStream.format("memory").queryName("kinds").start()
    found.processAllAvailable()
    found.stop()
    assert spark.sql("SELECT count(*) FROM kinds").first()[0] == 1000
