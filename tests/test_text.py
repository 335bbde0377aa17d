import pytest
from pyspark.sql import functions as F

from wirespark.plans import inspect
from wirespark.sources import text
from wirespark.storage import new_path


def lines(spark, *rows):
    at = new_path(spark, "test-text")
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(at)
    return at


def test_delimiters():
    assert [text.delimiter(x) for x in ("|", "\t", "\\t", "\\x44", "\\u0059")] == ["|", "\t", "\t", ",", ";"]
    for bad in ("", "ab", "\\n", "\\x", "\\xzz"):
        with pytest.raises(ValueError):
            text.delimiter(bad)


def test_json_loader(spark):
    at = lines(spark, '{"score":10}', '{"score":20}', '{"score":30}', "null", "[1]", "{", "", '{"big":12345678901234567890}', '{"a":{"b":{"c":0}},"n":null}')
    got = text.read_json(spark, at)
    assert got.agg(F.sum(F.col("json")["score"].cast("long"))).first()[0] == 60
    assert got.count() == 4 and text.read_json(spark, at, strict_numbers=False).count() == 5
    last = got.where(F.map_contains_key("json", F.lit("a"))).select(F.col("json")["a"], F.col("json")["n"]).first()
    assert last == ('{"b":{"c":0}}', None)
    empty = text.read_json(spark, at, null_as_empty=True)
    assert empty.where("json['n'] = ''").count() == 1


def test_nested_json(spark):
    at = lines(spark, '{"entities":{"hashtags":[{"text":"test1"},{"text":"test2"}]}}', "null", "[]", "3")
    got = text.read_json(spark, at, nested=True)
    tags = got.select(F.explode(F.expr("variant_get(json, '$.entities.hashtags', 'array<struct<text string>>')")).alias("t")).select("t.text")
    assert [r[0] for r in tags.collect()] == ["test1", "test2"] and got.count() == 1


def test_json_store(spark):
    at = new_path(spark, "test-json")
    df = spark.sql("SELECT map('a', '1', 'b', CAST(NULL AS STRING), 'c', '3') AS m UNION ALL SELECT map('x', '1')")
    text.write_json(df, "m", at, ["a", "b"])
    assert sorted(r[0] for r in spark.read.text(at).collect()) == ['{"a":"1","b":null}', "{}"]


def test_regex(spark):
    at = lines(spark, "GET /a 200", "noise", "xx GET /b", "POST /c 500")
    got = text.read_regex(spark, at, "(GET|POST) (\\\\S+)( \\\\d+)?", ["verb", "path", "code"]).orderBy("path").collect()
    assert [tuple(r) for r in got] == [("GET", "/a", " 200"), ("GET", "/b", ""), ("POST", "/c", " 500")]


def test_w3c(spark):
    known = text.w3c_definitions(spark, lines(spark, "77 date time uri", "", "88 uri"))
    at = lines(spark, "77 d t u", "77\td  t\tu2 ", "77 d t", "99 d t u", "88 v", "")
    got = text.parse_w3c(spark.read.text(at), known).select(F.col("data")["uri"], F.size("data")).orderBy(F.col("data")["uri"]).collect()
    assert [tuple(r) for r in got] == [("u", 3), ("u2", 3), ("v", 1)]


def test_w3c_lines_stay_where_they_are_read(spark, monkeypatch):
    known = spark.createDataFrame([("77", ["crc", "a"]), ("88", ["crc", "a", "b"])], "crc string, names array<string>")
    rows = lambda n: spark.range(n).select(F.concat_ws(" ", F.lit("77"), "id").alias("value"))
    ids = lambda got: got.select(F.col("data")["a"]).distinct().count()
    assert inspect.shuffles(text.parse_w3c(rows(1 << 40), known)) == 0 and ids(text.parse_w3c(rows(1000), known)) == 1000
    monkeypatch.setattr(text, "BROADCAST_DEFINITIONS", 1)
    assert inspect.shuffles(text.parse_w3c(rows(1 << 40), known)) == 2 and ids(text.parse_w3c(rows(1000), known)) == 1000


def test_ranges_and_literals(spark):
    sizes = lambda *a: [len(p) for p in text.integer_range(spark, *a).rdd.glom().collect()]
    assert sizes(-6, 84, 7) == [13] * 7
    assert len(sizes(-6, 83, 7)) == 7 and sum(sizes(-6, 83, 7)) == 90
    assert sizes(1, 5, 6) == [1] * 5
    for bad in ((2, 1, 1), (1, 2, 0)):
        with pytest.raises(ValueError):
            text.integer_range(spark, *bad)
    assert tuple(text.location_tuple(spark, "a,b\tc").first()) == ("a", "b\tc")


def test_lines_and_delimited(spark):
    at = lines(spark, "äbcdef", "xy")
    assert sorted(r[0] for r in text.read_lines(spark, at, 4).collect()) == ["xy", "äbc"]
    out = new_path(spark, "test-delimited")
    df = spark.createDataFrame([(1, 'say "x"', None), (None, "", 2.5)], "a int, b string, c double")
    text.write_delimited(df, out, compression="bzip2")
    got = text.read_delimited(spark, out, "a int, b string, c double").orderBy("c").collect()
    assert [tuple(r) for r in got] == [(1, 'say "x"', None), (None, None, 2.5)]


def test_counts_of_lines(spark):
    from pyspark.sql import Observation

    at = lines(spark, '{"a":1}', "x", "null")
    seen = Observation("json")
    assert text.read_json(spark, at, seen=seen).count() == 1
    assert seen.get == {"LinesRead": 3, "LinesJsonDecoded": 1, "LinesParseError": 2}
    seen = Observation("regex")
    assert text.parse_regex(spark.read.text(at), "value", "(a|u)", ["g"], seen).count() == 2
    assert seen.get == {"Lines": 3, "MatchedRegexLines": 2, "UnmatchedRegexLines": 1}
