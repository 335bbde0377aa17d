import base64
import glob
import random

import pytest
from google.protobuf import descriptor_pb2
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespark.sources import proto_codec, records, thrift_codec
from wirespark.sources.thrift_codec import DecodeError
from wirespark.sources.tolerance import ErrorBudget, TooManyErrors
from wirespark.storage import new_path

PEOPLE = """
enum PhoneType { MOBILE = 0, HOME = 1, WORK = 2 }
struct Name { 1: string first_name, 2: string last_name }
struct Phone { 1: string number, 2: optional PhoneType type = PhoneType.HOME }
struct Person { 1: required Name name, 2: i32 id, 3: string email, 4: list<Phone> phones }
"""
NESTED = """
typedef map<string, i64> Counts   // names to numbers
union Either { 1: i32 number; 2: string text; 3: list<double> values }
exception Wrong { 1: string what }
struct All {
  1: bool flag, 2: byte tiny, 3: i16 small, 4: i32 number, 5: i64 big, 6: double real, 7: string text, 8: binary data,
  9: list<list<i32>> lists, 10: set<string> names, 11: map<i32, list<string>> by_number, 12: Counts counts,
  13: Either either, 14: map<string, Wrong> wrongs, 15: list<map<bool, double>> maps, 16: set<Either> choices
}
"""
ADDRESS = """
package book;
message Person {
  required string name = 1; required int32 id = 2; optional string email = 3;
  enum PhoneType { MOBILE = 0; HOME = 1; WORK = 2; }
  message PhoneNumber { required string number = 1; optional PhoneType type = 2 [default = HOME]; }
  repeated PhoneNumber phone = 4;
}
message AddressBook { repeated Person person = 1; optional bytes byteData = 2; }
"""


def thrift(text=PEOPLE, name="Person", **options):
    return thrift_codec.Codec(thrift_codec.parse(text), name, **options)


def test_thrift_person():
    codec = thrift()
    bob = {"name": {"first_name": "bob", "last_name": "jenkins"}, "id": 42, "email": "foo@bar.com", "phones": [{"number": "415-555-5555", "type": "HOME"}]}
    assert codec.decode(codec.encode(bob)) == bob
    assert thrift(enum_as_int=True).decode(codec.encode(bob))["phones"][0]["type"] == 1
    assert codec.spark_schema().simpleString() == "struct<name:struct<first_name:string,last_name:string>,id:int,email:string,phones:array<struct<number:string,type:string>>>"
    # By position, and with trailing fields left out.
    assert codec.decode(codec.encode((("bob", "jenkins"), 42))) == bob | {"email": None, "phones": None}
    assert thrift(columns=["email"]).decode(codec.encode(bob)) == {"email": "foo@bar.com"}


def test_thrift_nesting_and_unknown_fields():
    codec = thrift(NESTED, "All")
    value = {"flag": 1, "tiny": -3, "small": 27000, "number": 16777216, "big": 6_000_000_000, "real": 3.14, "text": "ünï", "data": b"\x00\xff", "lists": [[1], [], [2, 3]], "names": ["a", "b"], "by_number": {"7": ["x"], "-1": []}, "counts": {"k": 5}, "either": {"number": None, "text": "t", "values": None}, "wrongs": {"w": {"what": "no"}}, "maps": [{"1": 0.5}], "choices": []}
    data = codec.encode(value | {"maps": [{"true": 0.5}]})
    assert codec.decode(data) == value
    assert thrift("struct All { 4: i32 number, 99: string later }", "All").decode(data) == {"number": 16777216, "later": None}
    assert thrift("struct All { 4: string number }", "All").decode(data) == {"number": None}  # another type: passed over


def test_thrift_bounds():
    codec = thrift(NESTED, "All")
    good = codec.encode({"text": "x" * 100, "lists": [[1, 2, 3]] * 10, "by_number": {"1": ["a"] * 9}})
    for cut in range(len(good) - 1):
        with pytest.raises(DecodeError):
            codec.decode(good[:cut])
    r = random.Random(1)
    for _ in range(3000):
        bad = bytearray(good)
        for _ in range(3):
            bad[r.randrange(len(bad))] = r.randrange(256)
        try:
            codec.decode(bytes(bad))
        except DecodeError:
            pass
    with pytest.raises(DecodeError):  # a list that says it has two thousand million elements
        codec.decode(b"\x0f\x00\x09\x0f\x7f\xff\xff\xff")
    with pytest.raises(DecodeError):
        thrift().decode(b"\x00")  # the name is required
    with pytest.raises(ValueError):
        codec.encode({"either": {"number": "x"}})


def test_map_keys_that_collide():
    schema = thrift_codec.parse("struct M { 1: map<double, i32> m }")
    codec = thrift_codec.Codec(schema, "M")
    pair = lambda v: b"\x3f\xf0" + bytes(6) + v.to_bytes(4, "big")
    with pytest.raises(DecodeError):
        codec.decode(b"\x0d\x00\x01\x04\x08\x00\x00\x00\x02" + pair(1) + pair(2) + b"\x00")
    with pytest.raises(ValueError):
        thrift_codec.Codec(thrift_codec.parse("struct M { 1: map<list<i32>, i32> m }"), "M").encode({"m": {"x": 1}})


def test_proto_person():
    codec = proto_codec.Codec(proto_codec.parse(ADDRESS), "Person")
    person = {"name": "Ada Lovelace", "id": 123, "email": "ada@example.org", "phone": [{"number": "415-999-9999"}, {"number": "415-666-6666", "type": "MOBILE"}]}
    got = codec.decode(codec.encode(person))
    assert got == person | {"phone": [{"number": "415-999-9999", "type": "HOME"}, {"number": "415-666-6666", "type": "MOBILE"}]}
    assert codec.decode(codec.encode({"name": "x", "id": 1}))["email"] == ""
    book = proto_codec.Codec(proto_codec.parse(ADDRESS), "AddressBook")
    assert book.decode(book.encode({"person": [person], "byteData": b"\x10\x20"}))["byteData"] == b"\x10\x20"
    assert book.spark_schema()["person"].dataType.elementType["phone"].dataType.simpleString() == "array<struct<number:string,type:string>>"
    with pytest.raises(ValueError, match="field id"):
        codec.encode({"name": "x", "id": "y"})
    for bad in (b"\xff\xff", b"\x0a\x01x"):
        with pytest.raises(DecodeError):
            codec.decode(bad)


def test_proto_of_a_row_schema():
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    file = proto_codec.from_row_schema(schema, extra=[("c", "bytes")])
    assert [(f.name, f.number) for f in file.message_type[0].field] == [("a", 1), ("b", 2), ("c", 3)]
    codec = proto_codec.Codec(file, "Row")
    assert codec.decode(codec.encode((7, "x"))) == {"a": 7, "b": "x", "c": b""}
    with pytest.raises(ValueError):
        proto_codec.from_row_schema(T.StructType([T.StructField("m", T.ArrayType(T.IntegerType()))]))
    with pytest.raises(ValueError):
        proto_codec.from_row_schema(T.StructType())


def test_blocks_are_what_the_format_says():
    data = records.block("a.B", [b"one", b"", b"x" * 300])
    assert data[:16] == records.MARKER and int.from_bytes(data[16:20], "little") == len(data) - 20 and data[-1] == 1
    # An independent reader: the envelope as a dynamic message.
    file = descriptor_pb2.FileDescriptorProto(name="block.proto", syntax="proto2")
    m = file.message_type.add(name="Envelope")
    for n, (name, kind, label) in enumerate([("version", 5, 1), ("name", 9, 1), ("blobs", 12, 3)], 1):
        m.field.add(name=name, number=n, type=kind, label=label)
    seen = proto_codec.Codec(file, "Envelope").decode(data[20:])
    assert seen == {"version": 1, "name": "a.B", "blobs": [b"one", b"", b"x" * 300]}
    assert records.records_of(data[16:] + b"rest") == ("a.B", [b"one", b"", b"x" * 300])
    for bad in (b"", b"\x01", data[16:-1], b"\xff\xff\xff\xff"):
        with pytest.raises(DecodeError):
            records.records_of(bad)


def people(spark, n=1000):
    return spark.range(n).select(F.struct(F.concat(F.lit("a\nb\x01"), "id").alias("first_name"), F.lit(None).cast("string").alias("last_name")).alias("name"), F.col("id").cast("int").alias("id"), F.lit("☃").alias("email"), F.array(F.struct(F.lit("1").alias("number"), F.lit("WORK").alias("type"))).alias("phones"))


@pytest.mark.parametrize("layout", ["block", "b64line"])
@pytest.mark.parametrize("compression", ["none", "gzip", "bzip2"])
def test_round_trip(spark, layout, compression):
    at = new_path(spark, "test-records")
    df = people(spark)
    records.write_records(df, at, thrift(), layout, "Person", compression=compression)
    for how in (layout, "auto"):
        assert sorted(map(str, records.read_records(spark, at, thrift(), how).collect())) == sorted(map(str, df.collect()))


def test_files_are_split(spark):
    at = new_path(spark, "test-records")
    records.write_records(people(spark, 20_000).coalesce(1), at, thrift(), in_block=7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        got = records.read_records(spark, at, thrift(columns=["id"]), "block")
        assert got.rdd.getNumPartitions() > 10
        assert got.agg(F.count("*"), F.sum("id"), F.countDistinct("id")).first() == (20_000, sum(range(20_000)), 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_block_files_hold_so_many_records(spark):
    at = new_path(spark, "test-records")
    records.write_records(people(spark, 250).coalesce(1), at, thrift())
    data = open(glob.glob(f"{at}/part-*")[0], "rb").read()
    assert [len(records.records_of(b)[1]) for b in data.split(records.MARKER)[1:]] == [100, 100, 50]


def with_faults(spark, at, layout):
    """100 records, every 10th cut to three quarters, in one partition."""
    codec = thrift()
    data = [codec.encode(r.asDict(True)) for r in people(spark, 100).collect()]
    data = [d[: len(d) * 3 // 4] if i % 10 == 0 else d for i, d in enumerate(data)]
    if layout == "block":
        rows = [(bytearray(records.block("P", data[i : i + 10])[:-1]),) for i in range(0, 100, 10)]
        spark.createDataFrame(rows, "v binary").coalesce(1).select(F.col("v").cast("string")).write.option("lineSep", "\x01").text(at)
    else:
        spark.createDataFrame([(base64.b64encode(d).decode(),) for d in data], "v string").coalesce(1).write.text(at)


@pytest.mark.parametrize("layout", ["block", "b64line"])
def test_tolerance(spark, layout):
    at = new_path(spark, "test-faults")
    with_faults(spark, at, layout)
    with pytest.raises(Exception, match="are bad"):
        records.read_records(spark, at, thrift(), layout).count()
    assert records.read_records(spark, at, thrift(), layout, threshold=0.5).count() == 90
    assert records.read_records(spark, at, thrift(), layout, least=11).count() == 90
    with pytest.raises(Exception, match="bad record"):
        records.read_records(spark, at, thrift(), layout, threshold=0).count()
    seen = records.Counters(spark)
    records.read_records(spark, at, thrift(), layout, threshold=0.5, counters=seen).count()
    assert seen.values() == {"Records Read": 90, "Errors": 10, "Records Skipped": 0}


def test_budget():
    b = ErrorBudget(0.1, 2)
    for _ in range(9):
        b.good()
    b.bad(ValueError("x"))
    b.close()
    b.bad(ValueError("y"))
    with pytest.raises(TooManyErrors):
        b.close()
    with pytest.raises(TooManyErrors):
        ErrorBudget(0).bad(ValueError())
    early = ErrorBudget(0.1, 2, early=True)
    early.bad(ValueError())
    with pytest.raises(TooManyErrors):
        early.bad(ValueError())


def test_empty_records_and_lines(spark):
    at = new_path(spark, "test-empty")
    codec = thrift()
    one = codec.encode({"name": {"first_name": "a"}})
    spark.createDataFrame([(bytearray(records.block("P", [one, b"", one, b"", one])[:-1]),)], "v binary").select(F.col("v").cast("string")).write.option("lineSep", "\x01").text(f"{at}/b")
    line = base64.b64encode(one).decode()
    spark.createDataFrame([(line,), ("",), (f" {line} ",), (line,)], "v string").write.text(f"{at}/l")
    assert records.read_records(spark, at, codec).count() == 6
    assert records.read_records(spark, at, records.Raw()).distinct().count() == 1


def test_writers_drop_null_rows_and_check_columns(spark):
    df = spark.createDataFrame([(None,), (bytearray(b"x"),)], "v binary")
    assert records.encoded(df, records.Raw()).count() == 1
    with pytest.raises(ValueError):
        records.encoded(spark.range(1).selectExpr("id", "id AS b"), records.Raw())
    with pytest.raises(ValueError):
        records.read_records(spark, "x", records.Raw(), "other")
    records.check_schema(people(spark), thrift())
    with pytest.raises(ValueError):
        records.check_schema(spark.range(1), thrift())
