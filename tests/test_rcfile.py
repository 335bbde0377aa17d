import pytest
from pyspark.sql import functions as F

from wirespark.sources import cross_idl, kv, loaders, paths, proto_codec, rcfile, records, text, thrift_codec
from wirespark.sources.thrift_codec import DecodeError
from wirespark.storage import new_path

PERSON = "struct Name { 1: string first, 2: string last } struct Person { 1: Name name, 2: map<i32, string> phones }"
WIDER = "struct Name { 1: string first, 2: string last } struct Person { 1: Name name, 2: map<i32, string> phones, 3: string email, 4: Name friend }"


def codec(idl=PERSON, name="Person", **options):
    return thrift_codec.Codec(thrift_codec.parse(idl), name, **options)


def test_numbers():
    for n in (0, 1, 127, 128, 255, 256, -1, -112, -113, -256, -257, 1 << 40, -(1 << 40)):
        data = rcfile.write_vint(n)
        assert rcfile.read_vint(data, 0) == (n, len(data))
    assert rcfile.write_vint(128) == b"\x8f\x80" and rcfile.write_vint(-113) == b"\x87\x70"


@pytest.mark.parametrize("packed", [None, *rcfile.CODECS])
def test_row_groups(packed):
    header = rcfile.new_header(3, {"a": "b"}, packed)
    again, at = rcfile.Header.read(header.to_bytes() + b"rest")
    assert (again.metadata, again.sync, again.codec, at) == (header.metadata, header.sync, packed, len(header.to_bytes()))
    columns = [[b"x", b"", b"", b""], [b"ab", b"cd", b"ef", b"ghi"], [b"", b"", b"", b""]]
    data = rcfile.row_group(header, columns) * 2
    assert list(rcfile.row_groups(header, data, [1, 0, 7])) == [[columns[1], columns[0], [None] * 4]] * 2
    with pytest.raises(DecodeError):
        list(rcfile.row_groups(header, data[:-1], [0]))


@pytest.mark.parametrize("packed", [None, "org.apache.hadoop.io.compress.DefaultCodec"])
def test_columns(spark, packed):
    at = new_path(spark, "test-rc")
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("x\n"), "id")).alias("s"), F.lit(None).cast("string").alias("n"))
    rcfile.write_columns(df.repartition(3), at, packed, rows=700)
    got = rcfile.read_columns(spark, at, [1, 0]).select(F.col("c0").cast("string").cast("long").alias("id"), F.col("c1").cast("string").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.select("id", "s").collect()))
    assert rcfile.read_columns(spark, at).where("c2 IS NOT NULL").count() == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert rcfile.read_columns(spark, at, [0]).distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_by_hive(spark):
    """The file is what Hive's own reader takes it for."""
    at = new_path(spark, "test-rc")
    rcfile.write_columns(spark.range(300).select("id", F.lit("v")).coalesce(1), at, "org.apache.hadoop.io.compress.DefaultCodec", rows=90)
    (file,) = rcfile.headers(spark, at)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.hadoop.hive.ql.io.RCFile.Reader(path.getFileSystem(conf), path, conf)
    row, cells, seen = jvm.org.apache.hadoop.io.LongWritable(), jvm.org.apache.hadoop.hive.serde2.columnar.BytesRefArrayWritable(), []
    while reader.next(row):
        reader.getCurrentRow(cells)
        ref = cells.get(0)
        seen.append(bytes(ref.getData())[ref.getStart() : ref.getStart() + ref.getLength()].decode())
    assert seen == [str(i) for i in range(300)]


def rows_of(spark, wide=False):
    name = F.struct(F.lit("a").alias("first"), F.col("id").cast("string").alias("last"))
    more = [F.concat(F.lit("e"), "id").alias("email"), F.when(F.col("id") % 2 == 0, name).alias("friend")] if wide else []
    return spark.range(50).select(name.alias("name"), F.create_map(F.lit("1"), F.lit("x")).alias("phones"), *more)


def test_records_and_evolution(spark):
    at = [new_path(spark, "test-rc") for _ in range(3)]
    wide = rows_of(spark, True)
    rcfile.write_records(wide, at[0], codec(WIDER))
    assert sorted(map(str, rcfile.read_records(spark, at[0], codec(WIDER)).collect())) == sorted(map(str, wide.collect()))
    # A narrower class reads its own fields; a wider one gets nulls from narrow files.
    assert sorted(map(str, rcfile.read_records(spark, at[0], codec()).collect())) == sorted(map(str, wide.select("name", "phones").collect()))
    rcfile.write_records(rows_of(spark), at[1], codec())
    assert rcfile.read_records(spark, at[1], codec(WIDER)).where("email IS NOT NULL OR friend IS NOT NULL").count() == 0
    # Bytes of fields that the writer didn't know are kept, and found by a wider reader.
    whole = codec(WIDER)
    unknown = F.udf(lambda e, f: bytearray(whole.encode({"email": e, "friend": f and f.asDict()})), "binary")
    rcfile.write_records(wide.withColumn("rest", unknown("email", "friend")).drop("email", "friend"), at[2], codec(), unknown="rest")
    assert sorted(map(str, rcfile.read_records(spark, at[2], codec(WIDER)).collect())) == sorted(map(str, wide.collect()))
    assert rcfile.read_records(spark, at[2], codec(WIDER, columns=["email"])).columns == ["email"]
    # All three in one scan.
    assert rcfile.read_records(spark, at, codec(WIDER)).count() == 150
    plain = new_path(spark, "test-rc")
    rcfile.write_columns(spark.range(3), plain)
    with pytest.raises(ValueError, match="field ids"):
        rcfile.read_records(spark, plain, codec())


def test_thrift_to_message():
    schema = thrift_codec.parse("enum E { A = 3 } struct In { 1: i32 x } struct Out { 1: i64 a, 2: E e, 3: list<string> l, 4: map<i32, In> m, 5: In i, 7: bool b }")
    file = cross_idl.message_file(schema, "Out", extra=[("more", "string")])
    out = next(m for m in file.message_type if m.name == "Out")
    assert [(f.name, f.number) for f in out.field] == [("a", 2), ("e", 3), ("l", 4), ("m", 5), ("i", 6), ("b", 8), ("more", 9)]
    messages = proto_codec.Codec(file, "Out")
    value = {"a": 1, "e": "A", "l": ["x"], "m": {"7": {"x": 1}}, "i": None, "b": 1}
    got = messages.decode(messages.encode(cross_idl.to_message(schema, "Out", value)))
    assert got == value | {"m": [{"key": 7, "value": {"x": 1}}], "more": ""}
    flat = cross_idl.message_file(schema, "Out", nested=False)
    assert [f.name for f in flat.message_type[0].field] == ["a", "e", "l", "b"]
    with pytest.raises(ValueError):
        cross_idl.to_message(schema, "Out", None)
    small = thrift_codec.parse("struct S { 1: i64 a, 2: list<string> l }")
    assert cross_idl.by_name(small, "S", messages) == {"a": "int64", "l": "string"}
    with pytest.raises(ValueError):
        cross_idl.by_name(thrift_codec.parse("struct S { 1: i32 a }"), "S", messages)


def test_loaders(spark):
    at = new_path(spark, "test-load")
    idl = "struct P { 1: i32 id, 2: string name }"
    df = spark.range(9).select(F.col("id").cast("int"), F.lit("n").alias("name"))
    records.write_records(df, at, loaders.codec_of(idl, "P"), "b64line")
    assert loaders.load(spark, at, idl, "P", ["name", "id"]).columns == ["name", "id"]
    assert loaders.register(spark, "p", at, idl, "P").count() == 9 and spark.sql("SELECT sum(id) FROM p").first()[0] == 36
    assert loaders.load_script(idl, "P") == "id: int,\nname: string"
    assert isinstance(loaders.codec_of("message P { optional int32 id = 1; }", "P"), proto_codec.Codec)
    for bad in (lambda: loaders.codec_of(idl, "Q"), lambda: loaders.load(spark, at, idl, "P", ["x"])):
        with pytest.raises(ValueError):
            bad()


def test_paths(spark):
    at = new_path(spark, "test-paths")
    spark.range(10).select(F.col("id").cast("string")).coalesce(1).write.text(f"{at}/a/b")
    files = list(paths.walk(spark, at))
    assert len(files) == 1 and paths.size(spark, at) == 20
    assert len(list(paths.walk(spark, at, folders=True))) == 3 and list(paths.walk(spark, at, recursive=False)) == []
    assert list(paths.walk(spark, at, paths.all_of(paths.visible, paths.suffix(".lzo")))) == []
    assert len(paths.expand(spark, f"{at}/a/*", f"{at}/none/*")) == 1
    assert paths.anything("/x/.y") and not paths.visible("/x/_y/")


def test_raw_pairs_and_pair_lines(spark):
    at = new_path(spark, "test-raw")
    kv.write_pairs(spark.createDataFrame([(7, "ab")], "k int, v string"), at)
    assert [bytes(x) for x in kv.read_raw_pairs(spark, at).first()] == [b"\0\0\0\7", b"\2ab"]
    out = new_path(spark, "test-lines")
    text.write_pairs_text(spark.createDataFrame([("a", 1), (None, 2), ("c", None)], "k string, v int").coalesce(1), out)
    assert [r[0] for r in spark.read.text(out).collect()] == ["a\t1", "2", "c"]


def test_base64_ends(spark):
    df = spark.createDataFrame([("  YWI=\r",), ("#YWI=#",), ("Y!WI=",)], "t string")
    assert [r[0] and bytes(r[0]) for r in df.select(text.base64_bytes("t")).collect()] == [b"ab", b"ab", None]
