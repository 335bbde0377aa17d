import pytest
from pyspark.sql import functions as F

from wirespark.functions import casts, conf, inflect, invoke, vector, writables
from wirespark.storage import new_path

PAIRS = [("search", "searches"), ("fish", "fish"), ("query", "queries"), ("index", "indices"), ("safe", "saves"), ("person", "people"), ("datum", "data"), ("ox", "oxen"), ("quiz", "quizzes"), ("virus", "viri"), ("matrix", "matrices"), ("axis", "axes"), ("mouse", "mice")]


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize("single,plural", PAIRS)
def test_plurals(spark, single, plural):
    df = spark.createDataFrame([(single, plural)], "s string, p string")
    assert df.select(inflect.pluralize("s"), inflect.singularize("p")).first() == (plural, single)


def test_words(spark):
    words = [("HTMLTidyGenerator", "html_tidy_generator"), ("InnerClass$Test", "inner_class__test"), ("usersSection.CommissionDepartment", "users_section/commission_department")]
    for camel, under in words:
        df = spark.createDataFrame([(camel, under)], "c string, u string")
        assert df.select(inflect.underscore("c")).first()[0] == under
    df = spark.createDataFrame([("users_section/commission_department", "inner_class__test", "area51_controller")], "a string, b string, c string")
    assert df.select(inflect.camelize("a"), inflect.camelize("b"), inflect.camelize("c", True)).first() == ("usersSection.CommissionDepartment", "InnerClass$Test", "area51Controller")
    lit = F.lit
    assert one(spark, inflect.foreign_key(lit("application.billing.Account"))) == "account_id"
    assert one(spark, inflect.foreign_key(lit("Account"), False)) == "accountid"
    assert one(spark, inflect.tableize(lit("NodeChild"))) == "node_children"
    assert one(spark, inflect.classify(lit("schema.node_children"))) == "NodeChild"
    assert one(spark, inflect.humanize(lit("employee_id"))) == "Employee"
    assert one(spark, inflect.titleize(lit("activeRecord_name"))) == "Active Record Name"
    assert one(spark, inflect.dasherize(lit("street_address"))) == "street-address"
    assert [one(spark, inflect.ordinalize(lit(n))) for n in (11, 101, 10013, 2, 3, -1)] == ["11th", "101st", "10013th", "2nd", "3rd", "-1th"]


def test_casts(spark):
    assert [one(spark, casts.wrapped_int(F.lit(v).cast("long"))) for v in (3_000_000_000, -1, 2**31, -(2**31) - 1)] == [-1294967296, -1, -(2**31), 2**31 - 1]
    assert [one(spark, casts.float_to_int(F.lit(v))) for v in (1.9, -1.9, 1e20, -1e20, float("nan"))] == [1, -1, 2**31 - 1, -(2**31), 0]
    assert one(spark, casts.float_to_long(F.lit(1e30))) == 2**63 - 1
    assert one(spark, casts.parsed(F.lit("x"), "int", strict=False)) is None
    with pytest.raises(Exception):
        one(spark, casts.parsed(F.lit("x"), "int"))
    df = spark.createDataFrame([(bytearray(b"\0\0\0\2ab"),), (bytearray(b"\0\0\0\3ab"),), (bytearray(b"\0"),)], "b binary")
    assert [r[0] and bytes(r[0]) for r in df.select(casts.sized_bytes("b")).collect()] == [b"ab", None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([0.0, 1.5, 0.0, -2.0],), ([],)], "v array<double>")
    sparse = df.select(vector.dense_to_sparse("v").alias("s"), "v")
    assert sparse.select("s").schema.simpleString() == "struct<s:struct<cardinality:int,entries:array<struct<index:int,value:double>>>>"
    assert all(r.d == r.v for r in sparse.select(vector.sparse_to_dense("s").alias("d"), "v").collect())
    odd = spark.sql("SELECT named_struct('cardinality', 3, 'entries', CAST(array(struct(2, 1D), struct(7, 9D), struct(-1, 9D), struct(0, 4D), struct(2, 5D)) AS array<struct<index: int, value: double>>)) AS s")
    assert odd.select(vector.sparse_to_dense("s")).first()[0] == [4.0, 0.0, 5.0]
    assert odd.select(vector.out_of_bounds("s")).first()[0] == 2
    assert odd.select(vector.sparse_to_dense("s", 2, single=True)).first()[0] == [4.0, 0.0]
    assert df.select(vector.resized("v", 2)).collect()[0][0] == [0.0, 1.5] and df.select(vector.resized("v", 2)).collect()[1][0] == [0.0, 0.0]
    with pytest.raises(Exception, match="cardinality"):
        df.select(vector.exact("v", 4)).collect()
    with pytest.raises(ValueError):
        vector.check(3, dense=True, sparse=True, sequential=False)


def test_invoke(spark):
    assert one(spark, invoke.invoke_static("java.lang.Integer.parseInt", F.lit("12"), returns="int")) == 12
    assert one(spark, invoke.invoke_static("java.lang.Integer.parseInt", F.lit("x"), returns="int", safe=True)) is None
    assert one(spark, invoke.invoke_instance("str.replace", F.lit("aba"), F.lit("a"), F.lit("c"))) == "cbc"
    assert one(spark, invoke.invoke_python("math.fsum", F.array(F.lit(0.5), F.lit(2.0)), returns="double")) == 2.5
    assert one(spark, invoke.invoke_python("os.path.basename", F.lit("/a/b"))) == "b"
    with pytest.raises(ValueError):
        invoke.invoke_static("noclass", F.lit(1))
    with pytest.raises(ValueError):
        invoke.invoke_python("math.fsum", F.lit(1), returns="date")


def test_converters(spark):
    at = [new_path(spark, "test-converters") for _ in range(4)]
    df = spark.createDataFrame([("7", 3_000_000_000), ("8", None)], "k string, v bigint")
    writables.store_pairs(df, at[0], "-c int", "--converter int")
    assert [tuple(r) for r in writables.load_pairs(spark, at[0], "-c int", "-c int").collect()] == [(7, -1294967296)]
    writables.store_pairs(spark.sql("SELECT 2.9D AS k, array(1, 2) AS v"), at[1], "-c long")
    assert tuple(writables.load_pairs(spark, at[1], "-c long").first()) == (2, "[1,2]")
    assert writables.load_pairs(spark, at[1], "-c long", columns=["value"]).columns == ["value"]
    v = spark.sql("SELECT 'a' AS k, array(1D, 0D, 3D) AS v")
    writables.store_pairs(v, at[2], value="-c vector -cardinality 2")
    assert writables.load_pairs(spark, at[2], value="-c vector -dense -cardinality 2").first().value == [1.0, 0.0]
    entries = writables.load_pairs(spark, at[2], value="-c vector -sparse").first().value
    assert entries.cardinality == 2 and [tuple(e) for e in entries.entries] == [(0, 1.0)]
    with pytest.raises(Exception, match="cardinality"):
        writables.load_pairs(spark, at[2], value="-c vector -dense -cardinality 3").collect()
    for bad in ("-c", "-x int", "-c nothing", "-c vector -dense -sparse", "-c vector -odd"):
        with pytest.raises(ValueError):
            writables.converter(bad)
    with pytest.raises(TypeError):
        writables.store_pairs(spark.sql("SELECT map(1, 2) AS k, 1 AS v"), at[3], "-c int", "-c int")
    with pytest.raises(ValueError):
        writables.load_pairs(spark, at[0], columns=[])


def test_conf(spark):
    conf.put(spark, "wirespark.test.list", ["a", 1, {"b": None}])
    assert conf.get(spark, "wirespark.test.list") == ["a", 1, {"b": None}] and conf.get(spark, "wirespark.test.none", 5) == 5
    conf.put_once(spark, "wirespark.test.name", "x")
    conf.put_once(spark, "wirespark.test.name", "x")
    with pytest.raises(ValueError):
        conf.put_once(spark, "wirespark.test.name", "y")
