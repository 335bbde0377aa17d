"""The .proto text, descriptor sets and what can't be read."""

import pickle

import pytest
from google.protobuf import descriptor_pb2

from wirespark.sources import proto_codec as P
from wirespark.storage import shared_dir

TEXT = """
syntax = "proto3"; package a.b;
import_free = 1;
"""
FULL = """
syntax = "proto3"; package a.b;
option java_package = "x{y"; // a comment }
/* another { */
enum E { option allow_alias = true; Z = 0; ONE = 1 [deprecated = true]; UNO = 1; }
message M {
  reserved 9, 10 to 12;
  int32 a = 1; string s = 2; optional string o = 3;
  map<string, int64> m = 4; map<int32, N> n = 5;
  oneof pick { string x = 6; N y = 7; }
  repeated E es = 8 [packed = true];
  message N { double d = 1; repeated string r = 2; bool b = 3; }
  E e = 13; bytes raw = 14;
}
service S { rpc Do (M) returns (M) { option x = "}"; } }
"""


@pytest.mark.parametrize("text", [TEXT, 'import "x.proto";', "message M { optional group G = 1 { } }", "message M { int32 a = 1; }", "message M { extend X { } }", "message M { optional int32 a = 1", "@", 'syntax = "proto4";', "message 1 { }", "message M { map<bytes, int32> m = 1; }"])
def test_what_is_not_understood_is_an_error(text):
    with pytest.raises(ValueError):
        P.parse(text)


def test_third_syntax():
    codec = P.Codec(P.parse(FULL), "M")
    assert codec.spark_schema().simpleString() == "struct<a:int,s:string,o:string,m:map<string,bigint>,n:map<int,struct<d:double,r:array<string>,b:int>>,x:string,y:struct<d:double,r:array<string>,b:int>,es:array<string>,e:string,raw:binary>"
    row = {"a": -3, "s": "é", "o": None, "m": [("k", 7)], "n": {4: {"d": 1.5, "r": ["q"], "b": 1}}, "x": None, "y": {"d": 2.0}, "es": ["ONE", "Z"], "e": "ONE", "raw": b"\xff"}
    data = codec.encode(row)
    got = codec.decode(data)
    assert got == {"a": -3, "s": "é", "o": "", "m": [("k", 7)], "n": [(4, {"d": 1.5, "r": ["q"], "b": 1})], "x": "", "y": {"d": 2.0, "r": [], "b": 0}, "es": ["ONE", "Z"], "e": "ONE", "raw": b"\xff"}
    assert pickle.loads(pickle.dumps(codec)).decode(data) == got
    assert codec.decode(b"\x68\x63")["e"] == "99"  # a number without a name


def test_defaults():
    codec = P.Codec(P.parse("""message M { optional string s = 1 [default = "x\\"y\\n"]; optional int32 h = 2 [default = 0x10, (my.option) = {a: [1]}]; required bytes b = 3; }"""), "M")
    assert codec.decode(codec.encode({"b": b"z"})) == {"s": 'x"y\n', "h": 16, "b": b"z"}


@pytest.mark.parametrize("syntax", ["proto2", "proto3"])
def test_bad_utf8_is_a_bad_record(syntax):
    label = "optional" if syntax == "proto2" else ""
    codec = P.Codec(P.parse(f'syntax = "{syntax}"; message M {{ {label} string s = 1; }}'), "M")
    with pytest.raises(P.DecodeError):
        codec.decode(b"\x0a\x01\xff")


def test_recursive_messages_are_told():
    with pytest.raises(ValueError, match="contains itself"):
        P.Codec(P.parse("message A { optional B b = 1; } message B { repeated A a = 1; }"), "A").spark_schema()


def test_descriptor_sets():
    two = descriptor_pb2.FileDescriptorProto(name="two.proto", package="c", syntax="proto3", dependency=["dynamic.proto"])
    two.message_type.add(name="W").field.add(name="inner", number=1, label=1, type=11, type_name=".a.b.M.N")
    data = descriptor_pb2.FileDescriptorSet(file=[P.parse(FULL), two]).SerializeToString()
    codec = P.Codec(P.descriptor_set(data), "W")
    assert codec.decode(codec.encode({"inner": {"d": 3.0}})) == {"inner": {"d": 3.0, "r": [], "b": 0}}
    assert P.Codec(P.descriptor_set(data), "a.b.M.N").spark_schema().names == ["d", "r", "b"]


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
    assert shared_dir(spark)
