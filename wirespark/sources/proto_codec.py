"""Protocol Buffer records, with message classes built at run time from the text of a .proto file or from descriptors.

The text may be of proto2 or proto3, with nested messages and enums, maps, oneofs and defaults. What is passed over is
what doesn't change how records are read: options, reserved and extension ranges, services. Anything else that isn't
understood (imports, groups, extensions) is an error, never a field that goes missing; files that need it come as
serialized descriptor sets, as `protoc --descriptor_set_out --include_imports` writes them.
"""

from __future__ import annotations

import re

from google.protobuf import descriptor_pb2, descriptor_pool, message, message_factory
from pyspark.sql import types as T

from .thrift_codec import DecodeError

FD = descriptor_pb2.FieldDescriptorProto
SCALARS = {n.lower()[5:]: v for n, v in FD.Type.items() if n[5:] not in ("MESSAGE", "ENUM", "GROUP")}
LABELS = {"optional": FD.LABEL_OPTIONAL, "required": FD.LABEL_REQUIRED, "repeated": FD.LABEL_REPEATED}
TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<token>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[A-Za-z_.][\w.]*|[-+]?\d[\w.+-]*|[-+][A-Za-z]\w*|[{}\[\]=;,()<>:])""", re.S)
NAME = re.compile(r"[A-Za-z_]\w*$")


class Tokens:
    def __init__(self, text: str):
        self.held, at = [], 0
        while at < len(text):
            if (m := TOKEN.match(text, at)) is None:
                raise ValueError(f"not understood: {text[at : at + 30]!r}")
            if m["token"]:
                self.held.append(m["token"])
            at = m.end()
        self.held.reverse()

    def __bool__(self) -> bool:
        return bool(self.held)

    def next(self) -> str:
        if not self.held:
            raise ValueError("the text ends within a declaration")
        return self.held.pop()

    def see(self, token: str) -> bool:
        """Takes the token if it comes next."""
        if self.held and self.held[-1] == token:
            self.held.pop()
            return True
        return False

    def expect(self, token: str) -> None:
        if (got := self.next()) != token:
            raise ValueError(f"expected {token!r}, not {got!r}")

    def name(self) -> str:
        if not NAME.match(got := self.next()):
            raise ValueError(f"expected a name, not {got!r}")
        return got

    def skip(self) -> None:
        """To the end of a statement: a semicolon, or the end of its block."""
        depth = 0
        while True:
            token = self.next()
            depth += (token == "{") - (token == "}")
            if depth == 0 and token in ";}":
                return


def _literal(token: str) -> str:
    """A default as descriptors have it; strings lose their quotes, with C escapes resolved."""
    if token[0] in "\"'":
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), token[1:-1])
    return str(int(token, 0)) if re.fullmatch(r"[-+]?(0[xX][0-9a-fA-F]+|0[0-7]+)", token) else token


class Parser:
    def __init__(self, text: str):
        self.tokens = Tokens(text)
        self.out = descriptor_pb2.FileDescriptorProto(name="dynamic.proto", syntax="proto2")

    def file(self) -> descriptor_pb2.FileDescriptorProto:
        t = self.tokens
        while t:
            word = t.next()
            if word == "syntax":
                t.expect("=")
                self.out.syntax = t.next().strip("\"'")
                if self.out.syntax not in ("proto2", "proto3"):
                    raise ValueError(f"no syntax {self.out.syntax}")
                t.expect(";")
            elif word == "package":
                self.out.package = t.next()
                t.expect(";")
            elif word == "message":
                self.message(self.out.message_type.add(name=t.name()))
            elif word == "enum":
                self.enum(self.out.enum_type.add(name=t.name()))
            elif word in ("option", "service"):
                t.skip()
            elif word != ";":
                raise ValueError(f"not understood at the top: {word!r}")
        return self.out

    def enum(self, e) -> None:
        t = self.tokens
        t.expect("{")
        while not t.see("}"):
            if t.see("option"):
                if t.see("allow_alias"):
                    t.expect("=")
                    e.options.allow_alias = t.next() == "true"
                    t.expect(";")
                else:
                    t.skip()
            elif t.see("reserved"):
                t.skip()
            elif not t.see(";"):
                name = t.name()
                t.expect("=")
                e.value.add(name=name, number=int(t.next(), 0))
                self.options(None)

    def message(self, m) -> None:
        t = self.tokens
        t.expect("{")
        while not t.see("}"):
            if t.see(";"):
                continue
            word = t.next()
            if word == "message":
                self.message(m.nested_type.add(name=t.name()))
            elif word == "enum":
                self.enum(m.enum_type.add(name=t.name()))
            elif word in ("reserved", "extensions", "option"):
                t.skip()
            elif word in ("extend", "group"):
                raise ValueError(f"not understood in a message: {word}")
            elif word == "oneof":
                self.oneof(m)
            elif word == "map" and t.see("<"):
                self.map(m)
            elif word in LABELS:
                self.field(m, t.next(), LABELS[word], explicit=word == "optional")
            elif self.out.syntax == "proto3":
                self.field(m, word, FD.LABEL_OPTIONAL)
            else:
                raise ValueError(f"a field of type {word!r} without a label")
        # Fields of one member each come after the oneofs that are written.
        for f in m.field:
            if f.proto3_optional:
                f.oneof_index = len(m.oneof_decl)
                m.oneof_decl.add(name=f"_{f.name}")

    def field(self, m, kind: str, label: int, explicit: bool = False, **more):
        if kind == "group":
            raise ValueError("groups aren't understood")
        f = m.field.add(name=self.tokens.name(), label=label, **more)
        self.tokens.expect("=")
        f.number = int(self.tokens.next(), 0)
        self.type(f, kind)
        if explicit and self.out.syntax == "proto3":
            f.proto3_optional = True
        self.options(f)
        return f

    @staticmethod
    def type(f, kind: str) -> None:
        if kind in SCALARS:
            f.type = SCALARS[kind]
        else:
            f.type_name = kind

    def oneof(self, m) -> None:
        t = self.tokens
        index = len(m.oneof_decl)
        m.oneof_decl.add(name=t.name())
        t.expect("{")
        while not t.see("}"):
            if t.see("option"):
                t.skip()
            elif not t.see(";"):
                self.field(m, t.next(), FD.LABEL_OPTIONAL, oneof_index=index)

    def map(self, m) -> None:
        t = self.tokens
        key = t.next()
        t.expect(",")
        value = t.next()
        t.expect(">")
        if key not in SCALARS or key in ("float", "double", "bytes"):
            raise ValueError(f"no keys of type {key}")
        name = t.name()
        # Maps are repeated entries of a message with this name.
        entry = m.nested_type.add(name="".join(w[:1].upper() + w[1:] for w in name.split("_")) + "Entry")
        entry.options.map_entry = True
        for number, part, kind in ((1, "key", key), (2, "value", value)):
            self.type(entry.field.add(name=part, number=number, label=FD.LABEL_OPTIONAL), kind)
        t.expect("=")
        m.field.add(name=name, number=int(t.next(), 0), label=FD.LABEL_REPEATED, type_name=entry.name)
        self.options(None)

    def options(self, f) -> None:
        """Of those in brackets, default and packed matter to records."""
        t = self.tokens
        if t.see("["):
            depth = 1
            while depth:
                word = t.next()
                depth += (word in "[{") - (word in "]}")
                if f is not None and depth == 1 and word == "default":
                    t.expect("=")
                    f.default_value = _literal(t.next())
                elif f is not None and depth == 1 and word == "packed":
                    t.expect("=")
                    f.options.packed = t.next() == "true"
        t.expect(";")


def parse(text: str) -> descriptor_pb2.FileDescriptorProto:
    """The messages and enums of a .proto text; ValueError for what isn't understood."""
    return Parser(text).file()


def descriptor_set(data: bytes) -> descriptor_pb2.FileDescriptorSet:
    """A serialized descriptor set, with each file after those that it imports."""
    return descriptor_pb2.FileDescriptorSet.FromString(data)


def from_row_schema(schema: T.StructType, name: str = "Row", extra: list[tuple[str, str]] = ()) -> descriptor_pb2.FileDescriptorProto:
    """A message for a flat row: fields numbered from 1, all optional; extra: (name, scalar) fields that follow."""
    kinds = {T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes", T.BooleanType: "bool"}
    if not schema.fields:
        raise ValueError("a row without columns")
    out = descriptor_pb2.FileDescriptorProto(name="row.proto", syntax="proto2")
    m = out.message_type.add(name=name)
    for n, (label, kind) in enumerate([*((f.name, kinds.get(type(f.dataType))) for f in schema.fields), *extra], 1):
        if kind is None:
            raise ValueError(f"{label} isn't flat")
        m.field.add(name=label, number=n, label=FD.LABEL_OPTIONAL, type=SCALARS[kind])
    return out


def is_map(f) -> bool:
    return f.type == f.TYPE_MESSAGE and f.message_type.GetOptions().map_entry


class Codec:
    """Bytes of message `name` to dicts of column values, and back. Picklable: classes are rebuilt where it is used.

    file: one file, or a set with what it imports; name: with or without the package of the last file.
    """

    def __init__(self, file: descriptor_pb2.FileDescriptorProto | descriptor_pb2.FileDescriptorSet, name: str, enum_as_int: bool = False, bool_as_int: bool = True, columns: list[str] | None = None):
        files = list(file.file) if isinstance(file, descriptor_pb2.FileDescriptorSet) else [file]
        self.files, self.package, self.name = [f.SerializeToString() for f in files], files[-1].package if files else "", name
        self.enum_as_int, self.bool_as_int, self.columns = enum_as_int, bool_as_int, columns
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    @property
    def cls(self):
        if self.made is None:
            pool = descriptor_pool.DescriptorPool()
            for f in self.files:
                pool.AddSerializedFile(f)
            try:
                found = pool.FindMessageTypeByName(f"{self.package}.{self.name}".lstrip("."))
            except KeyError:
                found = pool.FindMessageTypeByName(self.name)
            self.made = message_factory.GetMessageClass(found)
        return self.made

    def column_type(self, f, inside: tuple[str, ...] = ()) -> T.DataType:
        if is_map(f):
            key, value = (f.message_type.fields_by_name[x] for x in ("key", "value"))
            return T.MapType(self.column_type(key), self.column_type(value, inside))
        if f.type in (f.TYPE_MESSAGE, f.TYPE_GROUP):
            one = self.struct_type(f.message_type, inside)
        elif f.type == f.TYPE_ENUM:
            one = T.IntegerType() if self.enum_as_int else T.StringType()
        else:
            one = {f.CPPTYPE_INT32: T.IntegerType(), f.CPPTYPE_UINT32: T.IntegerType(), f.CPPTYPE_INT64: T.LongType(), f.CPPTYPE_UINT64: T.LongType(), f.CPPTYPE_DOUBLE: T.DoubleType(), f.CPPTYPE_FLOAT: T.FloatType(), f.CPPTYPE_BOOL: T.IntegerType() if self.bool_as_int else T.BooleanType(), f.CPPTYPE_STRING: T.BinaryType() if f.type == f.TYPE_BYTES else T.StringType()}[f.cpp_type]
        return T.ArrayType(one) if f.is_repeated else one

    def struct_type(self, d, inside: tuple[str, ...] = ()) -> T.StructType:
        if d.full_name in inside:
            raise ValueError(f"{d.full_name} contains itself: a column's type can't")
        return T.StructType([T.StructField(f.name, self.column_type(f, (*inside, d.full_name))) for f in d.fields])

    def spark_schema(self) -> T.StructType:
        whole = self.struct_type(self.cls.DESCRIPTOR)
        return whole if self.columns is None else T.StructType([f for f in whole if f.name in self.columns])

    def value(self, f, v):
        if f.type in (f.TYPE_MESSAGE, f.TYPE_GROUP):
            return self.row(v)
        if f.type == f.TYPE_ENUM:
            known = f.enum_type.values_by_number.get(v)
            return v if self.enum_as_int else known.name if known else str(v)  # proto3 keeps numbers that have no name
        if f.type == f.TYPE_STRING and isinstance(v, bytes):
            raise DecodeError(f"{f.name} isn't UTF-8")
        if f.cpp_type == f.CPPTYPE_BOOL and self.bool_as_int:
            return int(v)
        if f.cpp_type == f.CPPTYPE_UINT32:
            return v - (1 << 32) if v >= 1 << 31 else v
        if f.cpp_type == f.CPPTYPE_UINT64:
            return v - (1 << 64) if v >= 1 << 63 else v
        return v

    def row(self, m, columns=None) -> dict:
        """Fields that aren't set have their defaults, as everywhere in Protocol Buffers; unset messages are null."""
        out = {}
        for f in m.DESCRIPTOR.fields:
            if columns is not None and f.name not in columns:
                continue
            v = getattr(m, f.name)
            if is_map(f):
                own = f.message_type.fields_by_name
                out[f.name] = [(self.value(own["key"], k), self.value(own["value"], x)) for k, x in v.items()]
            elif f.is_repeated:
                out[f.name] = [self.value(f, x) for x in v]
            elif f.type == f.TYPE_MESSAGE and not m.HasField(f.name):
                out[f.name] = None
            else:
                out[f.name] = self.value(f, v)
        return out

    def decode(self, data: bytes) -> dict:
        try:
            m = self.cls.FromString(data)
        except message.DecodeError as e:
            raise DecodeError(str(e)) from e
        if not m.IsInitialized():
            raise DecodeError("required fields are missing")
        try:
            return self.row(m, self.columns)
        except UnicodeDecodeError as e:
            raise DecodeError(str(e)) from e

    def encode(self, value) -> bytes:
        m = self.cls()
        self.fill(m, value)
        return m.SerializeToString()

    def fill(self, m, value) -> None:
        fields = m.DESCRIPTOR.fields
        pairs = [(f, value.get(f.name)) for f in fields] if isinstance(value, dict) else zip(fields, value)
        for i, (f, v) in enumerate(pairs):
            if v is None:
                continue
            try:
                if is_map(f):
                    own, to = f.message_type.fields_by_name, getattr(m, f.name)
                    for k, x in v.items() if isinstance(v, dict) else v:
                        k = self.plain(own["key"], k)
                        if own["value"].type == f.TYPE_MESSAGE:
                            self.fill(to[k], x)
                        else:
                            to[k] = self.plain(own["value"], x)
                elif f.type == f.TYPE_MESSAGE:
                    for x in v if f.is_repeated else [v]:
                        self.fill(getattr(m, f.name).add() if f.is_repeated else self.touched(m, f.name), x)
                elif f.is_repeated:
                    getattr(m, f.name).extend(self.plain(f, x) for x in v)
                else:
                    setattr(m, f.name, self.plain(f, v))
            except (TypeError, ValueError, KeyError) as e:
                raise ValueError(f"field {f.name} (number {i}) can't hold {v!r}: {e}") from e

    @staticmethod
    def touched(m, name):
        inner = getattr(m, name)
        inner.SetInParent()
        return inner

    @staticmethod
    def plain(f, v):
        if f.type == f.TYPE_ENUM and isinstance(v, str):
            return f.enum_type.values_by_name[v].number
        if f.cpp_type == f.CPPTYPE_BOOL:
            return bool(v)
        if f.type == f.TYPE_BYTES:
            return bytes(v)
        if f.cpp_type == f.CPPTYPE_UINT32:
            return v % (1 << 32)
        return v % (1 << 64) if f.cpp_type == f.CPPTYPE_UINT64 else v
