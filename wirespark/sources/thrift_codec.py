"""Thrift records: an IDL subset, and a bounds-checked codec for the binary protocol.

A schema is made by `parse(text)`, from struct, union, exception, enum and typedef declarations with the usual base
types, list, set and map. `Codec` turns one struct's bytes into a tuple of column values and back.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import types as T


class DecodeError(ValueError):
    """Bytes that are no record of the schema."""


@dataclass(frozen=True)
class Kind:
    """name: a base type, list, set, map, or the name of a declaration; of: element types."""

    name: str
    of: tuple[Kind, ...] = ()


@dataclass
class Field:
    number: int
    name: str
    kind: Kind
    required: bool = False


@dataclass
class Schema:
    structs: dict[str, list[Field]] = field(default_factory=dict)
    unions: set[str] = field(default_factory=set)
    enums: dict[str, dict[str, int]] = field(default_factory=dict)
    typedefs: dict[str, Kind] = field(default_factory=dict)

    def resolved(self, kind: Kind) -> Kind:
        while kind.name in self.typedefs and not kind.of:
            kind = self.typedefs[kind.name]
        return kind


BASES = {"bool", "byte", "i8", "i16", "i32", "i64", "double", "string", "binary"}
#: The protocol's type numbers.
CODES = {"bool": 2, "byte": 3, "i8": 3, "double": 4, "i16": 6, "enum": 8, "i32": 8, "i64": 10, "string": 11, "binary": 11, "struct": 12, "map": 13, "set": 14, "list": 15}
FORMATS = {"byte": ">b", "i8": ">b", "i16": ">h", "i32": ">i", "i64": ">q", "double": ">d"}
FIXED = {2: 1, 3: 1, 4: 8, 6: 2, 8: 4, 10: 8}
TOKEN = re.compile(r'"[^"]*"|\'[^\']*\'|[A-Za-z_][\w.]*|-?\d[\w.+-]*|[{}()\[\]<>,;:=]')


class _Reader:
    def __init__(self, text: str):
        text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
        text = re.sub(r"(//|#)[^\n]*", " ", text)
        self.tokens, self.at = TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str = "") -> str:
        token = self.peek()
        if not token or expected and token != expected:
            raise ValueError(f"expected {expected or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def skipped(self, token: str) -> bool:
        if self.peek() == token:
            self.at += 1
            return True
        return False

    def kind(self) -> Kind:
        name = self.take()
        if name not in ("list", "set", "map"):
            return Kind(name.rpartition(".")[2])
        self.take("<")
        of = [self.kind()]
        while self.skipped(","):
            of.append(self.kind())
        self.take(">")
        return Kind(name, tuple(of))

    def value(self) -> None:
        if self.peek() in "[{":
            depth = 0
            while True:
                depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(self.take(), 0)
                if not depth:
                    return
        self.take()


def parse(text: str) -> Schema:
    r, out = _Reader(text), Schema()
    while word := r.peek():
        r.take()
        if word in ("namespace", "include"):
            r.take()
            if word == "namespace":
                r.take()
        elif word == "typedef":
            kind = r.kind()
            out.typedefs[r.take()] = kind
        elif word == "const":
            r.kind(), r.take(), r.take("="), r.value()
        elif word == "enum":
            name, values, last = r.take(), {}, -1
            r.take("{")
            while not r.skipped("}"):
                label = r.take()
                last = int(r.take(), 0) if r.skipped("=") else last + 1
                values[label] = last
                r.skipped(",") or r.skipped(";")
            out.enums[name] = values
        elif word in ("struct", "union", "exception"):
            name, fields, free = r.take(), [], -1
            r.take("{")
            while not r.skipped("}"):
                number = None
                if re.fullmatch(r"-?\d+", r.peek()):
                    number = int(r.take())
                    r.take(":")
                required = r.skipped("required")
                required or r.skipped("optional")
                kind, label = r.kind(), r.take()
                if r.skipped("="):
                    r.value()
                r.skipped(",") or r.skipped(";")
                if number is None:
                    number, free = free, free - 1
                fields.append(Field(number, label, kind, required))
            out.structs[name] = fields
            if word == "union":
                out.unions.add(name)
        r.skipped(";") or r.skipped(",")
    return out


def spark_type(schema: Schema, kind: Kind | str, enum_as_int: bool = False, bool_as_int: bool = True) -> T.DataType:
    """The column type: sets are arrays, map keys are strings, enums are names, bools are 0 and 1, unless told otherwise."""
    kind = schema.resolved(Kind(kind) if isinstance(kind, str) else kind)
    sub = lambda k: spark_type(schema, k, enum_as_int, bool_as_int)
    if kind.name in ("list", "set"):
        return T.ArrayType(sub(kind.of[0]))
    if kind.name == "map":
        return T.MapType(T.StringType(), sub(kind.of[1]))
    if kind.name in schema.enums:
        return T.IntegerType() if enum_as_int else T.StringType()
    if kind.name in schema.structs:
        return T.StructType([T.StructField(f.name, sub(f.kind)) for f in schema.structs[kind.name]])
    if kind.name == "bool":
        return T.IntegerType() if bool_as_int else T.BooleanType()
    simple = {"byte": T.IntegerType, "i8": T.IntegerType, "i16": T.IntegerType, "i32": T.IntegerType, "i64": T.LongType, "double": T.DoubleType, "string": T.StringType, "binary": T.BinaryType}
    if kind.name not in simple:
        raise ValueError(f"unknown type {kind.name}")
    return simple[kind.name]()


class Codec:
    """Bytes of struct `name` to dicts of column values, and back. columns: top-level fields to decode, others are skipped."""

    def __init__(self, schema: Schema, name: str, enum_as_int: bool = False, bool_as_int: bool = True, columns: list[str] | None = None):
        self.schema, self.name, self.enum_as_int, self.bool_as_int = schema, name, enum_as_int, bool_as_int
        self.columns = None if columns is None else set(columns)
        self.labels = {e: {v: k for k, v in values.items()} for e, values in schema.enums.items()}

    def spark_schema(self) -> T.StructType:
        whole = spark_type(self.schema, self.name, self.enum_as_int, self.bool_as_int)
        return whole if self.columns is None else T.StructType([f for f in whole if f.name in self.columns])

    def code(self, kind: Kind) -> int:
        kind = self.schema.resolved(kind)
        return CODES["enum" if kind.name in self.schema.enums else "struct" if kind.name in self.schema.structs else kind.name]

    # Reading.
    def decode(self, data: bytes) -> dict:
        self.data = data
        try:
            value, at = self.read_struct(self.name, 0, self.columns)
        except (struct.error, IndexError, UnicodeDecodeError, RecursionError) as e:
            raise DecodeError(str(e)) from e
        return value

    def need(self, at: int, n: int) -> None:
        if n < 0 or at + n > len(self.data):
            raise DecodeError(f"{n} bytes wanted at {at} of {len(self.data)}")

    def read_struct(self, name: str, at: int, columns: set[str] | None = None) -> tuple[dict, int]:
        fields = {f.number: f for f in self.schema.structs[name]}
        out = dict.fromkeys([f.name for f in self.schema.structs[name] if columns is None or f.name in columns])
        while True:
            self.need(at, 1)
            code = self.data[at]
            at += 1
            if code == 0:
                break
            self.need(at, 2)
            (number,) = struct.unpack_from(">h", self.data, at)
            at += 2
            f = fields.get(number)
            if f is None or code != self.code(f.kind) or columns is not None and f.name not in columns:
                at = self.skip(code, at)
            else:
                out[f.name], at = self.read(f.kind, at)
        missing = [f.name for f in self.schema.structs[name] if f.required and out.get(f.name) is None and (columns is None or f.name in columns)]
        if missing:
            raise DecodeError(f"{name} lacks {', '.join(missing)}")
        return out, at

    def size(self, at: int, least: int) -> int:
        self.need(at, 4)
        (n,) = struct.unpack_from(">i", self.data, at)
        self.need(at + 4, n * least if n >= 0 else -1)
        return n

    def least(self, code: int) -> int:
        if code not in FIXED and code not in (11, 12, 13, 14, 15):
            raise DecodeError(f"type {code} of an element")
        return FIXED.get(code, {11: 4, 12: 1, 13: 6, 14: 5, 15: 5}.get(code, 1))

    def read(self, kind: Kind, at: int):
        kind = self.schema.resolved(kind)
        name = kind.name
        if name in FORMATS:
            (v,) = struct.unpack_from(FORMATS[name], self.data, at)
            return v, at + struct.calcsize(FORMATS[name])
        if name == "bool":
            self.need(at, 1)
            v = self.data[at] != 0
            return (int(v) if self.bool_as_int else v), at + 1
        if name in self.schema.enums:
            (v,) = struct.unpack_from(">i", self.data, at)
            return (v if self.enum_as_int else self.labels[name].get(v)), at + 4
        if name in ("string", "binary"):
            n = self.size(at, 1)
            v = bytes(self.data[at + 4 : at + 4 + n])
            return (v.decode("utf-8") if name == "string" else v), at + 4 + n
        if name in self.schema.structs:
            return self.read_struct(name, at)
        if name == "map":
            self.need(at, 6)
            k, v = self.data[at], self.data[at + 1]
            (n,) = struct.unpack_from(">i", self.data, at + 2)
            if n and (k != self.code(kind.of[0]) or v != self.code(kind.of[1])):
                raise DecodeError(f"map of types {k} and {v}")
            self.need(at + 6, n * (self.least(k) + self.least(v)) if n else 0)
            at, out = at + 6, {}
            for _ in range(n):
                key, at = self.read(kind.of[0], at)
                value, at = self.read(kind.of[1], at)
                if out.get(text := key_text(key)) is not None:
                    raise DecodeError(f"two keys are written {text}")
                out[text] = value
            return out, at
        self.need(at, 5)
        code = self.data[at]
        n = self.size(at + 1, 0)
        if n and code != self.code(kind.of[0]):
            raise DecodeError(f"{name} of type {code}")
        self.need(at + 5, n * self.least(code) if n else 0)
        at, out = at + 5, []
        for _ in range(n):
            v, at = self.read(kind.of[0], at)
            out.append(v)
        return out, at

    def skip(self, code: int, at: int) -> int:
        if code in FIXED:
            self.need(at, FIXED[code])
            return at + FIXED[code]
        if code == 11:
            return at + 4 + self.size(at, 1)
        if code == 12:
            while True:
                self.need(at, 1)
                inner = self.data[at]
                if inner == 0:
                    return at + 1
                at = self.skip(inner, at + 3)
        if code == 13:
            self.need(at, 6)
            k, v, n = self.data[at], self.data[at + 1], self.size(at + 2, 0)
            at += 6
            for _ in range(n):
                at = self.skip(v, self.skip(k, at))
            return at
        if code in (14, 15):
            self.need(at, 5)
            inner, n = self.data[at], self.size(at + 1, 0)
            at += 5
            for _ in range(n):
                at = self.skip(inner, at)
            return at
        raise DecodeError(f"type {code}")

    # Writing.
    def encode(self, value) -> bytes:
        out = bytearray()
        self.write_struct(self.name, value, out)
        return bytes(out)

    def write_struct(self, name: str, value, out: bytearray) -> None:
        fields = self.schema.structs[name]
        values = [value.get(f.name) for f in fields] if isinstance(value, dict) else [*value, *[None] * (len(fields) - len(value))]
        for f, v in zip(fields, values):
            if v is not None:
                out += struct.pack(">bh", self.code(f.kind), f.number)
                self.write(f.kind, v, out)
        out.append(0)

    def write(self, kind: Kind, v, out: bytearray) -> None:
        kind = self.schema.resolved(kind)
        name = kind.name
        if name in FORMATS:
            out += struct.pack(FORMATS[name], float(v) if name == "double" else int(v))
        elif name == "bool":
            out.append(1 if v else 0)
        elif name in self.schema.enums:
            if isinstance(v, str) and v not in self.schema.enums[name]:
                raise ValueError(f"{name} has no {v}")
            out += struct.pack(">i", self.schema.enums[name][v] if isinstance(v, str) else int(v))
        elif name in ("string", "binary"):
            data = v.encode() if isinstance(v, str) else bytes(v)
            out += struct.pack(">i", len(data)) + data
        elif name in self.schema.structs:
            self.write_struct(name, v, out)
        elif name == "map":
            pairs = list(v.items()) if isinstance(v, dict) else list(v)
            out += struct.pack(">bbi", self.code(kind.of[0]), self.code(kind.of[1]), len(pairs))
            for k, x in pairs:
                self.write(kind.of[0], self.key(kind.of[0], k), out)
                self.write(kind.of[1], x, out)
        else:
            out += struct.pack(">bi", self.code(kind.of[0]), len(v))
            for x in v:
                self.write(kind.of[0], x, out)

    def key(self, kind: Kind, text):
        """A map key from its string."""
        kind = self.schema.resolved(kind)
        if kind.name in ("list", "set", "map") or kind.name in self.schema.structs:
            raise ValueError(f"a {kind.name} can't be a map's key")
        if not isinstance(text, str) or kind.name in ("string", "binary") or kind.name in self.schema.enums:
            return text
        return text.lower() == "true" if kind.name == "bool" else float(text) if kind.name == "double" else int(text)


def key_text(v) -> str:
    return v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
