"""Thrift structs as Protocol Buffer messages."""

from __future__ import annotations

from google.protobuf import descriptor_pb2

from .proto_codec import FD, SCALARS
from .proto_codec import Codec as ProtoCodec
from .thrift_codec import Kind, Schema

SCALAR = {"bool": "bool", "byte": "int32", "i8": "int32", "i16": "int32", "i32": "int32", "i64": "int64", "double": "double", "string": "string", "binary": "bytes"}


def message_file(schema: Schema, name: str, nested: bool = True, extra: list[tuple[str, str]] = ()) -> descriptor_pb2.FileDescriptorProto:
    """The file that defines messages for a struct and those inside it.

    A field's number is its Thrift id + 1, enums are strings, a map is repeated entries {key = 1, value = 2}; extra
    (name, scalar) fields get the numbers after the next free one. Without `nested`, fields that hold structs or maps
    are left out.
    """
    out = descriptor_pb2.FileDescriptorProto(name="converted.proto", syntax="proto2")
    made: set[str] = set()

    def typed(f, kind: Kind) -> None:
        if kind.name in schema.enums:
            f.type = SCALARS["string"]
        elif kind.name in schema.structs:
            f.type, f.type_name = FD.TYPE_MESSAGE, f".{kind.name}"
            struct(kind.name)
        elif kind.name in SCALAR:
            f.type = SCALARS[SCALAR[kind.name]]
        else:
            raise ValueError(f"a {kind.name} within a list or map isn't converted")

    def held(kind: Kind) -> bool:
        kind = schema.resolved(kind)
        inner = schema.resolved(kind.of[0]) if kind.name in ("list", "set") else kind
        return inner.name in schema.structs or inner.name == "map"

    def struct(label: str, more=()) -> None:
        if label in made:
            return
        made.add(label)
        m = descriptor_pb2.DescriptorProto(name=label)
        fields = schema.structs[label]
        for field in fields:
            if not nested and held(field.kind):
                continue
            kind = schema.resolved(field.kind)
            f = m.field.add(name=field.name, number=field.number + 1)
            f.label = FD.LABEL_REPEATED if kind.name in ("list", "set", "map") else FD.LABEL_OPTIONAL
            if kind.name == "map":
                entry = m.nested_type.add(name=f"{field.name}_entry")
                for i, (n, k) in enumerate(zip(("key", "value"), kind.of), 1):
                    typed(entry.field.add(name=n, number=i, label=FD.LABEL_REQUIRED), schema.resolved(k))
                f.type, f.type_name = FD.TYPE_MESSAGE, f".{label}.{field.name}_entry"
            else:
                typed(f, schema.resolved(kind.of[0]) if kind.of else kind)
        top = max([0, *(x.number for x in fields)])
        for i, (n, kind) in enumerate(more):
            m.field.add(name=n, number=top + 2 + i, label=FD.LABEL_OPTIONAL, type=SCALARS[kind])
        out.message_type.append(m)

    struct(name, extra)
    return out


def to_message(schema: Schema, name: str, value: dict) -> dict:
    """A decoded struct's values as those of its message: maps become entries, unset fields stay unset."""
    if value is None:
        raise ValueError("no struct to convert")

    def one(kind: Kind, v):
        kind = schema.resolved(kind)
        if v is None:
            return None
        if kind.name in schema.structs:
            return to_message(schema, kind.name, v)
        if kind.name in ("list", "set"):
            return [one(kind.of[0], x) for x in v]
        if kind.name == "map":
            number = schema.resolved(kind.of[0]).name
            key = (lambda k: k == "true" or k == "1") if number == "bool" else float if number == "double" else int if number in ("byte", "i8", "i16", "i32", "i64") else str
            return [{"key": key(k), "value": one(kind.of[1], x)} for k, x in (v.items() if isinstance(v, dict) else v)]
        return v

    return {f.name: one(f.kind, value.get(f.name)) for f in schema.structs[name]}


def by_name(schema: Schema, name: str, codec: ProtoCodec) -> dict[str, str]:
    """Checks that a given message has each field of a flat struct under its name, with a type that holds it; name -> scalar."""
    fields = {f.name: f for f in codec.cls.DESCRIPTOR.fields}
    out = {}
    for field in schema.structs[name]:
        kind = schema.resolved(field.kind)
        many = kind.name in ("list", "set")
        inner = schema.resolved(kind.of[0]) if many else kind
        if inner.name in schema.structs or inner.of:
            raise ValueError(f"{field.name}: structs, maps and lists of lists aren't converted by name")
        scalar = "string" if inner.name in schema.enums else SCALAR[inner.name]
        f = fields.get(field.name)
        if f is None or f.is_repeated != many or f.type != SCALARS[scalar]:
            raise ValueError(f"the message has no {'repeated ' * many}{scalar} {field.name}")
        out[field.name] = scalar
    return out
