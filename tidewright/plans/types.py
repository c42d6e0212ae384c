"""Static types of the expression language, and their Spark forms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as S


@dataclass(frozen=True)
class Type:
    """``args``: of lists and maps; of dyn, the type that its values are known to have, if any.
    ``fields``: of objects."""

    kind: str
    args: tuple[Type, ...] = ()
    name: str = ""
    fields: tuple[tuple[str, Type], ...] = field(default=(), compare=False)

    def __str__(self) -> str:
        if self.kind == "object":
            return self.name or "object"
        return f"{self.kind}({', '.join(map(str, self.args))})" if self.args and self.kind != "dyn" else self.kind

    def field_type(self, name: str) -> Type | None:
        return dict(self.fields).get(name)


BOOL, INT, UINT, DOUBLE, STRING, BYTES, TIMESTAMP, DURATION, NULL, DYN, TYPE = (Type(k) for k in ("bool", "int", "uint", "double", "string", "bytes", "timestamp", "duration", "null", "dyn", "type"))


def list_of(t: Type) -> Type:
    return Type("list", (t,))


def map_of(k: Type, v: Type) -> Type:
    return Type("map", (k, v))


def dyn_of(t: Type | None) -> Type:
    return DYN if t is None or t.kind == "dyn" and not t.args else t if t.kind == "dyn" else Type("dyn", (t,))


def carrier(t: Type) -> Type:
    """What a value of this type is at run time, as far as it is known."""
    return carrier(t.args[0]) if t.kind == "dyn" and t.args else t


def object_of(name: str, fields: dict[str, Type]) -> Type:
    return Type("object", (), name, tuple(fields.items()))


_PLAIN = {"bool": S.BooleanType(), "int": S.LongType(), "uint": S.DecimalType(20, 0), "double": S.DoubleType(), "string": S.StringType(), "bytes": S.BinaryType(), "timestamp": S.TimestampType(), "duration": S.DayTimeIntervalType(), "null": S.NullType(), "dyn": S.StringType(), "type": S.StringType()}


def to_spark(t: Type) -> S.DataType:
    """The Spark type that holds values of ``t`` while they are computed."""
    t = carrier(t)
    if t.kind == "list":
        return S.ArrayType(to_spark(t.args[0]))
    if t.kind == "map":
        return S.MapType(to_spark(t.args[0]), to_spark(t.args[1]))
    if t.kind == "object":
        return S.StructType([S.StructField(n, to_spark(f)) for n, f in t.fields])
    return _PLAIN[t.kind]


def from_spark(t: S.DataType, name: str = "") -> Type:
    """The type of a column that is already decoded."""
    if isinstance(t, S.StructType):
        return object_of(name or "object", {f.name: from_spark(f.dataType, f"{name}.{f.name}") for f in t.fields})
    if isinstance(t, S.ArrayType):
        return list_of(from_spark(t.elementType, name))
    if isinstance(t, S.MapType):
        return map_of(from_spark(t.keyType, name), from_spark(t.valueType, name))
    for kinds, out in (
        (S.BooleanType, BOOL), ((S.ByteType, S.ShortType, S.IntegerType, S.LongType), INT), ((S.FloatType, S.DoubleType), DOUBLE), (S.StringType, STRING), (S.BinaryType, BYTES),
        ((S.TimestampType, S.TimestampNTZType, S.DateType), TIMESTAMP), (S.DayTimeIntervalType, DURATION), (S.NullType, NULL), (S.DecimalType, STRING),
    ):
        if isinstance(t, kinds):
            return out
    return DYN


#: ``as`` names of output types and what they are in Iceberg.
_AS = {
    "boolean": (S.BooleanType(), "boolean"), "int": (S.IntegerType(), "int"), "long": (S.LongType(), "long"), "float": (S.FloatType(), "float"), "double": (S.DoubleType(), "double"),
    "string": (S.StringType(), "string"), "binary": (S.BinaryType(), "binary"), "date": (S.DateType(), "date"), "time": (S.LongType(), "time"),
    "timestamp": (S.TimestampNTZType(), "timestamp"), "timestamptz": (S.TimestampType(), "timestamptz"), "uuid": (S.BinaryType(), "uuid"),
}
_ALIASES = {"bool": "boolean", "int32": "int", "int64": "long", "float32": "float", "float64": "double", "bytes": "binary"}


def output_type(name: str) -> tuple[S.DataType, str]:
    """The Spark type and the Iceberg name of an ``as`` override; ValueError if there is no such type."""
    low = name.strip().lower()
    low = _ALIASES.get(low, low)
    if low in _AS:
        return _AS[low]
    if m := re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", low):
        p, s = int(m[1]), int(m[2])
        if 1 <= p <= 38 and 0 <= s <= p:
            return S.DecimalType(p, s), f"decimal({p},{s})"
    raise ValueError(f"invalid output type: {name!r}")


def inferred_output(t: Type) -> tuple[S.DataType, str, bool]:
    """Spark type, Iceberg name and nullability of a column without an override: dyn and objects become JSON text."""
    if t.kind in ("dyn", "object", "type"):
        return S.StringType(), "string", t.kind == "dyn"
    if t.kind == "list":
        inner, name, _ = inferred_output(t.args[0])
        return S.ArrayType(inner), f"list<{name}>", False
    if t.kind == "map":
        (k, kn, _), (v, vn, _) = inferred_output(t.args[0]), inferred_output(t.args[1])
        return S.MapType(k, v), f"map<{kn}, {vn}>", False
    names = {"bool": "boolean", "int": "long", "uint": "long", "double": "double", "string": "string", "bytes": "binary", "timestamp": "timestamptz", "duration": "long", "null": "string"}
    return _PLAIN[t.kind], names[t.kind], t.kind == "null"
