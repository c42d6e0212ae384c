"""Operators and functions of the expression language itself."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import types as T
from .library import _checked, _matches, fixed_notation
from .registry import Arg, register

B, I, U, D, S, Y, TS, DU, DYN = T.BOOL, T.INT, T.UINT, T.DOUBLE, T.STRING, T.BYTES, T.TIMESTAMP, T.DURATION, T.DYN
LIST, MAP = T.list_of(DYN), T.map_of(DYN, DYN)


def _bare(op, message: str = "integer overflow"):
    """Integer arithmetic that is null where it fails."""

    def build(*args: Arg):
        value = op(*(a.col for a in args))
        return value, {message: value.isNull()}, True

    return build


def _unsigned(value: Column):
    fits = value.between(F.lit(0), F.lit(str(2**64 - 1)).cast("decimal(20,0)"))
    return F.when(fits, value.try_cast("decimal(20,0)")), {"integer overflow": ~fits}


for _sign, _op, _try in (("+", lambda a, b: a + b, F.try_add), ("-", lambda a, b: a - b, F.try_subtract), ("*", lambda a, b: a * b, F.try_multiply)):
    register(_sign, (I, I), I, _bare(lambda a, b, f=_try: f(a.cast("bigint"), b.cast("bigint"))))
    register(_sign, (D, D), D, lambda a, b, op=_op: op(a.col, b.col))
    register(_sign, (U, U), U, lambda a, b, op=_op: _unsigned(op(a.col, b.col)))


def _quotient(a: Column, b: Column) -> Column:
    """Rounded towards zero; null where the divisor is 0 or 64 bits don't hold it.  The operands are written once."""
    fits = lambda x: (x["b"] != 0) & ((x["b"] != -1) | (x["a"] != -(2**63)))
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.when(fits(x), F.call_function("div", x["a"], x["b"]))), F.lit(0))


def _divided(a: Arg, b: Arg):
    if b.literal not in (None, 0, -1):  # nothing can fail
        return F.call_function("div", a.col, b.col)
    value = _quotient(a.col, b.col)
    return value, {"division by zero": b.col == 0, "integer overflow": value.isNull()}, True


register("/", (I, I), I, _divided)
register("/", (U, U), U, lambda a, b: (F.call_function("div", a.col, F.when(b.col != 0, b.col)).cast("decimal(20,0)") if b.literal is None else F.call_function("div", a.col, F.nullif(b.col, F.lit(0))).cast("decimal(20,0)"), {"division by zero": b.col == 0}))
register("%", (U, U), U, lambda a, b: (F.try_mod(a.col, b.col).cast("decimal(20,0)"), {"modulus by zero": b.col == 0}, True))
register("/", (D, D), D, lambda a, b: F.when(b.col != 0, F.try_divide(a.col, b.col)).when((a.col == 0) | F.isnan(a.col), F.lit(float("nan"))).otherwise(F.signum(a.col) * F.lit(float("inf"))))
register("%", (I, I), I, _bare(F.try_mod, "modulus by zero"))
register("-_", (I,), I, _bare(lambda a: F.try_subtract(F.lit(0).cast("bigint"), a)))
register("-_", (D,), D, lambda a: -a.col)
register("+", (S, S), S, lambda a, b: F.concat(a.col, b.col))
register("+", (Y, Y), Y, lambda a, b: F.concat(a.col, b.col))
register("+", (LIST, LIST), lambda given: T.carrier(given[0]), lambda a, b: F.concat(a.col, b.col))
register("+", (TS, DU), TS, lambda a, b: a.col + b.col)
register("+", (DU, TS), TS, lambda a, b: b.col + a.col)
register("+", (DU, DU), DU, lambda a, b: a.col + b.col)
register("-", (TS, TS), DU, lambda a, b: (a.col - b.col))
register("-", (TS, DU), TS, lambda a, b: a.col - b.col)
register("-", (DU, DU), DU, lambda a, b: a.col - b.col)
register("!_", (B,), B, lambda a: ~a.col)



def _compared(a: Arg, b: Arg, op, real: bool) -> Column:
    """Comparisons with NaN are false, where Spark sorts it last.  A literal needs no test, and a test that a
    side is at most infinite can be pushed to a scan."""
    out = op(a.col, b.col)
    for side in (a, b):
        if real and side.literal is None:
            out = out & (side.col <= F.lit(float("inf")))
    return out


for _kind in (I, U, D, S, Y, TS, DU, B):
    for _sign, _op in {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}.items():
        register(_sign, (_kind, _kind), B, lambda a, b, op=_op, real=_kind is D: _compared(a, b, op, real))


register("in", (DYN, LIST), B, lambda a, b: F.coalesce(F.array_contains(b.col, a.col), F.lit(False)))
register("in", (DYN, MAP), B, lambda a, b: F.map_contains_key(b.col, a.col))

for _member in (False, True):
    register("size", (S,), I, lambda a: F.char_length(a.col).cast("long"), member=_member)
    register("size", (Y,), I, lambda a: F.octet_length(a.col).cast("long"), member=_member)
    register("size", (LIST,), I, lambda a: F.size(a.col).cast("long"), member=_member)
    register("size", (MAP,), I, lambda a: F.size(a.col).cast("long"), member=_member)
    register("matches", (S, S), B, _matches, member=_member)
register("startsWith", (S, S), B, lambda a, b: F.startswith(a.col, b.col), member=True)
register("endsWith", (S, S), B, lambda a, b: F.endswith(a.col, b.col), member=True)
register("contains", (S, S), B, lambda a, b: F.contains(a.col, b.col), member=True)

# ---------------------------------------------------------------- conversions

_same = lambda a: a.col
for _kind in (I, U, D, S, Y, TS, DU, B):
    register({"bytes": "bytes", "timestamp": "timestamp", "duration": "duration"}.get(_kind.kind, _kind.kind), (_kind,), _kind, _same)
register("int", (S,), I, lambda a: _checked(F.when(a.col.rlike(r"^[+-]?[0-9]+\z"), a.col.try_cast("bigint")), "not an integer"))
register("int", (D,), I, lambda a: _checked(F.when(~F.isnan(a.col), a.col.try_cast("bigint")), "integer overflow"))
register("int", (U,), I, lambda a: _checked(a.col.try_cast("bigint"), "integer overflow"))
register("int", (TS,), I, lambda a: F.unix_seconds(a.col))
register("uint", (I,), U, lambda a: _checked(F.when(a.col >= 0, a.col.cast("decimal(20,0)")), "unsigned overflow"))
register("uint", (D,), U, lambda a: _checked(F.when((a.col >= 0) & (a.col < 2.0**64), F.floor(a.col).try_cast("decimal(20,0)")), "unsigned overflow"))
register("uint", (S,), U, lambda a: _checked(F.when(a.col.rlike(r"^[0-9]{1,20}\z"), a.col.try_cast("decimal(20,0)")), "not an unsigned integer"))
register("double", (I,), D, lambda a: a.col.cast("double"))
register("double", (U,), D, lambda a: a.col.cast("double"))
register("double", (S,), D, lambda a: _checked(F.when(a.col.rlike(r"^\S+\z"), a.col.try_cast("double")), "not a number"))
register("string", (I,), S, lambda a: a.col.cast("string"))
register("string", (U,), S, lambda a: a.col.cast("string"))
register("string", (D,), S, lambda a: fixed_notation(a.col))
register("string", (B,), S, lambda a: a.col.cast("string"))
register("string", (Y,), S, lambda a: (F.try_validate_utf8(a.col.cast("string")), {"invalid UTF-8": F.try_validate_utf8(a.col.cast("string")).isNull()}))
register("string", (TS,), S, lambda a: F.concat(F.date_format(a.col, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(a.col, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z")))
register("string", (DU,), S, lambda a: F.concat(F.regexp_replace((F.extract(F.lit("DAY"), a.col) * 86400 + F.extract(F.lit("HOUR"), a.col) * 3600 + F.extract(F.lit("MINUTE"), a.col) * 60 + F.extract(F.lit("SECOND"), a.col)).cast("string"), r"\.0+$", ""), F.lit("s")))
register("bytes", (S,), Y, lambda a: a.col.cast("binary"))
register("bool", (S,), B, lambda a: _checked(F.when(a.col.isin("1", "t", "T", "TRUE", "true", "True"), True).when(a.col.isin("0", "f", "F", "FALSE", "false", "False"), False), "not a boolean"))
register("timestamp", (S,), TS, lambda a: _checked(F.when(a.col.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)\z"), a.col.try_cast("timestamp")), "not a timestamp"))
register("timestamp", (I,), TS, lambda a: F.timestamp_seconds(a.col))
#: Units of durations in seconds.
_UNITS = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def _duration(a: Arg):
    if a.literal is None:
        raise TypeError("duration() needs a literal")
    m = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d+)?(?:h|ms|us|µs|ns|m|s))+)", a.literal)
    if not m:
        return F.expr("INTERVAL '0' SECOND"), {"not a duration": F.lit(True)}
    seconds = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(h|ms|us|µs|ns|m|s)", m[2])) * (-1 if m[1] == "-" else 1)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(round(seconds, 6)).cast("decimal(18,6)")), {}


register("duration", (S,), DU, _duration)
register("dyn", (DYN,), lambda given: T.dyn_of(T.carrier(given[0])), _same, strict=False)
register("type", (DYN,), T.TYPE, lambda a: F.lit(T.carrier(a.type).kind), strict=False)

# ---------------------------------------------------------------- parts of timestamps; months and days count from 0

_PARTS = {
    "getFullYear": F.year, "getMonth": lambda c: F.month(c) - 1, "getDate": F.dayofmonth, "getDayOfMonth": lambda c: F.dayofmonth(c) - 1, "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1, "getHours": F.hour, "getMinutes": F.minute, "getSeconds": F.second, "getMilliseconds": lambda c: F.pmod(F.unix_millis(c), F.lit(1000)),
}
for _name, _part in _PARTS.items():
    register(_name, (TS,), I, lambda a, part=_part: part(a.col).cast("long"), member=True)
    register(_name, (TS, S), I, lambda a, tz, part=_part: part(F.from_utc_timestamp(a.col, tz.col)).cast("long"), member=True)
for _name, _size in {"getHours": 3_600_000_000, "getMinutes": 60_000_000, "getSeconds": 1_000_000, "getMilliseconds": 1000}.items():
    register(_name, (DU,), I, lambda a, size=_size: F.call_function("div", F.unix_micros(F.timestamp_seconds(F.lit(0)) + a.col), F.lit(size).cast("bigint")), member=True)
