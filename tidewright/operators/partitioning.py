"""Partition transforms, each with the text for a path and the internal value; paths and tuples.

The hash of a bucket is 32-bit Murmur3 with seed 0 over a long's eight bytes, or over the bytes of strings.
Spark's own hash has another seed, and mixes the last bytes of strings in its own way: numbers go through
``hash`` after an integer that its seed turns into 0, strings go through a column expression for whole words
and, where the length is not a multiple of 4, an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: An integer whose hash with Spark's own seed is 0.
SEED_ZERO_32 = -1693959553
_NONE = "string"


def hash_long(col: Column) -> Column:
    return F.hash(F.lit(SEED_ZERO_32), col.cast("bigint"))


def murmur3_32(values: list[bytes | None]) -> np.ndarray:
    """Murmur3 (x86, 32 bits, seed 0) of many byte strings, by length, as signed integers; 0 for None."""
    out = np.zeros(len(values), np.uint32)
    lengths = np.array([-1 if v is None else len(v) for v in values])
    m = lambda x: np.uint32(x)
    rot = lambda x, r: (x << m(r)) | (x >> m(32 - r))
    scramble = lambda k: rot(k * m(0xCC9E2D51), 15) * m(0x1B873593)
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join(values[i] for i in rows), np.uint8).reshape(len(rows), n)
        h = np.zeros(len(rows), np.uint32)
        whole = n // 4 * 4
        for word in np.ascontiguousarray(raw[:, :whole]).view("<u4").T if whole else ():
            h = rot(h ^ scramble(word.astype(np.uint32)), 13) * m(5) + m(0xE6546B64)
        if n > whole:
            tail = np.zeros(len(rows), np.uint32)
            for j in range(n - whole):
                tail |= raw[:, whole + j].astype(np.uint32) << m(8 * j)
            h ^= scramble(tail)
        h ^= m(n)
        h = (h ^ (h >> m(16))) * m(0x85EBCA6B)
        h = (h ^ (h >> m(13))) * m(0xC2B2AE35)
        out[rows] = h ^ (h >> m(16))
    return out.view(np.int32)


@F.pandas_udf(S.IntegerType())
def _murmur_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series(murmur3_32([None if v is None else bytes(v) for v in s]))


def hash_bytes(col: Column) -> Column:
    raw = col.cast("binary")
    return F.when(raw.isNotNull(), _murmur_bytes(raw))


def _bucket_hash(col: Column, kind: S.DataType) -> Column:
    if isinstance(kind, S.StringType | S.BinaryType):
        return hash_bytes(col)
    if isinstance(kind, S.TimestampType | S.TimestampNTZType):
        return hash_long(F.unix_micros(col.cast("timestamp")))
    if isinstance(kind, S.DateType):
        return hash_long(F.unix_date(col))
    if isinstance(kind, S.FloatType | S.DoubleType):
        # Spark hashes a double by its bits, with -0.0 as 0.0 and one NaN.
        return F.hash(F.lit(SEED_ZERO_32), F.when(F.isnan(col), F.lit(float("nan"))).otherwise(col.cast("double") + F.lit(0.0)))
    if isinstance(kind, S.BooleanType | S.IntegralType):
        return hash_long(col.cast("int") if isinstance(kind, S.BooleanType) else col)
    return hash_bytes(col.cast("string"))


def bucket(col: Column, kind: S.DataType, n: int) -> Column:
    return F.when(col.isNotNull(), F.pmod(_bucket_hash(col, kind).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(max(1, n))).cast("int"))


def truncate(col: Column, kind: S.DataType, width: int) -> Column:
    width = max(1, width)
    if isinstance(kind, S.IntegralType):
        return col - F.pmod(col, F.lit(width).cast(kind))
    return F.left(col if isinstance(kind, S.StringType) else col.cast("string"), F.lit(width))


#: Up to which integers count seconds and milliseconds; beyond, microseconds.
_SECONDS_BELOW, _MILLIS_BELOW = 100_000_000_000, 100_000_000_000_000


def as_time(col: Column, kind: S.DataType) -> Column:
    """The moment that a value stands for, in UTC; null where it stands for none."""
    if isinstance(kind, S.TimestampType | S.TimestampNTZType | S.DateType):
        return col.cast("timestamp")
    if isinstance(kind, S.LongType):
        return F.when(col < _SECONDS_BELOW, F.timestamp_seconds(col)).when(col < _MILLIS_BELOW, F.timestamp_millis(col)).otherwise(F.timestamp_micros(col))
    if isinstance(kind, S.DoubleType):
        # Seconds; null only where microseconds of 64 bits can't hold them.
        return F.timestamp_seconds(F.when(~F.isnan(col) & (F.abs(col) < 9.2e12), col))
    if isinstance(kind, S.StringType):
        shape = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d:\d\d(?:\.\d{1,9})?(?:Z|[+-]\d\d:\d\d)?)?$"
        return F.when(col.rlike(shape), col.try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def _micros(col: Column) -> Column:
    return F.unix_micros(col)


def _floor(col: Column, size: int) -> Column:
    """Division that rounds down, as times before 1970 need."""
    return F.call_function("div", col - F.pmod(col, F.lit(size)), F.lit(size).cast("bigint"))


def transform(name: str, col: Column, kind: S.DataType, param: int) -> tuple[Column, Column]:
    """The text for a path (empty where there is none) and the internal value.  Unknown names: identity."""
    if name == "void":
        return F.lit(""), F.lit(None).cast(_NONE)
    if name == "bucket":
        value = bucket(col, kind, param)
        return F.coalesce(value.cast("string"), F.lit("")), value
    if name == "truncate":
        value = truncate(col, kind, param)
        return F.coalesce(value.cast("string"), F.lit("")), value
    if name in ("year", "month", "day", "hour"):
        t = as_time(col, kind)
        text = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}[name]
        years = F.year(t) - 1970
        value = {"year": years, "month": years * 12 + F.month(t) - 1, "day": F.unix_date(t.cast("date")), "hour": _floor(_micros(t), 3_600_000_000).cast("int")}[name]
        return F.coalesce(F.date_format(t, text), F.lit("")), value
    shown = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'") if isinstance(kind, S.TimestampType | S.TimestampNTZType) else F.lower(F.hex(col)) if isinstance(kind, S.BinaryType) else col.cast("string")
    return F.coalesce(shown, F.lit("")), col


#: Characters that a path can't hold, and what stands for them; the percent sign comes first.
ESCAPES = (("%", "%25"), ("/", "%2F"), ("=", "%3D"), ("\n", "%0A"), ("\r", "%0D"), ("\t", "%09"))


def escape(text: Column) -> Column:
    for c, code in ESCAPES:
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def path(parts: list[tuple[str, Column, Column]]) -> Column:
    """``name=value/…`` without the fields whose text is empty."""
    return F.concat_ws("/", *[F.when(text != "", F.concat(F.lit(f"{name}="), escape(text))) for name, text, _ in parts])


def tuple_of(parts: list[tuple[str, Column, Column]]) -> Column:
    """A struct of the internal values; void fields are null."""
    return F.struct(*[value.alias(name) for name, _, value in parts])
