"""Payloads by schema id to events: JSON in the JVM, Avro by the Arrow decoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import avro
from .registry import AVRO, Registered, Registry
from .schemas import Mapped, violations


def json_event(payload: Column, schema: Mapped, strict: bool = True) -> tuple[Column, Column]:
    """The event, and why there is none.  ``strict``: the payload must satisfy the schema, not only parse."""
    text = F.try_validate_utf8(payload.cast("string"))
    parsed = F.try_parse_json(text)
    problem = F.when(text.isNull() | parsed.isNull(), F.lit("decoding failed: invalid JSON"))
    if strict:
        bad = violations(schema.tree, lambda: parsed)
        if bad is not None:
            problem = F.coalesce(problem, F.concat(F.lit("decoding failed: "), bad))
    event = F.from_json(text, schema.spark, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd['T'HH:mm:ss[.SSSSSS][.SSS][XXX]]"})
    return F.when(problem.isNull(), event), problem


def decode(df: DataFrame, schema: Registered, payload: str = "payload", strict: bool = True) -> DataFrame:
    """Adds ``event`` and ``_decode_error``."""
    if schema.kind == AVRO:
        both = avro.decoder(schema.source if schema.pipeline is None else _clean(schema.source))(F.col(f"`{payload}`"))
        return df.withColumn("__d", both).withColumns({"event": F.col("__d.event"), "_decode_error": F.col("__d.error")}).drop("__d")
    event, problem = json_event(F.col(f"`{payload}`"), schema.mapped, strict)
    return df.withColumns({"event": event, "_decode_error": problem})


def _clean(source: str) -> str:
    from ..plans.config import extract

    return extract(source)[0]


def by_schema(df: DataFrame, registry: Registry, payload: str = "payload", schema_id: str = "_schema_id") -> dict[int, DataFrame]:
    """The rows of each registered schema, decoded; those of unknown ids are under -1 with an error."""
    out = {i: decode(df.where(F.col(schema_id) == i), registry.get(i), payload) for i in registry.ids()}
    known = [F.lit(i) for i in registry.ids()]
    unknown = F.col(schema_id).isNull() | ~F.col(schema_id).isin(*known) if known else F.lit(True)
    out[-1] = df.where(unknown).withColumn("_decode_error", F.concat(F.lit("unknown schema "), F.coalesce(F.col(schema_id).cast("string"), F.lit("null"))))
    return out


def as_variant(df: DataFrame, registry: Registry, payload: str = "payload", schema_id: str = "_schema_id") -> DataFrame:
    """All rows with ``event`` as JSON text, whatever their schema."""
    out = None
    for part in by_schema(df, registry, payload, schema_id).values():
        text = part.withColumn("event", F.to_json("event") if "event" in part.columns else F.lit(None).cast("string"))
        out = text if out is None else out.unionByName(text, allowMissingColumns=True)
    return out
