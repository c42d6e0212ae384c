"""Schemas by id, each with its compiled pipeline.  Ids are immutable.  The table is kept as JSON lines in a
folder that Spark can write, and read back and compiled when an id is first asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..plans import config
from ..plans.pipeline import Pipeline, compile_pipeline, scope_of
from .schemas import Mapped, SchemaFault, map_avro, map_json

AVRO, JSON = "avro", "json"


class SchemaExists(ValueError):
    pass


class SchemaNotFound(KeyError):
    pass


@dataclass(frozen=True)
class Registered:
    schema_id: int
    kind: str
    source: str
    mapped: Mapped
    pipeline: Pipeline | None


def prepare(schema_id: int, kind: str | None, schema_json: str) -> Registered:
    """Splits off the pipeline, maps the schema and compiles; ``kind`` None: JSON Schema is tried, then Avro."""
    cleaned, declared = config.extract(schema_json)
    kind = kind or (None if declared is None else AVRO if declared.is_avro else JSON if declared.is_json else None)
    if kind is None:
        try:
            mapped = map_json(cleaned)
            kind = JSON if mapped.type.kind in ("object", "map") and ("properties" in mapped.tree or mapped.tree.get("type") == "object") else AVRO
        except (SchemaFault, AttributeError, TypeError):
            kind = AVRO
    if kind not in (AVRO, JSON):
        raise SchemaFault(f"unknown kind of schema {kind!r}")
    mapped = map_avro(cleaned) if kind == AVRO else map_json(cleaned)
    pipeline = None if declared is None else compile_pipeline(declared, scope_of(mapped.type))
    return Registered(schema_id, kind, schema_json, mapped, pipeline)


class Registry:
    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        self.spark, self.folder, self.cache, self.stored = spark, folder, {}, {}
        if folder is not None and spark is not None:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
                self.stored = {r["schema_id"]: (r["kind"], r["source"]) for r in spark.read.schema("schema_id long, kind string, source string").json(folder).collect()}

    def register(self, schema_id: int, kind: str | None, schema_json: str) -> Registered:
        if schema_id in self.cache or schema_id in self.stored:
            raise SchemaExists(f"schema {schema_id} exists")
        made = prepare(schema_id, kind, schema_json)
        if self.folder is not None and self.spark is not None:
            self.spark.createDataFrame([(schema_id, made.kind, schema_json)], "schema_id long, kind string, source string").coalesce(1).write.mode("append").json(self.folder)
        self.cache[schema_id] = made
        return made

    def get(self, schema_id: int) -> Registered:
        if schema_id not in self.cache:
            if schema_id not in self.stored:
                raise SchemaNotFound(schema_id)
            self.cache[schema_id] = prepare(schema_id, *self.stored[schema_id])
        return self.cache[schema_id]

    def ids(self) -> list[int]:
        return sorted({*self.cache, *self.stored})
