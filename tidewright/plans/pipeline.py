"""Compiled pipelines: validate, filter, project, and where each row ended.

Two ways to run one.  ``ok_rows`` keeps only rows that pass, with one plain filter for each condition, so
that scans can use them.  ``classify`` keeps every row with its status, and where and why it left.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..operators import partitioning
from . import types as T
from .compiler import CheckFault, Scope, SyntaxFault, Value, compile_expression
from .config import ColumnSpec, ConfigError, PipelineConfig

#: The columns beside the event that expressions may name.
ENVELOPE = {"_event_id": T.BYTES, "_event_type": T.STRING, "_occurred_at": T.TIMESTAMP, "_ingested_at": T.TIMESTAMP, "_schema_id": T.INT, "_lsn": T.INT}
OK, FILTERED, REJECTED, ERROR = "ok", "filtered", "rejected", "error"


class CompileError(ConfigError):
    """Every expression that doesn't compile, with its place."""


class RowFault(Exception):
    """Base of the typed reasons why a row left; ``of`` makes one from a classified row."""

    def __init__(self, location: str, message: str):
        super().__init__(f"{location}: {message}")
        self.location, self.message = location, message

    @staticmethod
    def of(status: str, location: str | None, message: str | None) -> RowFault | None:
        if status in (OK, FILTERED) or location is None:
            return None
        kind = ValidationFault if location.startswith("validate") else FilterFault if location == "filter" else ColumnFault
        return kind(location, message or "")


class ValidationFault(RowFault):
    @property
    def index(self) -> int:
        return int(self.location[self.location.index("[") + 1 : -1])


class FilterFault(RowFault):
    pass


class ColumnFault(ValidationFault):
    pass


@dataclass(frozen=True)
class Output:
    spec: ColumnSpec
    value: Column
    err: Column | None
    spark: S.DataType
    iceberg: str
    required: bool


@dataclass(frozen=True)
class Pipeline:
    config: PipelineConfig
    validations: tuple[Value, ...]
    condition: Value | None
    outputs: tuple[Output, ...]

    @property
    def column_names(self) -> list[str]:
        return [o.spec.name for o in self.outputs]

    def column(self, name: str) -> Output | None:
        return next((o for o in self.outputs if o.spec.name == name), None)

    @property
    def partition_columns(self) -> list[str]:
        """The source column of each partition field."""
        return [self.config.column_by_field_id(p.source_id).name for p in self.config.partition_spec]

    @property
    def sort_columns(self) -> list[str]:
        return [self.config.column_by_field_id(s.source_id).name for s in self.config.sort_order]

    # ------------------------------------------------------------ schema

    def iceberg_schema(self) -> str:
        """Columns without a field id have none here either; the table format gives it."""
        fields = [{**({} if o.spec.field_id is None else {"id": o.spec.field_id}), "name": o.spec.name, "required": o.required, "type": o.iceberg} for o in self.outputs]
        return json.dumps({"type": "struct", "schema-id": self.config.schema_id, "fields": fields})

    def schema(self) -> S.StructType:
        """Always nullable physically; what is required is in the metadata."""
        parts, sorts = set(self.partition_columns), {n: s for n, s in zip(self.sort_columns, self.config.sort_order, strict=True)}
        fields = []
        for o in self.outputs:
            about = {"required": o.required, "iceberg.type": o.iceberg}
            if o.spec.field_id is not None:
                about["parquet.field.id"] = o.spec.field_id
            if o.spec.name in parts:
                about["partition"] = True
            if s := sorts.get(o.spec.name):
                about["sort"] = f"{s.direction} {s.null_order}"
            fields.append(S.StructField(o.spec.name, o.spark, True, about))
        return S.StructType(fields)

    def _projected(self, row: bool = False) -> list[Column]:
        about = {f.name: f.metadata for f in self.schema().fields}
        return [o.value.alias(o.spec.name, metadata=about[o.spec.name]) for o in self.outputs]

    # ------------------------------------------------------------ running

    def ok_rows(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Rows that pass, projected. ``keep``: input columns to carry along."""
        for v in (*self.validations, *([self.condition] if self.condition else [])):
            df = df.where(v.test)
        errors = [o.err for o in self.outputs if o.err is not None]
        for e in errors:
            df = df.where(e.isNull())
        return df.select(*[F.col(f"`{k}`") for k in keep], *self._projected())

    def status(self) -> Column:
        """A struct of status, location and error; the first of them in the order of evaluation."""
        none = F.lit(None).cast("string")
        struct = lambda status, location, err: F.struct(F.lit(status).alias("status"), F.lit(location).alias("location"), err.cast("string").alias("error"))
        steps: list[tuple[Column, Column]] = []

        def condition(v: Value, where: str, failed: str, message: str | None) -> None:
            if v.err is not None:
                steps.append((v.err.isNotNull(), struct(ERROR, where, v.err)))
            if v.nullable:
                steps.append((v.col.isNull(), struct(ERROR, where, F.lit("not a boolean"))))
            steps.append((~v.col, struct(failed, where, none if message is None else F.lit(message))))

        for i, v in enumerate(self.validations):
            condition(v, f"validate[{i}]", REJECTED, f"validation failed: {self.config.validate[i]}")
        if self.condition is not None:
            condition(self.condition, "filter", FILTERED, None)
        for i, o in enumerate(self.outputs):
            if o.err is not None:
                steps.append((o.err.isNotNull(), struct(ERROR, f"columns[{i}]", o.err)))
        out = None
        for test, result in steps:
            out = F.when(test, result) if out is None else out.when(test, result)
        fine = F.struct(F.lit(OK).alias("status"), none.alias("location"), none.alias("error"))
        return fine if out is None else out.otherwise(fine)

    def classify(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Every row: kept input columns, the projected columns (null unless the row is ok), and
        ``_status``, ``_location`` and ``_error``."""
        held = "__status"
        names = {f.name: f.metadata for f in self.schema().fields}
        cells = [F.when(F.col(f"{held}.status") == OK, o.value).alias(o.spec.name, metadata=names[o.spec.name]) for o in self.outputs]
        return df.withColumn(held, self.status()).select(*[F.col(f"`{k}`") for k in keep], *cells, F.col(f"{held}.status").alias("_status"), F.col(f"{held}.location").alias("_location"), F.col(f"{held}.error").alias("_error"))

    def partition_values(self) -> list[tuple[str, Column, Column]]:
        """Name, path text and internal value of each partition field, over projected columns."""
        types = {o.spec.name: o.spark for o in self.outputs}
        return [(p.name, *partitioning.transform(p.transform, F.col(f"`{name}`"), types[name], p.param)) for p, name in zip(self.config.partition_spec, self.partition_columns, strict=True)]

    def sort_keys(self) -> list[Column]:
        types, out = {o.spec.name: o.spark for o in self.outputs}, []
        for s, name in zip(self.config.sort_order, self.sort_columns, strict=True):
            col = F.col(f"`{name}`") if s.transform == "identity" else partitioning.transform(s.transform, F.col(f"`{name}`"), types[name], 0)[1]
            out.append(getattr(col, f"{s.direction}_{s.null_order.replace('-', '_')}")())
        return out


def counters(classified: DataFrame) -> DataFrame:
    """One row: rows by status, their sum, and whether any was rejected or an error."""
    is_ = lambda s: F.count_if(F.col("_status") == s)
    one = classified.agg(is_(OK).alias("ok"), is_(FILTERED).alias("filtered"), is_(REJECTED).alias("rejected"), is_(ERROR).alias("error"), F.count(F.lit(1)).alias("total"))
    return one.withColumn("has_errors", F.col("rejected") + F.col("error") > 0)


def _json_text(value: Column, t: T.Type) -> Column:
    """What columns of type dyn and objects are stored as."""
    kind = T.carrier(t).kind
    if kind == "string" or kind == "dyn":
        return value.cast("string")
    if kind in ("list", "map", "object"):
        return F.to_json(value)
    return value.cast("string")


def output(spec: ColumnSpec, v: Value) -> Output:
    if spec.as_type:
        spark, iceberg = T.output_type(spec.as_type)
        source = T.carrier(v.type)
        value, problem = v.col, None
        if iceberg == "uuid":
            value = F.unhex(F.replace(value, F.lit("-"), F.lit(""))) if source.kind == "string" else value.try_cast("binary")
            problem = F.octet_length(value) != 16
        elif iceberg == "time":  # microseconds of the day
            value = F.pmod(F.unix_micros(value.cast("timestamp")), F.lit(86_400_000_000)) if source.kind == "timestamp" else value.try_cast("bigint")
        elif iceberg == "binary" and source.kind == "string":
            value = value.cast("binary")
        elif source.kind in ("list", "map", "object") and isinstance(spark, S.StringType):
            value = F.to_json(value)
        else:
            value = value.try_cast(spark)
        bad = v.col.isNotNull() & (value.isNull() if problem is None else value.isNull() | problem)
        sure = T.to_spark(source) == spark
        err = v.err if sure else F.coalesce(*([v.err] if v.err is not None else []), F.when(bad, F.lit(f"cannot be stored as {spec.as_type}")))
        return Output(spec, value, err, spark, iceberg, source.kind not in ("null",) and v.type.kind != "dyn")
    spark, iceberg, optional = T.inferred_output(v.type)
    value = _json_text(v.col, v.type) if v.type.kind in ("dyn", "object") else v.col
    if v.type.kind == "null":
        value = v.col.cast("string")
        spark = S.StringType()
    return Output(spec, value, v.err, spark, iceberg, not optional)


def scope_of(event: T.Type, envelope: dict[str, T.Type] | None = None, event_name: str = "event", column: str | None = None) -> Scope:
    """The variables: the envelope first, and the event last, so that nothing can stand in its way."""
    scope: Scope = {n: Value(F.col(f"`{n}`"), t, None, True) for n, t in (ENVELOPE if envelope is None else envelope).items()}
    scope[event_name] = Value(F.col(f"`{column or event_name}`"), event, None, True)
    return scope


def scope_of_frame(df: DataFrame, event_name: str = "event") -> Scope:
    """For a table whose columns are the fields of the event; struct access is resolved to plain columns."""
    t = T.from_spark(df.schema, event_name)
    fields = [F.col(f"`{f.name}`").cast("timestamp").alias(f.name) if isinstance(f.dataType, S.TimestampNTZType | S.DateType) else F.col(f"`{f.name}`").cast(T.to_spark(T.from_spark(f.dataType, f.name))).alias(f.name) if isinstance(f.dataType, S.IntegerType | S.ShortType | S.ByteType | S.FloatType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return {event_name: Value(F.struct(*fields), t, None, False)}


def compile_pipeline(config: PipelineConfig, scope: Scope) -> Pipeline:
    """Checks all expressions and reports all faults together."""
    config.check()
    faults: list[str] = []

    def one(source: str, where: str, want: T.Type | None) -> Value | None:
        try:
            return compile_expression(source, scope, want)
        except (CheckFault, SyntaxFault) as e:
            faults.append(f"{where}: {e}")
        return None

    validations = [one(v, f"validate[{i}]", T.BOOL) for i, v in enumerate(config.validate)]
    condition = one(config.filter, "filter", T.BOOL) if config.filter else None
    outputs = []
    for i, c in enumerate(config.columns):
        if (v := one(c.expr, f"columns[{i}]", None)) is not None:
            try:
                outputs.append(output(c, v))
            except ValueError as e:
                faults.append(f"columns[{i}]: {e}")
    if faults:
        raise CompileError(faults)
    return Pipeline(config, tuple(validations), condition, tuple(outputs))
