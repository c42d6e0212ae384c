"""Pipeline configuration: what a schema's ``x-pipeline`` declares, and whether it is sound."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

#: Field ids from here on are reserved for metadata columns.
FIRST_RESERVED_ID = 2147483447
TRANSFORMS = frozenset(("identity", "bucket", "truncate", "year", "month", "day", "hour", "void"))
KEY = "x-pipeline"


class ConfigError(ValueError):
    """All that is wrong with a configuration."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class ColumnSpec:
    """``field_id``: None where the table format is to give one; partitions and sort orders can't name such a column."""

    name: str
    expr: str
    field_id: int | None = None
    as_type: str | None = None


@dataclass(frozen=True)
class PartitionSpec:
    source_id: int
    field_id: int
    transform: str
    name: str
    param: int = 0


@dataclass(frozen=True)
class SortSpec:
    source_id: int
    direction: str = "asc"
    null_order: str = "nulls-first"
    transform: str = "identity"


@dataclass(frozen=True)
class PipelineConfig:
    columns: tuple[ColumnSpec, ...]
    validate: tuple[str, ...] = ()
    filter: str | None = None
    partition_spec: tuple[PartitionSpec, ...] = ()
    sort_order: tuple[SortSpec, ...] = ()
    schema_format: str | None = None
    schema_id: int = 0
    extra: dict[str, Any] = field(default_factory=dict, compare=False)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column_by_field_id(self, field_id: int) -> ColumnSpec | None:
        return next((c for c in self.columns if c.field_id == field_id), None)

    def column_index(self, name: str) -> int:
        """The place of a column, or -1."""
        return next((i for i, c in enumerate(self.columns) if c.name == name), -1)

    @property
    def has_validation(self) -> bool:
        return bool(self.validate)

    @property
    def has_filter(self) -> bool:
        return bool(self.filter)

    @property
    def has_partitions(self) -> bool:
        return bool(self.partition_spec)

    @property
    def has_sort_order(self) -> bool:
        return bool(self.sort_order)

    @property
    def is_json(self) -> bool:
        return (self.schema_format or "").lower() in ("json", "jsonschema", "json_schema")

    @property
    def is_avro(self) -> bool:
        return (self.schema_format or "").lower() == "avro"

    def check(self) -> None:
        """Raises ConfigError with every fault."""
        faults = []
        if self.schema_format and not self.is_json and not self.is_avro:
            faults.append(f"unknown schema format {self.schema_format!r}")
        if not self.columns:
            faults.append("at least one column is needed")
        names, ids = set(), set()
        for i, c in enumerate(self.columns):
            if not c.name:
                faults.append(f"columns[{i}]: empty name")
            elif c.name in names:
                faults.append(f"columns[{i}]: duplicate name {c.name!r}")
            if not c.expr:
                faults.append(f"columns[{i}]: empty expression")
            if c.field_id is None:
                pass
            elif not 0 < c.field_id < FIRST_RESERVED_ID:
                faults.append(f"columns[{i}]: field id {c.field_id} is out of range")
            elif c.field_id in ids:
                faults.append(f"columns[{i}]: duplicate field id {c.field_id}")
            names.add(c.name)
            if c.field_id is not None:
                ids.add(c.field_id)
        faults += [f"validate[{i}]: empty expression" for i, v in enumerate(self.validate) if not v]
        own = set()
        for i, p in enumerate(self.partition_spec):
            where = f"partition_spec[{i}]"
            if p.source_id not in ids:
                faults.append(f"{where}: no column with field id {p.source_id}")
            if p.transform not in TRANSFORMS:
                faults.append(f"{where}: unknown transform {p.transform!r}")
            if p.field_id <= 0:
                faults.append(f"{where}: field id {p.field_id} is not positive")
            elif p.field_id in own:
                faults.append(f"{where}: duplicate field id {p.field_id}")
            if not p.name:
                faults.append(f"{where}: empty name")
            own.add(p.field_id)
        for i, s in enumerate(self.sort_order):
            where = f"sort_order[{i}]"
            if s.source_id not in ids:
                faults.append(f"{where}: no column with field id {s.source_id}")
            if s.transform and s.transform not in TRANSFORMS:
                faults.append(f"{where}: unknown transform {s.transform!r}")
            elif s.transform in ("bucket", "truncate"):
                faults.append(f"{where}: {s.transform} has no parameter here")
            if s.direction not in ("asc", "desc"):
                faults.append(f"{where}: unknown direction {s.direction!r}")
            if s.null_order not in ("nulls-first", "nulls-last"):
                faults.append(f"{where}: unknown null order {s.null_order!r}")
        if faults:
            raise ConfigError(faults)


def from_dict(d: dict[str, Any]) -> PipelineConfig:
    known = {"columns", "validate", "filter", "partition_spec", "sort_order", "schema_format", "schema_id"}
    try:
        return PipelineConfig(
            tuple(ColumnSpec(c.get("name", ""), c.get("expr", ""), None if c.get("field_id") is None else int(c["field_id"]), c.get("as") or None) for c in d.get("columns") or ()),
            tuple(d.get("validate") or ()),
            d.get("filter") or None,
            tuple(PartitionSpec(int(p.get("source_id", 0)), int(p.get("field_id", 0)), p.get("transform", ""), p.get("name", ""), int(p.get("param") or 0)) for p in d.get("partition_spec") or ()),
            tuple(SortSpec(int(s.get("source_id", 0)), s.get("direction", "asc"), s.get("null_order", "nulls-first"), s.get("transform") or "identity") for s in d.get("sort_order") or ()),
            d.get("schema_format"),
            int(d.get("schema_id") or 0),
            {k: v for k, v in d.items() if k not in known},
        )
    except (AttributeError, TypeError) as e:
        raise ConfigError([f"malformed configuration: {e}"]) from e


def extract(schema_json: str) -> tuple[str, PipelineConfig | None]:
    """The schema without its pipeline, and the checked pipeline, or None if it has none."""
    try:
        schema = json.loads(schema_json)
    except json.JSONDecodeError as e:
        raise ConfigError([f"the schema is not JSON: {e}"]) from e
    if not isinstance(schema, dict) or KEY not in schema:
        return schema_json, None
    config = from_dict(schema.pop(KEY))
    config.check()
    return json.dumps(schema), config
