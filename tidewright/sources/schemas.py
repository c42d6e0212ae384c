"""Schemas of payloads: Avro and JSON Schema to the types of expressions, and what a JSON payload must hold."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..plans import types as T


class SchemaFault(ValueError):
    pass


@dataclass(frozen=True)
class Mapped:
    """``kind``: avro or json.  ``tree``: the parsed schema."""

    kind: str
    type: T.Type
    tree: Any = field(compare=False, default=None)

    @property
    def spark(self) -> S.DataType:
        return T.to_spark(self.type)


# ---------------------------------------------------------------- Avro

_AVRO = {"boolean": T.BOOL, "int": T.INT, "long": T.INT, "float": T.DOUBLE, "double": T.DOUBLE, "string": T.STRING, "bytes": T.BYTES, "null": T.NULL}
_LOGICAL = {
    "timestamp-millis": T.TIMESTAMP, "timestamp-micros": T.TIMESTAMP, "local-timestamp-millis": T.TIMESTAMP, "local-timestamp-micros": T.TIMESTAMP, "date": T.TIMESTAMP,
    "time-millis": T.DURATION, "time-micros": T.DURATION, "uuid": T.STRING, "decimal": T.STRING,
}


def avro_name(node: dict, space: str) -> str:
    name = node.get("name", "")
    return name if "." in name else f"{node.get('namespace', space)}.{name}".strip(".")


def map_avro(source: str | dict | list) -> Mapped:
    tree = json.loads(source) if isinstance(source, str) and source.strip()[:1] in "{[\"" else source
    named: dict[str, T.Type | None] = {}

    def walk(node: Any, space: str) -> T.Type:
        if isinstance(node, str):
            if node in _AVRO:
                return _AVRO[node]
            full = node if "." in node else f"{space}.{node}".strip(".")
            for n in (full, node):
                if n in named:
                    if named[n] is None:
                        raise SchemaFault(f"recursive type {n!r}")
                    return named[n]
            raise SchemaFault(f"unknown type {node!r}")
        if isinstance(node, list):
            rest = [x for x in node if x != "null"]
            if not rest:
                return T.NULL
            if len(rest) == 1:
                return walk(rest[0], space)
            for x in rest:
                walk(x, space)
            return T.DYN
        if not isinstance(node, dict):
            raise SchemaFault(f"not a type: {node!r}")
        kind = node.get("type")
        if node.get("logicalType") in _LOGICAL:
            if kind == "fixed":
                named[avro_name(node, space)] = _LOGICAL[node["logicalType"]]
            return _LOGICAL[node["logicalType"]]
        if kind == "record":
            full = avro_name(node, space)
            inner = full.rpartition(".")[0]
            named[full] = None
            out = T.object_of(full, {f["name"]: walk(f["type"], inner) for f in node.get("fields", [])})
            named[full] = out
            return out
        if kind in ("enum", "fixed"):
            named[avro_name(node, space)] = T.STRING if kind == "enum" else T.BYTES
            return named[avro_name(node, space)]
        if kind == "array":
            return T.list_of(walk(node["items"], space))
        if kind == "map":
            return T.map_of(T.STRING, walk(node["values"], space))
        return walk(kind, space)

    return Mapped("avro", walk(tree, ""), tree)


# ---------------------------------------------------------------- JSON Schema

_JSON = {"string": T.STRING, "integer": T.INT, "number": T.DOUBLE, "boolean": T.BOOL, "null": T.NULL}
_FORMATS = {"date-time": T.TIMESTAMP, "date": T.TIMESTAMP, "time": T.DURATION, "duration": T.DURATION, "byte": T.BYTES, "binary": T.BYTES}


def _of_value(v: Any) -> T.Type:
    if isinstance(v, bool):
        return T.BOOL
    if isinstance(v, int) or isinstance(v, float) and v.is_integer():
        return T.INT
    return T.DOUBLE if isinstance(v, float) else T.STRING if isinstance(v, str) else T.NULL if v is None else T.DYN


def map_json(source: str | dict, name: str = "Event") -> Mapped:
    tree = json.loads(source) if isinstance(source, str) else source
    open_refs: list[str] = []

    def target(ref: str) -> Any:
        for start in ("#/definitions/", "#/$defs/"):
            if ref.startswith(start):
                found = tree.get(start[2:-1], {}).get(ref[len(start) :])
                if found is not None:
                    return found
        raise SchemaFault(f"cannot resolve {ref!r}")

    def one_of(nodes: list, at: str) -> T.Type:
        kinds = [t for n in nodes if (t := walk(n, at)).kind != "null"]
        return T.NULL if not kinds else kinds[0] if len(kinds) == 1 else T.DYN

    def members(node: Any, at: str) -> dict[str, T.Type]:
        if "$ref" in node:
            node = target(node["$ref"])
        out: dict[str, T.Type] = {}
        for part in node.get("allOf", []):
            out |= members(part, at)
        return out | {k: walk(v, f"{at}.{k}") for k, v in node.get("properties", {}).items()}

    def walk(node: Any, at: str) -> T.Type:
        if isinstance(node, bool):
            return T.DYN
        if not isinstance(node, dict):
            raise SchemaFault(f"not a schema: {node!r}")
        if "$ref" in node:
            if node["$ref"] in open_refs:
                raise SchemaFault(f"recursive schema {node['$ref']!r}")
            open_refs.append(node["$ref"])
            out = walk(target(node["$ref"]), node["$ref"].rpartition("/")[2])
            open_refs.pop()
            return out
        if "allOf" in node:
            found = members(node, at)
            return T.object_of(node.get("title", at), found) if found else T.DYN
        if "anyOf" in node:
            return one_of(node["anyOf"], at)
        if "oneOf" in node:
            return one_of(node["oneOf"], at)
        if node.get("enum"):
            return _of_value(node["enum"][0])
        if "const" in node:
            return _of_value(node["const"])
        kind = node.get("type")
        if isinstance(kind, list):
            return one_of([{**node, "type": k} for k in kind], at)
        if kind is None:
            kind = "object" if "properties" in node or "additionalProperties" in node else "array" if "items" in node else None
        if kind == "string" and node.get("format") in _FORMATS:
            return _FORMATS[node["format"]]
        if kind in _JSON:
            return _JSON[kind]
        if kind == "array":
            return T.list_of(walk(node["items"], f"{at}.item") if isinstance(node.get("items"), dict) else T.DYN)
        if kind == "object":
            if node.get("properties"):
                return T.object_of(node.get("title", at), {k: walk(v, f"{at}.{k}") for k, v in node["properties"].items()})
            extra = node.get("additionalProperties")
            return T.map_of(T.STRING, walk(extra, f"{at}.value") if isinstance(extra, dict) else T.DYN)
        return T.DYN

    return Mapped("json", walk(tree, tree.get("title", name) if isinstance(tree, dict) else name), tree)


#: Keywords of JSON Schema that ``violations`` knows; others are refused, not ignored.
_CHECKED = frozenset("""type required enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern items minItems maxItems uniqueItems
    properties additionalProperties minProperties maxProperties allOf anyOf oneOf not if then else $ref""".split())
_SAID = frozenset("$schema $id title description default examples format definitions $defs $comment".split())

#: Of each type, how Spark names the type of a variant's value.
_NAMES = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>", "null": "VOID", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)"}
Tests = list[tuple[str, Column]]


class _Place:
    """A value inside a variant: ``root`` and the path from it; ``shown``: the path in messages."""

    def __init__(self, root: Column, path: str, shown: str):
        self.root, self.path, self.shown = root, path, shown

    def get(self, kind: str = "variant") -> Column:
        return F.try_variant_get(self.root, self.path, kind)

    def is_kind(self, kind: str) -> Column:
        if kind == "integer":
            value = self.get("double")
            return self.is_kind("number") & (value == F.floor(value))
        return F.schema_of_variant(self.get()).rlike(f"^(?:{_NAMES[kind]})$") if kind in _NAMES else F.lit(True)

    def equals(self, value: Any) -> Column:
        if isinstance(value, bool):
            return self.is_kind("boolean") & (self.get("boolean") == F.lit(value))
        if isinstance(value, int | float):
            return self.is_kind("number") & (self.get("double") == F.lit(float(value)))
        if isinstance(value, str):
            return self.is_kind("string") & (self.get("string") == F.lit(value))
        if value is None:
            return self.is_kind("null")
        return F.to_json(self.get()) == F.to_json(F.parse_json(F.lit(json.dumps(value))))

    def member(self, name: str) -> _Place:
        if "'" in name and '"' in name:
            raise SchemaFault(f"property {name!r} has both kinds of quotes")
        quote = '"' if "'" in name else "'"
        return _Place(self.root, f"{self.path}[{quote}{name}{quote}]", f"{self.shown}.{name}")


def violations(tree: dict, at: Callable[[], Column]) -> Column | None:
    """The first violation of the checked keywords by a payload, as text; null if there is none.

    ``at`` gives the payload as a variant, in which absent, null and wrongly typed values can be told apart.  As in JSON
    Schema, a keyword of one type says nothing about values of another."""

    def target(ref: str, open_refs: tuple[str, ...]) -> Any:
        if ref in open_refs:
            raise SchemaFault(f"recursive schema {ref!r}")
        found: Any = tree
        for part in ref.removeprefix("#").strip("/").split("/"):
            found = found.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(found, dict) and part else found
        if found is None or not ref.startswith("#"):
            raise SchemaFault(f"cannot resolve {ref!r}")
        return found

    def holds(node: Any, v: _Place, refs: tuple[str, ...]) -> Column:
        tests = walk(node, v, refs)
        return ~reduce(or_, [t for _, t in tests]) if tests else F.lit(True)

    def walk(node: Any, v: _Place, refs: tuple[str, ...] = ()) -> Tests:
        if node is True or node == {}:
            return []
        present = v.get().isNotNull()
        if node is False:
            return [(f"{v.shown}: not allowed", present)]
        if not isinstance(node, dict):
            raise SchemaFault(f"not a schema: {node!r}")
        for k in node:
            if k not in _CHECKED and k not in _SAID and k != "x-pipeline":
                raise SchemaFault(f"keyword {k!r} at {v.shown} is not supported")
        tests: Tests = []
        more = lambda what, test: tests.append((f"{v.shown}: {what}", present & F.coalesce(test, F.lit(False))))
        if "$ref" in node:
            tests += walk(target(node["$ref"], refs), v, (*refs, node["$ref"]))
        if "type" in node:
            kinds = node["type"] if isinstance(node["type"], list) else [node["type"]]
            more(f"not of type {'/'.join(kinds)}", ~reduce(or_, [F.coalesce(v.is_kind(k), F.lit(False)) for k in kinds]))
        if "enum" in node or "const" in node:
            more("not an allowed value", ~reduce(or_, [F.coalesce(v.equals(x), F.lit(False)) for x in node.get("enum", [node.get("const")])], F.lit(False)))
        number = lambda: F.when(v.is_kind("number"), v.get("double"))
        for k, test in {"minimum": lambda n, x: n < x, "maximum": lambda n, x: n > x, "exclusiveMinimum": lambda n, x: n <= x, "exclusiveMaximum": lambda n, x: n >= x, "multipleOf": lambda n, x: F.abs(n / x - F.round(n / x)) > 1e-9}.items():
            if isinstance(node.get(k), int | float) and not isinstance(node[k], bool):
                more(k, test(number(), F.lit(float(node[k]))))
        text = lambda: F.when(v.is_kind("string"), v.get("string"))
        if "minLength" in node:
            more("minLength", F.length(text()) < node["minLength"])
        if "maxLength" in node:
            more("maxLength", F.length(text()) > node["maxLength"])
        if "pattern" in node:
            more("pattern", ~text().rlike(node["pattern"]))
        items = v.get("array<variant>")
        if "minItems" in node:
            more("minItems", F.size(items) < node["minItems"])
        if "maxItems" in node:
            more("maxItems", F.size(items) > node["maxItems"])
        if node.get("uniqueItems"):
            told = F.transform(items, lambda x: F.to_json(x))
            more("uniqueItems", F.size(F.array_distinct(told)) < F.size(told))
        if isinstance(node.get("items"), list):
            raise SchemaFault(f"items as a list at {v.shown} is not supported")
        if "items" in node and walk(node["items"], _Place(v.root, v.path, f"{v.shown}[]"), refs):
            more("an item breaks its schema", F.exists(items, lambda x: ~holds(node["items"], _Place(x, "$", ""), refs)))
        is_object = lambda: v.is_kind("object")
        for name in node.get("required", []):
            more(f"{name} is missing", is_object() & v.member(name).get().isNull())
        declared = node.get("properties", {})
        for name, inner in declared.items():
            tests += walk(inner, v.member(name), refs)
        entries = lambda: F.map_entries(v.get("map<string,variant>"))
        extra = node.get("additionalProperties")
        other = lambda e: ~e["key"].isin(*declared) if declared else F.lit(True)
        if extra is False:
            more("an undeclared property", F.exists(entries(), other))
        elif isinstance(extra, dict) and extra:
            more("an undeclared property breaks its schema", F.exists(entries(), lambda e: other(e) & ~holds(extra, _Place(e["value"], "$", ""), refs)))
        if "minProperties" in node:
            more("minProperties", F.size(entries()) < node["minProperties"])
        if "maxProperties" in node:
            more("maxProperties", F.size(entries()) > node["maxProperties"])
        for part in node.get("allOf", []):
            tests += walk(part, v, refs)
        if "anyOf" in node:
            more("anyOf", ~reduce(or_, [holds(x, v, refs) for x in node["anyOf"]]))
        if "oneOf" in node:
            more("oneOf", reduce(add, [holds(x, v, refs).cast("int") for x in node["oneOf"]]) != 1)
        if "not" in node:
            more("not", holds(node["not"], v, refs))
        if "if" in node:
            test = holds(node["if"], v, refs)
            more("then", test & ~holds(node.get("then", True), v, refs))
            more("else", ~test & ~holds(node.get("else", True), v, refs))
        return tests

    tests = walk(tree, _Place(at(), "$", "$"))
    out = None
    for message, test in tests:
        out = F.when(test, F.lit(message)) if out is None else out.when(test, F.lit(message))
    return out
