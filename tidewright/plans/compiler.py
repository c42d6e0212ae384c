"""Checks expressions and turns them into Spark columns.

A checked expression is a pair: the value, and the reason why the row is an error (a nullable string; None
where there can be none).  Errors are data: nothing that is compiled here raises at run time.  A strict
function's error is that of its first argument that has one, else a null argument, else its own.  ``&&`` and
``||`` absorb an error on one side if the other side decides.  A conditional has the error of the branch taken.

Values are null where there is an error, so that a condition can be used in a filter as it is.  Functions whose
value is null by itself there need no test for it, and arguments that are errors deep down are evaluated once, so that
an expression's columns grow with its length and not with a power of its depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import library, standard  # noqa: F401  they register the functions
from ..functions.registry import REGISTRY, Arg, resolve
from . import types as T
from .syntax import Call, Entries, Field, Index, Items, Literal, Name, SyntaxFault, parse


class CheckFault(ValueError):
    """An expression that has no type."""


@dataclass(frozen=True)
class Value:
    """``nullable``: the column may be null without being an error.  ``literal``: of literals.  ``plain``: of
    conditions, a column that is true where the value is, and false or null elsewhere; scans can use more of these.
    ``depth``: how many functions, other than arithmetic of integers, stand in one another.
    ``tail``: if the last of the errors is just that the value is null, its message and the errors before it."""

    col: Column
    type: T.Type
    err: Column | None = None
    nullable: bool = True
    literal: Any = None
    plain: Column | None = None
    depth: int = 0
    tail: tuple[str, Column | None] | None = None

    @property
    def test(self) -> Column:
        return self.col if self.plain is None else self.plain

    def guarded(self) -> Value:
        return self if self.err is None else Value(F.when(self.err.isNull(), self.col), self.type, self.err, self.nullable, depth=self.depth)


Scope = dict[str, Value]


def first_error(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def _literal(node: Literal) -> Value:
    if node.kind == "null":
        return Value(F.lit(None), T.NULL, None, True)
    col = {"int": lambda v: F.lit(v).cast("bigint"), "uint": lambda v: F.lit(str(v)).cast("decimal(20,0)"), "double": lambda v: F.lit(float(v)), "bytes": lambda v: F.lit(bytearray(v))}.get(node.kind, F.lit)(node.value)
    return Value(col, T.Type(node.kind), None, False, node.value)


class Checker:
    def __init__(self, scope: Scope):
        self.scope = scope

    def check(self, node: Any, local: Scope | None = None) -> Value:
        local = local or {}
        if isinstance(node, Literal):
            return _literal(node)
        if isinstance(node, Name):
            found = local.get(node.name) or self.scope.get(node.name)
            if found is None:
                raise CheckFault(f"undeclared reference to {node.name!r}")
            return found
        if isinstance(node, Field):
            return self.field(self.check(node.of, local), node.name)
        if isinstance(node, Index):
            return self.index(self.check(node.of, local), self.check(node.at, local))
        if isinstance(node, Items):
            return self.items([self.check(x, local) for x in node.items])
        if isinstance(node, Entries):
            return self.entries([(self.check(k, local), self.check(v, local)) for k, v in node.entries])
        assert isinstance(node, Call)
        if node.name == "has" and node.of is None:
            return self.has(node, local)
        if node.name in ("&&", "||"):
            return self.logic(node.name, *(self.check(x, local) for x in node.args))
        if node.name == "?:":
            return self.choice(*(self.check(x, local) for x in node.args))
        if node.name in ("==", "!="):
            return self.equality(node.name, *(self.check(x, local) for x in node.args))
        if node.of is not None and node.name in _MACROS and node.args and isinstance(node.args[0], Name):
            return self.macro(node, local)
        given = ([self.check(node.of, local)] if node.of is not None else []) + [self.check(x, local) for x in node.args]
        return self.call(node.name, given, node.of is not None)

    # ------------------------------------------------------------ access

    def field(self, of: Value, name: str) -> Value:
        t = T.carrier(of.type)
        if t.kind == "object":
            inner = t.field_type(name)
            if inner is None:
                raise CheckFault(f"undefined field {name!r} in {t}")
            return Value(of.col.getField(name), inner, of.err, True)
        if t.kind == "map":
            return self.index(of, Value(F.lit(name), T.STRING, None, False, name))
        raise CheckFault(f"type {t} has no field {name!r}")

    def index(self, of: Value, at: Value) -> Value:
        t, k = T.carrier(of.type), T.carrier(at.type)
        if t.kind == "list" and k.kind in ("int", "uint", "dyn"):
            place = at.col.cast("int")
            outside = of.col.isNull() | at.col.isNull() | (at.col < 0) | (at.col >= F.size(of.col))
            err = first_error(of.err, at.err, F.when(F.coalesce(outside, F.lit(True)), F.lit("index out of bounds")))
            return Value(F.when(~outside, F.get(of.col, place)), t.args[0], err).guarded()
        if t.kind == "map" and (T.carrier(t.args[0]) == k or k.kind == "dyn"):
            err = first_error(of.err, at.err, F.when(~F.coalesce(F.map_contains_key(of.col, at.col), F.lit(False)), F.lit("no such key")))
            return Value(F.try_element_at(of.col, at.col), t.args[1], err).guarded()
        raise CheckFault(f"no overload of [] for ({t}, {k})")

    def has(self, node: Call, local: Scope) -> Value:
        if len(node.args) != 1 or not isinstance(node.args[0], Field):
            raise CheckFault("has() takes a field")
        of = self.check(node.args[0].of, local)
        t = T.carrier(of.type)
        if t.kind == "map":
            return Value(F.coalesce(F.map_contains_key(of.col, F.lit(node.args[0].name)), F.lit(False)), T.BOOL, of.err, False).guarded()
        return Value(self.field(of, node.args[0].name).col.isNotNull(), T.BOOL, of.err, False).guarded()

    # ------------------------------------------------------------ literals of collections

    def _joined(self, values: list[Value], what: str) -> T.Type:
        kinds = [T.carrier(v.type) for v in values if v.type.kind != "null"]
        if any(k != kinds[0] for k in kinds):
            raise CheckFault(f"{what} of several types: {', '.join(map(str, dict.fromkeys(kinds)))}")
        return kinds[0] if kinds else T.DYN

    def items(self, values: list[Value]) -> Value:
        t = self._joined(values, "a list")
        col = F.array(*[v.col for v in values]) if values else F.array().cast("array<string>")
        return Value(col, T.list_of(t), first_error(*(v.err for v in values)), False).guarded()

    def entries(self, pairs: list[tuple[Value, Value]]) -> Value:
        k, v = self._joined([k for k, _ in pairs], "map keys"), self._joined([v for _, v in pairs], "map values")
        col = F.create_map(*[x.col for pair in pairs for x in pair]) if pairs else F.create_map().cast("map<string,string>")
        return Value(col, T.map_of(k, v), first_error(*(x.err for pair in pairs for x in pair)), False).guarded()

    # ------------------------------------------------------------ logic

    def _condition(self, v: Value, what: str) -> Value:
        t = T.carrier(v.type)
        if t.kind not in ("bool", "dyn"):
            raise CheckFault(f"no overload of {what} for {t}")
        return v

    def _truth_error(self, v: Value) -> Column | None:
        """The error of a condition; a null one is an error too."""
        return first_error(v.err, F.when(v.col.isNull(), F.lit("no such overload")) if v.nullable else None)

    def logic(self, sign: str, a: Value, b: Value) -> Value:
        a, b = self._condition(a, sign), self._condition(b, sign)
        ea, eb = self._truth_error(a), self._truth_error(b)
        # Null stands for an error here, and SQL's logic of three values absorbs it as wanted.
        col = a.col & b.col if sign == "&&" else a.col | b.col
        either = first_error(ea, eb)
        plain = a.test & b.test if sign == "&&" else a.test | b.test
        return Value(col, T.BOOL, None if either is None else F.when(col.isNull(), either), False, plain=plain)

    def choice(self, test: Value, then: Value, other: Value) -> Value:
        self._condition(test, "?:")
        a, b = T.carrier(then.type), T.carrier(other.type)
        if a != b and "null" not in (a.kind, b.kind) and "dyn" not in (a.kind, b.kind):
            raise CheckFault(f"branches of different types: {a} and {b}")
        out = then.type if a.kind not in ("null", "dyn") else other.type
        if "null" in (a.kind, b.kind) and a != b or then.type.kind == "dyn" or other.type.kind == "dyn":
            out = T.dyn_of(T.carrier(out))
        te = self._truth_error(test)
        branch = None
        if then.err is not None or other.err is not None:
            none = F.lit(None).cast("string")
            branch = F.when(test.col, then.err if then.err is not None else none).otherwise(other.err if other.err is not None else none)
        return Value(F.when(test.col, then.col).when(~test.col, other.col), out, first_error(te, branch), then.nullable or other.nullable, depth=max(then.depth, other.depth))

    def equality(self, sign: str, a: Value, b: Value) -> Value:
        x, y = T.carrier(a.type), T.carrier(b.type)
        if x != y and "null" not in (x.kind, y.kind) and "dyn" not in (x.kind, y.kind):
            raise CheckFault(f"no overload of {sign} for ({x}, {y})")
        if x.kind == "null" or y.kind == "null":
            same = (b if x.kind == "null" else a).col.isNull()
        elif b.literal is not None or a.literal is not None:
            # Against a literal a plain comparison can be pushed to a scan; null is unequal.
            col = a.col == b.col
            same = F.coalesce(col, F.lit(False)) if a.nullable or b.nullable else col
            if sign == "==" and a.err is None and b.err is None and x.kind != "double":
                return Value(same, T.BOOL, None, False, plain=col)
        else:
            same = a.col.eqNullSafe(b.col)
        if x.kind == "double" and y.kind == "double":
            same = same & ~F.isnan(F.coalesce(a.col, F.lit(0.0))) if a.literal is None else same
        return Value(same if sign == "==" else ~same, T.BOOL, first_error(a.err, b.err), False).guarded()

    # ------------------------------------------------------------ macros over lists, and over the keys of maps

    def macro(self, node: Call, local: Scope) -> Value:
        over = self.check(node.of, local)
        t = T.carrier(over.type)
        if t.kind == "map":
            items, element = F.map_keys(over.col), t.args[0]
        elif t.kind == "list":
            items, element = over.col, t.args[0]
        else:
            raise CheckFault(f"no overload of {node.name} for {t}")
        if len(node.args) not in ((2, 3) if node.name == "map" else (2,)):
            raise CheckFault(f"{node.name} takes a name and an expression")
        name = node.args[0].name
        inside = lambda expr, x: self.check(expr, {**local, name: Value(x, element)})
        probe = [inside(e, F.lit(None)) for e in node.args[1:]]
        null = first_error(over.err, F.when(over.col.isNull(), F.lit("no such overload")))
        last = node.args[-1]
        if node.name in ("all", "exists", "exists_one", "filter"):
            self._condition(probe[0], node.name)
        elif len(node.args) == 3:
            self._condition(probe[0], node.name)
        test = node.args[1]
        errors = lambda expr, over_items, condition=False: (F.get(F.filter(F.transform(over_items, lambda x: _or_null(self._truth_error(inside(expr, x)) if condition else inside(expr, x).err)), lambda e: e.isNotNull()), F.lit(0)))
        truth = lambda x: F.coalesce(inside(test, x).guarded().col, F.lit(False))
        if node.name == "all":  # false as soon as one is false, whatever the others do
            false = F.exists(items, lambda x: F.coalesce(~inside(test, x).guarded().col, F.lit(False)))
            return Value(~false, T.BOOL, first_error(null, F.when(~false, errors(test, items, True))), True).guarded()
        if node.name == "exists":
            true = F.exists(items, truth)
            return Value(true, T.BOOL, first_error(null, F.when(~true, errors(test, items, True))), True).guarded()
        if node.name == "exists_one":
            return Value(F.size(F.filter(items, truth)) == 1, T.BOOL, first_error(null, errors(test, items, True)), True).guarded()
        if node.name == "filter":
            return Value(F.filter(items, truth), T.list_of(element), first_error(null, errors(test, items, True)), True).guarded()
        kept, err = items, null
        if len(node.args) == 3:
            kept, err = F.filter(items, truth), first_error(null, errors(test, items, True))
        if probe[-1].err is not None:
            err = first_error(err, errors(last, kept))
        return Value(F.transform(kept, lambda x: inside(last, x).col), T.list_of(probe[-1].type), err, True).guarded()

    # ------------------------------------------------------------ functions

    def call(self, name: str, given: list[Value], member: bool) -> Value:
        kinds = [v.type for v in given]
        f = resolve(name, kinds, member)
        if f is None:
            known = name in REGISTRY
            raise CheckFault(f"no overload of {name!r} for ({', '.join(str(T.carrier(k)) for k in kinds)})" if known else f"undeclared function {name!r}")
        if f.strict and any(T.carrier(k).kind == "null" for k in kinds):
            raise CheckFault(f"no overload of {name!r} for null")
        depth = max((v.depth for v in given), default=0)
        try:
            result = f.result if isinstance(f.result, T.Type) else f.result(kinds)
            built = f.build(*[Arg(v.col, v.type, v.literal) for v in given])
            col, own, bare = (*built, False)[:3] if isinstance(built, tuple) else (built, {}, False)
            if f.strict and not bare and depth >= _DEEP:
                col = self._once(f, given, bool(own))
        except TypeError as e:
            raise CheckFault(f"{name}: {e}") from e
        # A value that is null by itself where an argument is needs that argument's last error only if it has another name.
        last = list(own)[-1] if bare and own else None
        errors = [v.tail[1] if last is not None and v.tail and v.tail[0] == last else v.err for v in given]
        if f.strict:
            errors += [F.when(v.col.isNull(), F.lit("no such overload")) for v in given if v.nullable]
        said = lambda message, condition: F.when(condition, F.lit(message if bare else f"{name}: {message}"))
        before = first_error(*errors, *(said(m, c) for m, c in own.items() if m != last))
        errors += [said(*x) for x in own.items()]
        nulls_only = f.strict and not own and all(v.err is None for v in given)
        value = Value(col, result, first_error(*errors), not f.strict or nulls_only and any(v.nullable for v in given), depth=depth + (f.strict and not bare), tail=None if last is None else (last, before))
        # A plain function of null is null already, and stays bare so that a scan can use it.
        return value if nulls_only or bare or f.strict and depth >= _DEEP else value.guarded()

    def _once(self, f, given: list[Value], fallible: bool) -> Column:
        """The function's value, null where an argument is null or it fails; each argument is written once."""
        bound = F.struct(*[v.col.alias(f"a{i}") for i, v in enumerate(given)])

        def body(x: Column) -> Column:
            args = [Arg(v.col if v.literal is not None else x[f"a{i}"], v.type, v.literal) for i, v in enumerate(given)]
            built = f.build(*args)
            col, own = built[:2] if isinstance(built, tuple) else (built, {})
            ok = [a.col.isNotNull() for a in args if a.literal is None] + [~F.coalesce(c, F.lit(False)) for c in own.values()]
            return F.when(reduce(and_, ok), col) if ok else col

        return F.get(F.transform(F.array(bound), body), F.lit(0))


#: So many functions may stand in one another before their arguments are bound.
_DEEP = 3


def _or_null(err: Column | None) -> Column:
    return F.lit(None).cast("string") if err is None else err


_MACROS = frozenset(("all", "exists", "exists_one", "map", "filter"))


def compile_expression(source: str, scope: Scope, want: T.Type | None = None) -> Value:
    """Checks one expression; CheckFault or SyntaxFault if it has no type or not the wanted one."""
    out = Checker(scope).check(parse(source))
    if want is not None and out.type != want:
        raise CheckFault(f"expected {want}, found {out.type}")
    return out


__all__ = ["CheckFault", "Checker", "Scope", "SyntaxFault", "Value", "compile_expression"]
