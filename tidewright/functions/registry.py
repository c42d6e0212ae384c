"""Functions of the expression language: signatures, and the columns that compute them.

A function is given its arguments as Spark columns and returns the value, and the condition under which the
row is an error, as a map from message to Boolean column.  A value must never raise: it may be anything where
an error is reported, because the caller hides it then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from ..plans import types as T


@dataclass(frozen=True)
class Arg:
    """``literal``: the value, where the argument is written as a literal; else None."""

    col: Column
    type: T.Type
    literal: Any = None


@dataclass(frozen=True)
class Function:
    """``build`` takes Args and returns a column, or a column and its errors, and True after them if the column is null by
    itself where an argument is null or there is an error; its conditions then hold only if no error comes before them.  ``strict``: a null argument is
    an error, as a typed function has no overload for null.  ``result`` may depend on the arguments' types."""

    name: str
    params: tuple[T.Type, ...]
    result: T.Type | Callable[..., T.Type]
    build: Callable[..., Any]
    strict: bool = True
    member: bool = False


REGISTRY: dict[str, list[Function]] = {}


def register(name: str, params: tuple[T.Type, ...], result: Any, build: Callable[..., Any], strict: bool = True, member: bool = False) -> None:
    """Adds an overload; also the way for users to add functions of their own, from columns to columns."""
    REGISTRY.setdefault(name, []).append(Function(name, params, result, build, strict, member))


def accepts(param: T.Type, given: T.Type) -> bool:
    """Whether an argument of type ``given`` may stand for ``param``; dyn stands for anything not known better."""
    if param.kind == "dyn":
        return True
    given = T.carrier(given)
    if given.kind == "dyn":
        return True
    if param.kind != given.kind:
        return False
    return all(accepts(p, g) for p, g in zip(param.args, given.args, strict=False))


def resolve(name: str, given: list[T.Type], member: bool) -> Function | None:
    for f in REGISTRY.get(name, []):
        if f.member == member and len(f.params) == len(given) and all(map(accepts, f.params, given)):
            return f
    return None
