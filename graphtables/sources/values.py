"""Property values as Python objects: their types and texts."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from graphtables.errors import GraphError
from graphtables.functions import types as t

#: The type of a list without elements, which says nothing about its property.
EMPTY = "empty"


def type_of(v: object) -> str:
    match v:
        case bool():
            return t.BOOL
        case int():
            if not -(2**63) <= v < 2**63:
                raise GraphError(f"the integer {v} does not fit in 64 bits")
            return t.INT
        case float():
            return t.FLOAT
        case str():
            return t.STRING
        case dt.datetime():
            return t.LOCAL if v.tzinfo is None else t.UTC
        case dt.date():
            return t.DATE
        case bytes() | bytearray():
            return t.LISTS[t.INT]
        case list() | tuple():
            if not v:
                return EMPTY
            inner = t.NULL
            for x in v:
                inner = t.unify(inner, type_of(x)) if type_of(x) != EMPTY else t.STRING
            return t.LISTS.get(inner, t.LISTS[t.STRING])
    raise GraphError(f"a value of type {type(v).__name__} cannot be a property")


def text_of(v: object) -> str:
    """The text that a value has where it is widened to string."""
    match v:
        case bool():
            return "true" if v else "false"
        case float():
            if math.isnan(v):
                return "NaN"
            if math.isinf(v):
                return "inf" if v > 0 else "-inf"
            plain = format(Decimal(repr(v)), "f")
            return plain if "." in plain else plain + ".0"
        case dt.datetime():
            utc = v.astimezone(dt.UTC) if v.tzinfo else v
            part = "" if not utc.microsecond else f".{utc.microsecond:06d}" if utc.microsecond % 1000 else f".{utc.microsecond // 1000:03d}"
            return utc.strftime("%Y-%m-%dT%H:%M:%S") + part + ("Z" if v.tzinfo else "")
        case dt.date():
            return v.isoformat()
        case bytes() | bytearray():
            return text_of(list(v))
        case list() | tuple():
            return "[" + ", ".join(map(text_of, v)) + "]"
    return str(v)


def stored(v: object, kind: str) -> object:
    """A value as Spark takes it for a column of its own type."""
    if kind == EMPTY:
        return True
    if kind == t.UTC:
        return v.astimezone(dt.UTC)
    if t.is_list(kind):
        items = list(v)
        if kind == t.LISTS[t.STRING]:
            return [x if isinstance(x, str) else text_of(x) for x in items]
        return [float(x) for x in items] if kind == t.LISTS[t.FLOAT] else items
    return v
