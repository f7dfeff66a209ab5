"""Expressions as typed Spark columns.

Every expression has a static type, so Spark never has to guess a cast: values of types
that cannot be compared are unequal, and have no order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphtables.errors import unsupported
from graphtables.functions import types as t
from graphtables.plans.ast import Binary, Call, Expr, IsNull, ListOf, Literal, Parameter, Property, Unary, Variable



@dataclass
class Entity:
    """A variable of a pattern, as columns of the frame."""

    kind: str  # types.NODE or types.REL
    id: Column
    properties: dict[str, tuple[Column, str]] = field(default_factory=dict)
    labels: Column | None = None
    type: Column | None = None

    def struct(self) -> Column:
        tag = self.labels.alias("_labels") if self.kind == t.NODE else self.type.alias("_type")
        return F.struct(self.id.alias("_id"), tag, *(c.alias(name) for name, (c, _) in self.properties.items()))


@dataclass
class Typed:
    column: Column
    type: str


def _null_or(value: object, *args: Typed) -> Column:
    """``value`` unless one of the arguments is null."""
    missing = args[0].column.isNull()
    for a in args[1:]:
        missing = missing | a.column.isNull()
    return F.when(missing, F.lit(None).cast("boolean")).otherwise(F.lit(value))


class Scope:
    """What variables and parameters stand for while expressions are lowered; ``order`` has the variables whose ids order what is collected."""

    def __init__(self, entities: dict[str, Entity], parameters: dict[str, object], order: list[str] | None = None):
        self.entities, self.parameters, self.order = entities, parameters, order or []

    def lower(self, e: Expr) -> Typed:
        match e:
            case Literal(value=v):
                return literal(v)
            case Parameter(name=name):
                if name not in self.parameters:
                    raise unsupported(f"missing parameter `${name}`", e.span)
                return literal(self.parameters[name])
            case Variable(name=name):
                raise unsupported(f"bare variable `{name}` in an expression", e.span)
            case Property(base=Variable(name=name), key=key):
                entity = self.entities[name]
                if key == "_id":
                    return Typed(entity.id, t.INT)
                if key not in entity.properties:
                    return Typed(t.typed_null(t.NULL), t.NULL)
                return Typed(*entity.properties[key])
            case Property():
                raise unsupported("property access on a non-variable expression", e.span)
            case IsNull(operand=x, negated=negated):
                c = self.lower(x).column
                return Typed(c.isNotNull() if negated else c.isNull(), t.BOOL)
            case ListOf(items=()):
                raise unsupported("empty list literal", e.span)
            case ListOf(items=items):
                values = [self.lower(x) for x in items]
                inner = values[0].type
                for v in values[1:]:
                    inner = t.unify(inner, v.type)
                if inner not in t.LISTS:
                    inner = t.STRING
                return Typed(F.array(*(t.convert(v.column, v.type, inner) for v in values)), t.LISTS[inner])
            case Unary(op="NOT", operand=x):
                return Typed(~self.boolean(x), t.BOOL)
            case Unary(operand=x):
                v = self.number(x)
                return Typed(-v.column, v.type)
            case Binary(op="AND" | "OR" | "XOR" as op, left=a, right=b):
                x, y = self.boolean(a), self.boolean(b)
                return Typed(x & y if op == "AND" else x | y if op == "OR" else x != y, t.BOOL)
            case Binary(op="IN", left=a, right=b):
                return self._member(a, b)
            case Binary(op=op, left=a, right=b) if op in ("=", "<>", "<", "<=", ">", ">="):
                return Typed(compare(op, self.lower(a), self.lower(b)), t.BOOL)
            case Binary(op=op, left=a, right=b) if op in _MATCH:
                x, y = self.lower(a), self.lower(b)
                return Typed(_MATCH[op](t.text(x.column, _plain(x.type)), t.text(y.column, _plain(y.type))), t.BOOL)
            case Binary(op=op, left=a, right=b):
                return self._arithmetic(op, a, b)
            case Call():
                return self._call(e)
        raise unsupported("expression", e.span)

    def boolean(self, e: Expr) -> Column:
        v = self.lower(e)
        if v.type == t.NULL:
            return F.lit(None).cast("boolean")
        if v.type != t.BOOL:
            raise unsupported(f"a value of type {v.type} where a boolean is needed", e.span)
        return v.column

    def number(self, e: Expr) -> Typed:
        v = self.lower(e)
        if v.type == t.NULL:
            return Typed(F.lit(None).cast("bigint"), t.INT)
        if v.type not in t.NUMERIC:
            raise unsupported(f"a value of type {v.type} where a number is needed", e.span)
        return v

    def _member(self, a: Expr, b: Expr) -> Typed:
        if not isinstance(b, ListOf):
            raise unsupported("IN with a non-literal-list right-hand side", b.span)
        if not b.items:
            return Typed(F.lit(False), t.BOOL)
        x = self.lower(a)
        out = None
        for item in b.items:
            c = compare("=", x, self.lower(item))
            out = c if out is None else out | c
        return Typed(out, t.BOOL)

    def _arithmetic(self, op: str, a: Expr, b: Expr) -> Typed:
        x, y = self.lower(a), self.lower(b)
        if op == "+" and (t.is_list(x.type) or t.is_list(y.type)):
            kind = t.unify(x.type, y.type)
            if not (t.is_list(x.type) and t.is_list(y.type)):
                raise unsupported("`+` of a list and a value", a.span.to(b.span))
            return Typed(F.concat(t.convert(x.column, x.type, kind), t.convert(y.column, y.type, kind)), kind)
        if op == "+" and t.STRING in (x.type, y.type):
            return Typed(F.concat(*(t.convert(v.column, v.type, t.STRING) for v in (x, y))), t.STRING)
        x, y = self.number(a), self.number(b)
        l, r = x.column, y.column
        kind = t.INT if x.type == y.type == t.INT else t.FLOAT
        if kind == t.FLOAT:
            l, r = l.cast("double"), r.cast("double")
        if op in "+-*":
            return Typed(l + r if op == "+" else l - r if op == "-" else l * r, kind)
        if kind == t.INT:
            return Typed(F.call_function("div", l, r) if op == "/" else l % r, kind)
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        if op == "%":
            return Typed(F.when(r == 0, F.when(l.isNotNull(), nan)).otherwise(l % r), kind)
        # As doubles divide: by zero gives an infinity or NaN, not an error.
        by_zero = F.when((l == 0) | F.isnan(l), nan).when((l > 0) == (F.atan2(r, F.lit(-1.0)) > 0), inf).when(l.isNotNull(), -inf)
        return Typed(F.when(r == 0, by_zero).otherwise(l / r), kind)

    def _call(self, e: Call) -> Typed:
        name = e.name.lower()
        if e.star:
            raise unsupported("count(*) outside an aggregation", e.span)
        if name == "id":
            return Typed(self._entity(e, "id() requires a single variable argument").id, t.INT)
        if name == "labels":
            return Typed(self._entity(e, "labels() requires a node variable", t.NODE).labels, t.LISTS[t.STRING])
        if name == "type":
            return Typed(self._entity(e, "type() requires a relationship variable", t.REL).type, t.STRING)
        if name == "coalesce":
            if not e.args:
                raise unsupported("coalesce() requires at least one argument", e.span)
            values = [self.lower(x) for x in e.args]
            kind = t.NULL
            for v in values:
                kind = t.unify(kind, v.type)
            return Typed(F.coalesce(*(t.convert(v.column, v.type, _plain(kind)) for v in values)), kind)
        if name not in ("toupper", "tolower", "abs", "size"):
            raise unsupported(f"function `{e.name}`", e.span)
        if len(e.args) != 1:
            raise unsupported("expected exactly one argument", e.span)
        if name == "abs":
            v = self.number(e.args[0])
            return Typed(F.abs(v.column), v.type)
        v = self.lower(e.args[0])
        if name == "size" and t.is_list(v.type):
            return Typed(F.when(v.column.isNotNull(), F.size(v.column)).cast("bigint"), t.INT)
        s = t.text(v.column, _plain(v.type))
        if name == "size":
            return Typed(F.char_length(s).cast("bigint"), t.INT)
        return Typed(F.upper(s) if name == "toupper" else F.lower(s), t.STRING)

    def _entity(self, e: Call, message: str, kind: str | None = None) -> Entity:
        if len(e.args) == 1 and isinstance(e.args[0], Variable):
            entity = self.entities[e.args[0].name]
            if kind in (None, entity.kind):
                return entity
        raise unsupported(message, e.span)

    # Whole RETURN items.

    def item(self, e: Expr) -> Typed:
        """An item of RETURN: a bare variable is the whole entity, and an untyped null a string."""
        if isinstance(e, Variable):
            entity = self.entities[e.name]
            return Typed(entity.struct(), entity.kind)
        v = self.lower(e)
        return Typed(v.column.cast("string"), t.STRING) if v.type == t.NULL else v

    def aggregate(self, e: Call) -> Typed:
        name = e.name.lower()
        if e.star:
            return Typed(F.count(F.lit(1)), t.INT)
        arg = e.args[0]
        if isinstance(arg, Variable):
            entity = self.entities[arg.name]
            if name == "count":
                return Typed(F.count_distinct(entity.id) if e.distinct else F.count(entity.id), t.INT)
            if name != "collect":
                raise unsupported(f"bare variable `{arg.name}` in an expression", arg.span)
            v = Typed(entity.struct(), entity.kind)
        else:
            v = self.lower(arg)
        c = v.column
        if name == "count":
            return Typed(F.count_distinct(c) if e.distinct else F.count(c), t.INT)
        if name == "collect":
            return Typed(F.array_sort(F.collect_set(c)) if e.distinct else self._collected(c), t.LISTS.get(v.type, t.LISTS[t.STRING]))
        if name in ("min", "max"):
            return Typed((F.min if name == "min" else F.max)(c), v.type)
        v = self.number(arg)
        if name == "avg":
            return Typed(F.call_function("avg", F.lit(None).cast("double")) if v.type == t.NULL else _avg(v.column.cast("double"), e.distinct), t.FLOAT)
        total = F.sum_distinct(v.column) if e.distinct else F.sum(v.column)
        return Typed(F.coalesce(total, F.lit(0.0 if v.type == t.FLOAT else 0).cast(t.SPARK[v.type])), v.type)

    def _collected(self, c: Column) -> Column:
        """The values that are not null, in the order of the ids of the pattern's nodes, then of its relationships: joins keep no order that could be told."""
        ids = (self.entities[x].id.alias(f"k{i}") for i, x in enumerate(self.order))
        rows = F.collect_list(F.when(c.isNotNull(), F.struct(*ids, c.alias("value"))))
        return F.transform(F.array_sort(rows), lambda x: x["value"])


def _avg(c: Column, distinct: bool) -> Column:
    return F.sum_distinct(c) / F.nullif(F.count_distinct(c), F.lit(0)) if distinct else F.avg(c)


def _plain(kind: str) -> str:
    return t.STRING if kind == t.NULL else kind


_MATCH: dict[str, Callable[[Column, Column], Column]] = {
    "STARTS WITH": lambda a, b: a.startswith(b),
    "ENDS WITH": lambda a, b: a.endswith(b),
    "CONTAINS": lambda a, b: a.contains(b),
}


def literal(v: object) -> Typed:
    if v is None:
        return Typed(t.typed_null(t.NULL), t.NULL)
    if isinstance(v, bool):
        return Typed(F.lit(v), t.BOOL)
    if isinstance(v, int):
        return Typed(F.lit(v).cast("bigint"), t.INT)
    if isinstance(v, float):
        return Typed(F.lit(v).cast("double"), t.FLOAT)
    if isinstance(v, str):
        return Typed(F.lit(v), t.STRING)
    raise TypeError(f"a parameter must be an integer, a float, a string, a boolean or None, not {type(v).__name__}")


def compare(op: str, x: Typed, y: Typed) -> Column:
    """Three-valued: null if either is null; values of other kinds are unequal and have no order."""
    if t.NULL in (x.type, y.type):
        return F.lit(None).cast("boolean")
    l, r = x.column, y.column
    if x.type != y.type:
        both = t.unify(x.type, y.type)
        if both in (t.FLOAT, t.LISTS[t.FLOAT]):
            l, r = t.convert(l, x.type, both), t.convert(r, y.type, both)
        else:
            return _null_or({"=": False, "<>": True}.get(op), x, y) if op in ("=", "<>") else F.lit(None).cast("boolean")
    return {"=": l == r, "<>": l != r, "<": l < r, "<=": l <= r, ">": l > r, ">=": l >= r}[op]
