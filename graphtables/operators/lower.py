"""Logical plans as DataFrames.

Inside a plan columns have positional names (``v3_id``, ``v3_p0``), since names of the
query may hold anything; the names that the query asks for come with the last projection.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtables.functions import types as t
from graphtables.functions.expressions import Entity, Scope
from graphtables.plans.ast import Call, Expr, Property, Variable
from graphtables.plans.binder import is_aggregate
from graphtables.plans.logical import CrossJoin, Expand, Filter, NodeScan, NodeVar, Plan, RelVar, Returning
from graphtables.sources.graph import DST, ID, LABELS, SRC, Graph, quoted

MOST_INT = 2**31 - 1


def lower(plan: Plan, graph: Graph, parameters: Mapping[str, object]) -> DataFrame:
    return _Lowering(plan, graph, parameters).returning()


class _Needs:
    """What a query asks of each variable."""

    def __init__(self) -> None:
        self.properties: dict[str, set[str]] = {}
        self.labels: set[str] = set()
        self.whole: set[str] = set()

    def add(self, e: Expr, item: bool = False) -> None:
        if isinstance(e, Variable):
            if item:
                self.whole.add(e.name)
        elif isinstance(e, Property) and isinstance(e.base, Variable):
            self.properties.setdefault(e.base.name, set()).add(e.key)
        elif isinstance(e, Call) and e.name.lower() == "labels" and e.args and isinstance(e.args[0], Variable):
            self.labels.add(e.args[0].name)
        else:
            for x in e.children():
                self.add(x, item and is_aggregate(e) and e.name.lower() == "collect")


class _Lowering:
    def __init__(self, plan: Returning, graph: Graph, parameters: Mapping[str, object]):
        self.plan, self.graph = plan, graph
        self.scope = Scope({}, dict(parameters), plan.variables)
        self.needs = _Needs()
        self.number = 0
        for e in _expressions(plan.input):
            self.needs.add(e)
        for i in plan.items:
            self.needs.add(i.expr, True)
        for k, _ in plan.order:
            if not isinstance(k, int):
                self.needs.add(k)

    # Scans.

    def _wanted(self, var: str, has: dict[str, str]) -> dict[str, str]:
        return has if var in self.needs.whole else {p: k for p, k in has.items() if p in self.needs.properties.get(var, ())}

    def _entity(self, var: str, kind: str, properties: dict[str, str]) -> tuple[str, Entity]:
        """Positional names for a variable's columns."""
        v = f"v{self.number}"
        self.number += 1
        columns = {p: (F.col(f"{v}_p{j}"), k) for j, (p, k) in enumerate(properties.items())}
        entity = Entity(kind, F.col(f"{v}_id"), columns, F.col(f"{v}_labels"), F.col(f"{v}_type"))
        self.scope.entities[var] = entity
        return v, entity

    def _unified(self, tables: list[dict[str, str]]) -> dict[str, str]:
        out: dict[str, str] = {}
        for properties in tables:
            for p, k in properties.items():
                out[p] = t.unify(out[p], k) if p in out else k
        return dict(sorted(out.items())) if len(tables) > 1 else out

    def _columns(self, v: str, wanted: dict[str, str], has: dict[str, str]) -> list[Column]:
        return [(t.convert(F.col(quoted(p)), has[p], k) if p in has else t.typed_null(k)).alias(f"{v}_p{j}") for j, (p, k) in enumerate(wanted.items())]

    def nodes(self, node: NodeVar) -> DataFrame:
        """The nodes that a pattern's node allows, its own conditions applied."""
        tables = self.graph.nodes
        stored = self.graph.labels_stored
        need_labels = node.name in self.needs.labels or node.name in self.needs.whole
        names = [min(node.labels, key=lambda x: _rows(tables[x].rows))] if node.labels else node.tables
        # A node's own properties are in each of its tables; the first label names the columns.
        has = tables[node.labels[0]].properties if node.labels else self._unified([tables[x].properties for x in names])
        wanted = self._wanted(node.name, has)
        v, entity = self._entity(node.name, t.NODE, wanted)
        if not names:
            schema = ", ".join([f"{v}_id long", f"{v}_labels array<string>", *(f"{v}_p{j} {t.SPARK[k].simpleString()}" for j, k in enumerate(wanted.values()))])
            return self.graph.spark.createDataFrame([], schema)
        parts = []
        for x in names:
            df = tables[x].df
            if node.labels:
                for other in node.labels:
                    if other == x:
                        continue
                    if stored:
                        df = df.filter(F.array_contains(LABELS, other))
                    else:
                        df = df.join(tables[other].df.select(ID), ID, "left_semi")
            elif stored and x is not None and len(names) > 1:
                # A node of several labels comes from the table of its first one among those read.
                df = df.filter(F.get(F.array_intersect(F.col(LABELS), F.array(*(F.lit(n) for n in names if n is not None))), F.lit(0)) == x)
            columns = [F.col(ID).alias(f"{v}_id"), *self._columns(v, wanted, tables[x].properties)]
            if need_labels and stored:
                columns.append(F.col(LABELS).alias(f"{v}_labels"))
            parts.append(df.select(*columns))
        df = reduce(DataFrame.union, parts)
        early = [e for e in node.filters if node.name not in _label_users(e)]
        df = self._filtered(df, early)
        if len(parts) > 1 and not stored:
            df = df.dropDuplicates([f"{v}_id"])
        if need_labels and not stored:
            lookup = self.graph.label_lookup().select(F.col(ID).alias("__id"), F.col(LABELS).alias(f"{v}_labels"))
            df = df.join(lookup, df[f"{v}_id"] == F.col("__id"), "left").drop("__id")
        return self._filtered(df, [e for e in node.filters if e not in early])

    def _filtered(self, df: DataFrame, conditions: list[Expr]) -> DataFrame:
        for e in conditions:
            df = df.filter(self.scope.boolean(e))
        return df

    def relationships(self, rel: RelVar, both_ways: bool) -> tuple[DataFrame, str]:
        """All relationships of the types, as ``{v}_id, {v}_src, {v}_dst`` and what else is asked for."""
        tables = [self.graph.rels[x] for x in rel.types]
        wanted = self._wanted(rel.name, self._unified([x.properties for x in tables]))
        v, _ = self._entity(rel.name, t.REL, wanted)
        parts = [
            x.df.select(F.col(ID).alias(f"{v}_id"), F.col(SRC).alias(f"{v}_src"), F.col(DST).alias(f"{v}_dst"), F.lit(x.type).alias(f"{v}_type"), *self._columns(v, wanted, x.properties))
            for x in tables
        ]
        df = self._filtered(reduce(DataFrame.union, parts), rel.filters)
        if both_ways:
            # Each relationship in both directions, a loop once; the edges are doubled, never the rows they meet.
            ends = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
            src, dst = f"{v}_src", f"{v}_dst"
            ways = F.when(F.col(src) == F.col(dst), F.array(ends(src, dst))).otherwise(F.array(ends(src, dst), ends(dst, src)))
            rest = [c for c in df.columns if c not in (src, dst)]
            df = df.select(*rest, F.explode(ways).alias("__way")).select(*rest, F.col("__way.a").alias(src), F.col("__way.b").alias(dst))
        return df, v

    # Joins.

    def frame(self, plan: Plan) -> DataFrame:
        match plan:
            case NodeScan(node=node):
                return self.nodes(node)
            case CrossJoin(left=a, right=b):
                return self.frame(a).crossJoin(self.frame(b))
            case Filter(input=below, conditions=conditions, distinct_rels=pairs):
                df = self._filtered(self.frame(below), conditions)
                for a, b in pairs:
                    df = df.filter(self.scope.entities[a].id != self.scope.entities[b].id)
                return df
            case Expand():
                return self.expand(plan)
        raise TypeError(plan)

    def expand(self, plan: Expand) -> DataFrame:
        below = None if plan.skip_source else self.frame(plan.input)
        edges, r = self.relationships(plan.rel, plan.forward is None)
        here, there = (f"{r}_dst", f"{r}_src") if plan.forward is False else (f"{r}_src", f"{r}_dst")
        if below is None:
            _, source = self._entity(plan.source, t.NODE, {})
            df = edges
            source.id = F.col(here)
        else:
            on = self.scope.entities[plan.source].id == F.col(here)
            if plan.closes:
                on = on & (self.scope.entities[plan.target.name].id == F.col(there))
            df = below.join(edges, on)
        if plan.closes:
            return df
        if plan.skip_target:
            _, target = self._entity(plan.target.name, t.NODE, {})
            target.id = F.col(there)
            return df
        nodes = self.nodes(plan.target)
        return df.join(nodes, F.col(there) == self.scope.entities[plan.target.name].id)

    # RETURN.

    def returning(self) -> DataFrame:
        plan, scope = self.plan, self.scope
        df = self.frame(plan.input)
        outs = [f"o{k}" for k in range(len(plan.items))]
        if any(plan.aggregated):
            keys, values = [], []
            for out, item, agg in zip(outs, plan.items, plan.aggregated):
                (values if agg else keys).append((out, scope.aggregate(item.expr) if agg else scope.item(item.expr)))
            columns = [v.column.alias(out) for out, v in values]
            df = df.groupBy(*(v.column.alias(out) for out, v in keys)).agg(*columns) if keys else df.agg(*columns)
            df = df.select(*outs)
        else:
            hidden = [(f"h{k}", scope.item(e)) for k, (e, _) in enumerate(plan.order) if not isinstance(e, int)]
            df = df.select(*(scope.item(i.expr).column.alias(out) for out, i in zip(outs, plan.items)), *(v.column.alias(h) for h, v in hidden))
        if plan.distinct:
            df = df.distinct()
        if plan.order:
            keys = [F.col(outs[e] if isinstance(e, int) else f"h{k}") for k, (e, _) in enumerate(plan.order)]
            # Null is the largest value.
            df = df.orderBy(*(c.desc_nulls_first() if down else c.asc_nulls_last() for c, (_, down) in zip(keys, plan.order)))
        if plan.skip:
            df = df.offset(min(plan.skip, MOST_INT))
        if plan.limit is not None and plan.limit <= MOST_INT:
            df = df.limit(plan.limit)
        return df.select(*(F.col(out).alias(i.name) for out, i in zip(outs, plan.items)))


def _rows(n: int | None) -> int:
    return 1 << 60 if n is None else n


def _label_users(e: Expr) -> set[str]:
    needs = _Needs()
    needs.add(e)
    return needs.labels


def _expressions(plan: Plan) -> Iterator[Expr]:
    match plan:
        case NodeScan(node=node):
            yield from node.filters
        case CrossJoin(left=a, right=b):
            yield from _expressions(a)
            yield from _expressions(b)
        case Filter(input=below, conditions=conditions):
            yield from conditions
            yield from _expressions(below)
        case Expand(input=below, rel=rel, target=target):
            yield from _expressions(below)
            yield from rel.filters
            yield from target.filters



