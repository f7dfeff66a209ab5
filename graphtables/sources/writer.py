"""Writing a graph folder.

Rows and DataFrames are staged below ``.staging`` as Parquet, one column for each
property and type that it was seen with.  ``write`` resolves one type for each property
name of the whole graph, brings all columns to it, and writes the manifest last.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphtables.errors import GraphError
from graphtables.functions import types as t
from graphtables.sources import manifest as m
from graphtables.sources.graph import DST, ID, LABELS, RESERVED, SRC, Graph, quoted
from graphtables.sources.values import EMPTY, stored, text_of, type_of

CHUNK = 50_000
STAGING = ".staging"


@dataclass
class _Table:
    """What is staged for one label or type: folders, and the column that holds each (property, type) of them."""

    parts: list[tuple[str, dict[tuple[str, str], str]]] = field(default_factory=list)
    rows: list[tuple[tuple, dict[str, object]]] = field(default_factory=list)
    names: set[str] = field(default_factory=set)
    #: Of source and target: ids, or keys that ``write`` resolves.
    ends: T.DataType = field(default_factory=T.LongType)


class FileNames:
    """Names of files for labels and types, distinct even where case does not count."""

    def __init__(self) -> None:
        self.taken: set[str] = set()

    def assign(self, name: str) -> str:
        base = re.sub(r"[^A-Za-z0-9_-]", "_", name)
        out, k = base, 0
        while out.lower() in self.taken:
            k += 1
            out = f"{base}-{k}"
        self.taken.add(out.lower())
        return out


class GraphWriter:
    """``add_node`` and ``add_relationship`` take single rows, ``add_nodes`` and ``add_relationships`` DataFrames of any size.

    Ids are unique in the whole graph.  Single rows get them in turn from ``first_id``
    on; rows of DataFrames bring their own, but relationships without one get ids above
    2**53.  Single rows may also name nodes by keys of their source: keys are staged
    like rows, and ``write`` joins them, so the driver holds no table of them.
    """

    def __init__(self, spark: SparkSession, path: str, first_id: int = 0):
        self.spark, self.path, self.next = spark, path.rstrip("/"), first_id
        self.nodes: dict[str | None, _Table] = {}
        self.rels: dict[str, _Table] = {}
        self.keyed: dict[str, _Table] = {}  # relationships between keys
        self.keys: list[tuple[str, int]] = []
        self.key_parts: list[str] = []
        self.seen: dict[str, tuple[str, bool]] = {}  # property -> type so far, whether types differed
        self.frames = 0
        m.remove(spark, f"{self.path}/{STAGING}")

    # Rows.

    def add_node(self, labels: Iterable[str], properties: Mapping[str, object]) -> int:
        labels = sorted(set(labels))
        values = self._values(properties)
        node = self._id()
        for label in labels or [None]:
            self._stage(self.nodes.setdefault(label, _Table()), (node, None, None, labels), values, "nodes")
        return node

    def add_relationship(self, src: int, dst: int, type_: str, properties: Mapping[str, object]) -> int:
        values = self._values(properties)
        rel = self._id()
        self._stage(self.rels.setdefault(type_, _Table()), (rel, src, dst, None), values, "relationships")
        return rel

    def add_keyed_node(self, key: str, labels: Iterable[str], properties: Mapping[str, object]) -> int:
        """As ``add_node``, for a node that ``add_keyed_relationship`` names by ``key``; keys are unique."""
        node = self.add_node(labels, properties)
        self.keys.append((key, node))
        if len(self.keys) >= CHUNK:
            self._flush_keys()
        return node

    def add_keyed_relationship(self, src: str, dst: str, type_: str, properties: Mapping[str, object]) -> int:
        """As ``add_relationship``, between the nodes of two keys, which may be added later."""
        values = self._values(properties)
        rel = self._id()
        self._stage(self.keyed.setdefault(type_, _Table(ends=T.StringType())), (rel, src, dst, None), values, "relationships")
        return rel

    def _flush_keys(self) -> None:
        self.key_parts.append(self._save(self.spark.createDataFrame(self.keys, f"key string, {ID} long"), "keys"))
        self.keys = []

    def _id(self) -> int:
        self.next += 1
        return self.next - 1

    def _values(self, properties: Mapping[str, object]) -> dict[str, object]:
        values = {k: v for k, v in properties.items() if v is not None}
        for name in values:
            self._check(name)
        for name, v in values.items():
            self._observe(name, type_of(v))
        return values

    def _check(self, name: str) -> None:
        if name in RESERVED:
            raise GraphError(f"property name `{name}` is reserved")

    def _observe(self, name: str, kind: str) -> None:
        if kind == EMPTY:
            self.seen.setdefault(name, (t.NULL, False))
            return
        before, coerced = self.seen.get(name, (t.NULL, False))
        self.seen[name] = (t.unify(before, kind), coerced or before not in (t.NULL, kind))

    def _stage(self, table: _Table, head: tuple, values: dict[str, object], kind: str) -> None:
        table.rows.append((head, values))
        table.names |= set(values)
        if len(table.rows) >= CHUNK:
            self._flush(table, kind)

    def _flush(self, table: _Table, kind: str) -> None:
        if not table.rows:
            return
        columns: dict[tuple[str, str], str] = {}
        for _, values in table.rows:
            for name, v in values.items():
                columns.setdefault((name, type_of(v)), f"c{len(columns)}")
        spark_type = lambda k: T.BooleanType() if k == EMPTY else t.SPARK[k]
        schema = T.StructType(
            [T.StructField(ID, T.LongType()), T.StructField(SRC, table.ends), T.StructField(DST, table.ends), T.StructField(LABELS, T.ArrayType(T.StringType()))]
            + [T.StructField(c, spark_type(k)) for (_, k), c in columns.items()]
        )
        rows = [(*head, *(stored(values[name], k) if name in values and type_of(values[name]) == k else None for name, k in columns)) for head, values in table.rows]
        table.parts.append((self._save(self.spark.createDataFrame(rows, schema), kind), columns))
        table.rows = []

    def _save(self, df: DataFrame, kind: str) -> str:
        path = f"{self.path}/{STAGING}/{kind}-{self.frames}"
        self.frames += 1
        df.write.parquet(path)
        return path

    # DataFrames.

    def add_nodes(self, df: DataFrame, labels: Iterable[str], id_col: str = ID) -> None:
        """All rows of ``df`` as nodes with these labels; all columns but the id are properties."""
        labels = sorted(set(labels))
        columns, picked = self._columns(df, {id_col})
        head = [F.col(quoted(id_col)).cast("long").alias(ID), F.lit(None).cast("long").alias(SRC), F.lit(None).cast("long").alias(DST), F.array(*map(F.lit, labels)).cast("array<string>").alias(LABELS)]
        path = self._save(df.select(*head, *picked), "nodes")
        for label in labels or [None]:
            self._staged(self.nodes.setdefault(label, _Table()), path, columns)

    def add_relationships(self, df: DataFrame, type_: str, src_col: str = SRC, dst_col: str = DST, id_col: str | None = None) -> None:
        """All rows of ``df`` as relationships; all columns but the ends and the id are properties."""
        columns, picked = self._columns(df, {src_col, dst_col, *([id_col] if id_col else [])})
        if id_col:
            rel = F.col(quoted(id_col)).cast("long")
        else:
            # Written once, and read from the staged table from then on: the ids stay.
            made = F.monotonically_increasing_id()
            rel = F.when(F.lit(self.frames) < 512, F.lit((self.frames + 1) << 53) + F.when(made < (1 << 53), made).otherwise(F.raise_error(F.lit("more than 2**20 partitions: give the relationships ids"))))
        head = [rel.alias(ID), F.col(quoted(src_col)).cast("long").alias(SRC), F.col(quoted(dst_col)).cast("long").alias(DST), F.lit(None).cast("array<string>").alias(LABELS)]
        self._staged(self.rels.setdefault(type_, _Table()), self._save(df.select(*head, *picked), "relationships"), columns)

    def _columns(self, df: DataFrame, taken: set[str]) -> tuple[dict[tuple[str, str], str], list[Column]]:
        columns: dict[tuple[str, str], str] = {}
        picked = []
        for f in df.schema.fields:
            if f.name in taken:
                continue
            self._check(f.name)
            kind = t.of_spark(f.dataType, f.name)
            columns[f.name, kind] = f"c{len(columns)}"
            column = F.col(quoted(f.name))
            if kind == t.LISTS[t.STRING] and not isinstance(f.dataType.elementType, T.StringType):
                column = F.transform(column, lambda x: x.cast("string"))
            picked.append(column.cast(t.SPARK[kind]).alias(columns[f.name, kind]))
        for name, kind in columns:
            self._observe(name, kind)
        return columns, picked

    def _staged(self, table: _Table, path: str, columns: dict[tuple[str, str], str]) -> None:
        table.parts.append((path, columns))
        table.names |= {name for name, _ in columns}

    # Writing.

    def write(self) -> Graph:
        types = {name: PropertyType(t.LISTS[t.STRING] if kind == t.NULL else kind, coerced) for name, (kind, coerced) in self.seen.items()}
        nodes, rels = [], []
        order = sorted(self.nodes, key=lambda x: (x is not None, (x or "").encode()))
        names = FileNames()
        for label in order:
            file = f"nodes/{names.assign('_unlabeled' if label is None else label)}.parquet"
            schema, rows = self._table(self.nodes[label], types, file, "nodes", [ID, LABELS])
            nodes.append(m.NodeEntry(label, file, rows, schema))
        names = FileNames()
        keys = self._unique_keys() if self.keyed else None
        for kind in sorted(self.rels.keys() | self.keyed.keys(), key=str.encode):
            file = f"relationships/{names.assign(kind)}.parquet"
            between = (lambda df, kind=kind: self._between(df, kind, keys)) if kind in self.keyed else None
            schema, rows = self._table(self.rels.get(kind, _Table()), types, file, "relationships", [ID, SRC, DST], self.keyed.get(kind, _Table()), between)
            rels.append(m.RelEntry(kind, file, rows, schema))
        for r in rels:
            for column, some, every in ((SRC, r.src_labels, r.src_all), (DST, r.dst_labels, r.dst_all)):
                counts = self._endpoints(nodes, r, column)
                some += sorted(counts)
                every += sorted(x for x, n in counts.items() if n == r.row_count)
        m.save(self.spark, self.path, m.Manifest(nodes, rels))
        m.remove(self.spark, f"{self.path}/{STAGING}")
        return Graph.open(self.spark, self.path)

    def _table(self, table: _Table, types: dict[str, PropertyType], file: str, kind: str, head: list[str], keyed: _Table | None = None, between: Callable[[DataFrame], DataFrame] | None = None) -> tuple[list[m.PropertySchema], int]:
        keyed = keyed or _Table()
        names = sorted(table.names | keyed.names, key=str.encode)
        if len({x.lower() for x in names}) < len(names) and self.spark.conf.get("spark.sql.caseSensitive") != "true":
            raise GraphError(f"{file} has properties that differ only in case; set spark.sql.caseSensitive to true")

        def parts_of(staged: _Table) -> list[DataFrame]:
            self._flush(staged, kind)
            return [self.spark.read.parquet(path).select(*head, *(self._merged(columns, name, types[name].type).alias(name) for name in names)) for path, columns in staged.parts]

        parts = parts_of(table)
        if between is not None:
            parts.append(between(reduce(DataFrame.union, parts_of(keyed))))
        out = f"{self.path}/{file}"
        reduce(DataFrame.union, parts).write.mode("overwrite").parquet(out)
        return [m.PropertySchema(x, types[x].type, types[x].coerced) for x in names], self.spark.read.parquet(out).count()

    def _unique_keys(self) -> str:
        """A staged table of the keys of nodes and their ids (key, _id)."""
        self._flush_keys()
        keys = reduce(DataFrame.union, map(self.spark.read.parquet, self.key_parts))
        path = self._save(keys.groupBy("key").agg(F.min(ID).alias(ID), F.count(F.lit(1)).alias("n")), "keys")
        twice = self.spark.read.parquet(path).filter("n > 1").first()
        if twice:
            raise GraphError(f"{twice['n']} nodes have the key `{twice['key']}`")
        return path

    def _between(self, df: DataFrame, type_: str, keys: str) -> DataFrame:
        """``df`` (id, source, target, properties) with the ids of the nodes that its ends are keys of."""
        names = df.columns
        out = df.toDF("rel", "a", "b", *(f"c{k}" for k in range(len(names) - 3)))
        for end in "ab":
            out = out.join(self.spark.read.parquet(keys).select(F.col("key").alias(end), F.col(ID).alias("id_" + end)), end, "left")
        found = self.spark.read.parquet(self._save(out, "relationships"))
        lost = found.filter("id_a is null or id_b is null").first()
        if lost:
            raise GraphError(f"a relationship of type `{type_}` has an end `{lost['b'] if lost['id_a'] is not None else lost['a']}` that is not among the nodes")
        return found.select("rel", "id_a", "id_b", *(f"c{k}" for k in range(len(names) - 3))).toDF(*names)

    def _merged(self, columns: dict[tuple[str, str], str], name: str, wanted: str) -> Column:
        """The one column of a property, from those of the types that it was staged with."""
        found = []
        for (n, kind), c in columns.items():
            if n != name:
                continue
            if kind != EMPTY:
                found.append(t.convert(F.col(c), kind, wanted))
            elif t.is_list(wanted):
                found.append(F.when(F.col(c), F.array().cast(t.SPARK[wanted])))
            elif wanted == t.STRING:
                found.append(F.when(F.col(c), F.lit(text_of([]))))
        return F.coalesce(*found) if found else t.typed_null(wanted)

    def _endpoints(self, nodes: list[m.NodeEntry], rel: m.RelEntry, column: str) -> dict[str, int]:
        """How many relationships have an end with each label."""
        labelled = [self.spark.read.parquet(f"{self.path}/{n.file}").select(ID, F.lit(n.label).alias("label")) for n in nodes if n.label is not None]
        if not labelled:
            return {}
        ends = self.spark.read.parquet(f"{self.path}/{rel.file}").select(F.col(column).alias(ID))
        counted = ends.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).join(reduce(DataFrame.union, labelled), ID)
        return {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class PropertyType:
    type: str
    coerced: bool
