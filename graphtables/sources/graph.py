"""Graphs: node tables by label, relationship tables by type."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.errors import GraphError
from graphtables.functions import types as t
from graphtables.sources import manifest as m

#: Columns of the engine; no property may have such a name.
ID, SRC, DST, TYPE, LABELS = "_id", "_src", "_dst", "_type", "_labels"
RESERVED = (ID, SRC, DST, TYPE, LABELS)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class NodeTable:
    label: str | None
    df: DataFrame
    properties: dict[str, str]  # name -> property type, in the order of columns
    rows: int | None = None
    has_labels: bool = False


@dataclass
class RelTable:
    type: str
    df: DataFrame
    properties: dict[str, str]
    rows: int | None = None
    src_labels: set[str] | None = None
    dst_labels: set[str] | None = None
    src_all: set[str] = field(default_factory=set)
    dst_all: set[str] = field(default_factory=set)
    ends_exist: bool = False  # every source and every target is a node of the graph
    sources: int | None = None  # how many nodes are a source, or a target
    targets: int | None = None


def _properties(df: DataFrame, what: str) -> dict[str, str]:
    out = {f.name: t.of_spark(f.dataType, f.name) for f in df.schema.fields if f.name not in RESERVED}
    if len({x.lower() for x in out}) < len(out) and df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        raise GraphError(f"{what} has properties that differ only in case; set spark.sql.caseSensitive to true before opening it")
    return out


class Graph:
    """A property graph over DataFrames; nothing is read until a query's result is."""

    def __init__(self, spark: SparkSession, nodes: Iterable[NodeTable], rels: Iterable[RelTable], manifest: m.Manifest | None = None):
        self.spark = spark
        self.nodes = {n.label: n for n in sorted(nodes, key=lambda n: (n.label is not None, n.label or ""))}
        self.rels = {r.type: r for r in sorted(rels, key=lambda r: r.type)}
        self.manifest = manifest
        self.root: str | None = None  # of a graph that was opened

    # Making one.

    @staticmethod
    def open(spark: SparkSession, root: str) -> Graph:
        """A graph folder, as ``GraphWriter`` leaves it; single-file tables and unsigned ids are read as well."""
        root = root.rstrip("/")
        manifest = m.load(spark, root)
        nodes, rels = [], []
        for n in manifest.nodes:
            df = spark.read.parquet(f"{root}/{n.file}")
            df = df.withColumn(ID, df[ID].cast("long"))
            nodes.append(NodeTable(n.label, df, {p.name: p.type for p in n.schema}, n.row_count, LABELS in df.columns))
            _properties(df, n.file)
        for r in manifest.relationships:
            df = spark.read.parquet(f"{root}/{r.file}")
            df = df.withColumns({c: df[c].cast("long") for c in (ID, SRC, DST)})
            rels.append(RelTable(r.type, df, {p.name: p.type for p in r.schema}, r.row_count, set(r.src_labels), set(r.dst_labels), set(r.src_all), set(r.dst_all)))
            _properties(df, r.file)
        graph = Graph(spark, nodes, rels, manifest)
        graph.root = root
        return graph

    @staticmethod
    def from_dataframes(
        spark: SparkSession,
        nodes: Mapping[str | None, DataFrame],
        relationships: Mapping[str, DataFrame],
        rows: Mapping[str | None, int] | None = None,
        endpoints: Mapping[str, tuple[Iterable[str], Iterable[str]]] | None = None,
        degrees: Mapping[str, tuple[int, int, int]] | None = None,
    ) -> Graph:
        """Node tables have ``_id``, relationship tables ``_id, _src, _dst``; all other columns are properties.

        A node of several labels is in the table of each.  A column ``_labels`` with the
        sorted labels of each node, if all node tables have it, spares joins.  ``rows``,
        and for each type ``degrees`` (relationships, different sources, different
        targets), are estimates for the join order.  ``endpoints`` declares for a type
        that every source and every target is a node of the graph and has these labels
        (there may be none), so nodes that nothing else is asked of need not be read.
        """
        known, sure, sizes = dict(rows or {}), dict(endpoints or {}), dict(degrees or {})
        tables = [NodeTable(label, df, _properties(df, f"the table of `{label}`"), known.get(label), LABELS in df.columns) for label, df in nodes.items()]
        rels = []
        for kind, df in relationships.items():
            src, dst = (set(x) for x in sure.get(kind, ((), ())))
            n, sources, targets = sizes.get(kind, (None, None, None))
            rels.append(RelTable(kind, df, _properties(df, f"the table of `{kind}`"), n, src_all=src, dst_all=dst, ends_exist=kind in sure, sources=sources, targets=targets))
        return Graph(spark, tables, rels)

    # What the binder asks.

    def labels(self) -> dict[str | None, int | None]:
        return {x: n.rows for x, n in self.nodes.items()}

    def types(self) -> list[str]:
        return list(self.rels)

    def endpoint_labels(self, type_: str, source: bool) -> set[str] | None:
        return self.rels[type_].src_labels if source else self.rels[type_].dst_labels

    def every_endpoint_has(self, type_: str, source: bool) -> set[str]:
        return self.rels[type_].src_all if source else self.rels[type_].dst_all

    def endpoint_exists(self, type_: str, source: bool) -> bool:
        return self.rels[type_].ends_exist or bool(self.every_endpoint_has(type_, source))

    def degrees(self, type_: str) -> tuple[int | None, int | None, int | None]:
        r = self.rels[type_]
        return r.rows, r.sources, r.targets

    # Scans.

    @property
    def labels_stored(self) -> bool:
        return all(n.has_labels for n in self.nodes.values())

    def node_table(self, label: str | None) -> DataFrame:
        if label not in self.nodes:
            raise GraphError(f"unknown label `{label}`")
        return self.nodes[label].df

    def rel_table(self, type_: str) -> DataFrame:
        if type_ not in self.rels:
            raise GraphError(f"unknown relationship type `{type_}`")
        return self.rels[type_].df

    def label_lookup(self) -> DataFrame:
        """``_id, _labels`` of every node, for graphs whose tables do not store the labels."""
        parts = [n.df.select(F.col(ID), F.lit(x).cast("string").alias("label")) for x, n in self.nodes.items()]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.union(p)
        return whole.groupBy(ID).agg(F.sort_array(F.collect_set("label")).alias(LABELS))

    def query(self, text: str) -> QueryBuilder:  # noqa: F821
        from graphtables.query import QueryBuilder

        return QueryBuilder(self, text)
