"""The manifest of a graph folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from graphtables.errors import GraphError
from graphtables.functions import types as t

VERSION = 0
MANIFEST = "manifest.json"


@dataclass(frozen=True)
class PropertySchema:
    name: str
    type: str
    coerced: bool = False


@dataclass
class NodeEntry:
    label: str | None
    file: str
    row_count: int
    schema: list[PropertySchema]


@dataclass
class RelEntry:
    """``src_labels``: labels that some source has; ``src_all``: labels that every source has."""

    type: str
    file: str
    row_count: int
    schema: list[PropertySchema]
    src_labels: list[str] = field(default_factory=list)
    dst_labels: list[str] = field(default_factory=list)
    src_all: list[str] = field(default_factory=list)
    dst_all: list[str] = field(default_factory=list)


@dataclass
class Manifest:
    nodes: list[NodeEntry]
    relationships: list[RelEntry]
    version: int = VERSION

    def to_json(self) -> str:
        schema = lambda s: [{"name": p.name, "type": t.to_json(p.type), "coerced": p.coerced} for p in s]
        nodes = [{"label": n.label, "file": n.file, "row_count": n.row_count, "schema": schema(n.schema)} for n in self.nodes]
        rels = [
            {"type": r.type, "file": r.file, "row_count": r.row_count, "src_labels": r.src_labels, "dst_labels": r.dst_labels, "src_all": r.src_all, "dst_all": r.dst_all, "schema": schema(r.schema)}
            for r in self.relationships
        ]
        return json.dumps({"version": self.version, "nodes": nodes, "relationships": rels}, indent=2)

    @staticmethod
    def from_json(text: str, where: str) -> Manifest:
        data = json.loads(text)
        if data["version"] != VERSION:
            raise GraphError(f"{where} has layout version {data['version']}, but only version {VERSION} is supported")
        schema = lambda s: [PropertySchema(p["name"], t.from_json(p["type"]), p.get("coerced", False)) for p in s]
        return Manifest(
            [NodeEntry(n["label"], n["file"], n["row_count"], schema(n["schema"])) for n in data["nodes"]],
            [RelEntry(r["type"], r["file"], r["row_count"], schema(r["schema"]), r.get("src_labels", []), r.get("dst_labels", []), r.get("src_all", []), r.get("dst_all", [])) for r in data["relationships"]],
        )


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load(spark: SparkSession, root: str) -> Manifest:
    """Read through Spark's file systems: a folder may be in any store that Spark reads."""
    where, fs = _fs(spark, f"{root}/{MANIFEST}")
    if not fs.exists(where):
        raise GraphError(f"no graph at {root}: {MANIFEST} is missing")
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/{MANIFEST}").collect())
    return Manifest.from_json(text, f"{root}/{MANIFEST}")


def save(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Written last, in one file: a folder without it is no graph."""
    where, fs = _fs(spark, f"{root}/{MANIFEST}")
    out = fs.create(where, True)
    try:
        out.write(bytearray(manifest.to_json().encode()))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)
