"""Command line: ``export``, ``schema`` and ``query``."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

from graphtables.errors import GraphError
from graphtables.functions import types as t
from graphtables.sources.graph import Graph
from graphtables.sources.manifest import PropertySchema
from graphtables.sources.neo4j import Export

_NAMES = {t.BOOL: "Boolean", t.INT: "Int64", t.FLOAT: "Float64", t.STRING: "String", t.DATE: "Date", t.UTC: "Datetime { utc: true }", t.LOCAL: "Datetime { utc: false }"}


def type_name(kind: str) -> str:
    return f"List{_NAMES[t.ELEMENTS[kind]]}" if t.is_list(kind) else _NAMES[kind]


def parse_param(text: str) -> tuple[str, object]:
    """``name=value``: quoted values are strings, then integers, floats, booleans and null are tried."""
    key, found, value = text.partition("=")
    if not found:
        raise GraphError(f"expected `key=value`, got `{text}`")
    if len(value) >= 2 and value[0] in "'\"" and value[-1] == value[0]:
        return key, value[1:-1]
    if re.fullmatch(r"[+-]?[0-9]+", value) and -(2**63) <= int(value) < 2**63:
        return key, int(value)
    if re.fullmatch(r"[0-9+\-.eE]+", value):
        try:
            return key, float(value)
        except ValueError:
            return key, value
    return key, {"true": True, "false": False, "null": None}.get(value.lower(), value)


def schema_text(graph: Graph) -> str:
    manifest = graph.manifest
    out = [f"layout version {manifest.version}", "", "node tables:"]
    properties = lambda schema: [f"    {p.name}: {type_name(p.type)}{' (coerced)' if p.coerced else ''}" for p in schema]
    for n in manifest.nodes:
        out += [f"  {'(unlabeled)' if n.label is None else n.label} ({n.row_count} rows)", *properties(n.schema)]
    out += ["", "relationship tables:"]
    listed = lambda labels: "[" + ", ".join(f'"{x}"' for x in labels) + "]"
    for r in manifest.relationships:
        out += [f"  {r.type} ({r.row_count} rows, {listed(r.src_labels)} -> {listed(r.dst_labels)})", *properties(r.schema)]
    return "\n".join(out)


def _export(spark: SparkSession, args: argparse.Namespace) -> None:
    graph = Export(args.uri).user(args.user).password(args.password).database(args.database).write(spark, args.folder)
    manifest = graph.manifest
    print(f"exported {len(manifest.nodes)} node table(s), {len(manifest.relationships)} relationship table(s):")
    widened: set[str] = set()
    for table in [*manifest.nodes, *manifest.relationships]:
        print(f"  {table.file}: {table.row_count} rows")
        widened |= {p.name for p in table.schema if isinstance(p, PropertySchema) and p.coerced}
    for name in sorted(widened):
        print(f"warning: property `{name}` has mixed types and was widened", file=sys.stderr)


def _query(spark: SparkSession, args: argparse.Namespace) -> None:
    builder = Graph.open(spark, args.folder).query(args.query)
    for text in args.param:
        builder.parameter(*parse_param(text))
    if args.explain:
        print(builder.explain())
    else:
        builder.df().show(args.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphtables", description="Graph folders: export, schema and queries.")
    commands = out.add_subparsers(dest="command", required=True)
    export = commands.add_parser("export", help="export a Neo4j database to a graph folder")
    export.add_argument("uri")
    export.add_argument("folder")
    export.add_argument("--user", default=os.environ.get("NEO4J_USER", "neo4j"))
    export.add_argument("--password", default=os.environ.get("NEO4J_PASSWORD", ""))
    export.add_argument("--database", default=os.environ.get("NEO4J_DATABASE"))
    schema = commands.add_parser("schema", help="print the tables of a graph folder")
    schema.add_argument("folder")
    query = commands.add_parser("query", help="run a query and print its first rows")
    query.add_argument("folder")
    query.add_argument("query")
    query.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    query.add_argument("--explain", action="store_true")
    query.add_argument("--rows", type=int, default=1000, help="rows to print at most")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphtables").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "export":
            _export(spark, args)
        elif args.command == "schema":
            print(schema_text(Graph.open(spark, args.folder)))
        else:
            _query(spark, args)
    except (GraphError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
