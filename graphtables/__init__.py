"""Property graphs as Spark tables, queried with a read-only subset of Cypher."""

from graphtables.errors import BindError, CypherError, GraphError, ParseError, Span
from graphtables.query import QueryBuilder
from graphtables.sources.graph import Graph
from graphtables.sources.manifest import Manifest, NodeEntry, PropertySchema, RelEntry
from graphtables.sources.writer import GraphWriter

__all__ = ["BindError", "CypherError", "Graph", "GraphError", "GraphWriter", "Manifest", "NodeEntry", "ParseError", "PropertySchema", "QueryBuilder", "RelEntry", "Span"]
