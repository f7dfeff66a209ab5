"""Queries over relationships that arrive as a stream.

A relationship table may be a streaming DataFrame, which expands over node tables at
rest as a stream-static join.  What Structured Streaming cannot do with a query (sorting
rows that are not aggregated, for one) it says itself when the query starts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from graphtables.sources.graph import Graph, _properties


def with_stream(graph: Graph, type_: str, stream: DataFrame) -> Graph:
    """``graph`` with the relationships of a type (``_id, _src, _dst`` and properties) coming from ``stream``."""
    table = replace(graph.rels[type_], df=stream, properties=_properties(stream, f"the stream of `{type_}`"), rows=None, src_labels=None, dst_labels=None, src_all=set(), dst_all=set())
    return Graph(graph.spark, graph.nodes.values(), [*(r for r in graph.rels.values() if r.type != type_), table])
