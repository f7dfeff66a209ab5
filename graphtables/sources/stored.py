"""A part of the star-schema graph as a folder, written by ``GraphWriter`` and opened again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphtables.sources import manifest as m
from graphtables.sources.graph import LABELS, Graph
from graphtables.sources.star import STEP
from graphtables.sources.writer import GraphWriter

_written: dict[tuple[str, str, bool], str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder where all executors can read it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"


def _write(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions and nations row by row, all else as DataFrames; suppliers have whole ratings, customers have fractions."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    writer = GraphWriter(spark, _folder(spark), first_id=1)
    regions = {r.r_regionkey: writer.add_node(["Region"], {"key": r.r_regionkey, "name": r.r_name}) for r in read("region").collect()}
    for r in read("nation").orderBy("n_nationkey").collect():
        node = writer.add_node(["Nation"], {"key": r.n_nationkey, "name": r.n_name})
        writer.add_relationship(node, regions[r.n_regionkey], "IN_REGION", {})
        if r.n_nationkey == 0:
            first = node
    step = 2  # each nation takes an id for itself and one for its relationship
    for label, ordinal, key, name, balance, nation, rating in (
        ("Supplier", 4, "s_suppkey", "s_name", "s_acctbal", "s_nationkey", F.col("s_suppkey").cast("long") % 7),
        ("Customer", 3, "c_custkey", "c_name", "c_acctbal", "c_nationkey", F.col("c_acctbal") / 2),
    ):
        df = read(label.lower())
        node = F.lit(ordinal * STEP) + F.col(key)
        nodes = df.select(node.alias("id"), F.col(key).cast("long").alias("key"), F.col(name).alias("name"), F.col(balance).alias("acctbal"), rating.alias("rating"))
        writer.add_nodes(nodes.filter("acctbal < 0"), ["Debtor", label], "id")
        writer.add_nodes(nodes.filter("acctbal >= 0"), [label], "id")
        writer.add_relationships(df.select(node.alias("src"), (F.lit(first) + step * F.col(nation)).alias("dst"), (F.col(key).cast("long") % 5).alias("share")), "IN_NATION", "src", "dst")
    writer.add_nodes(read("benchmark").select((F.lit(9 * STEP) + F.col("item_id")).alias("id"), F.col("item_id").cast("long").alias("key")), [], "id")
    return writer.write()


def stored_star(spark: SparkSession, sf_dir: str, labels: bool = True) -> Graph:
    """The folder, opened; without ``labels`` a copy whose tables do not tell the labels of a node.  Written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, labels)
    if key not in _written:
        if labels:
            _written[key] = _write(spark, sf_dir).root
        else:
            graph, root = stored_star(spark, sf_dir), _folder(spark)
            for entry in graph.manifest.nodes:
                graph.node_table(entry.label).drop(LABELS).write.parquet(f"{root}/{entry.file}")
            for entry in graph.manifest.relationships:
                graph.rel_table(entry.type).write.parquet(f"{root}/{entry.file}")
            m.save(spark, root, graph.manifest)
            _written[key] = root
    return Graph.open(spark, _written[key])
