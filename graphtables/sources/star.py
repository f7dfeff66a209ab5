"""The star-schema tables (region, nation, customer, ..., events, documents) as a property graph.

Ids are ``ordinal * 10**12 + key``; nodes have ordinals 1 to 9, relationships 100 and up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphtables.sources.graph import Graph

STEP = 10**12


def _id(ordinal: int, key: str) -> Column:
    return F.lit(ordinal * STEP) + F.col(key).cast("long")


def _nodes(df: DataFrame, ordinal: int, key: str, labels: Column, **properties: str) -> DataFrame:
    return df.select(_id(ordinal, key).alias("_id"), labels.alias("_labels"), F.col(key).cast("long").alias("key"), *(F.col(c).alias(p) for p, c in sorted(properties.items())))


def _label(*names: str) -> Column:
    return F.array(*(F.lit(n) for n in names))


def _edges(df: DataFrame, ordinal: int, key: str, src: tuple[int, str], dst: tuple[int, str], **properties: str) -> DataFrame:
    return df.select(_id(ordinal, key).alias("_id"), _id(*src).alias("_src"), _id(*dst).alias("_dst"), *(F.col(c).alias(p) for p, c in sorted(properties.items())))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, customer, supplier, orders, events = map(read, ("nation", "customer", "supplier", "orders", "events"))
    debtor = lambda label, balance: F.when(F.col(balance) < 0, _label(*sorted([label, "Debtor"]))).otherwise(_label(label))
    customers = _nodes(customer, 3, "c_custkey", debtor("Customer", "c_acctbal"), name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment")
    suppliers = _nodes(supplier, 4, "s_suppkey", debtor("Supplier", "s_acctbal"), name="s_name", acctbal="s_acctbal")
    debtors = customers.filter("acctbal < 0").unionByName(suppliers.filter("acctbal < 0"), allowMissingColumns=True)
    marked = read("documents").join(read("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    kinds = F.array_compact(F.array(F.lit("Document"), F.when(F.col("quality") == 1, F.lit("Good")), F.when(F.col("toxic") == 1, F.lit("Toxic"))))
    documents = _nodes(marked, 8, "doc_id", kinds, lang="lang", source="source", n_chars="n_chars", quality="quality", toxic="toxic")
    nodes = {
        "Region": _nodes(read("region"), 1, "r_regionkey", _label("Region"), name="r_name"),
        "Nation": _nodes(nation, 2, "n_nationkey", _label("Nation"), name="n_name"),
        "Customer": customers,
        "Supplier": suppliers,
        "Debtor": debtors,
        "Part": _nodes(read("part"), 5, "p_partkey", _label("Part"), name="p_name", brand="p_brand", ptype="p_type", psize="p_size", retailprice="p_retailprice"),
        "Order": _nodes(orders, 6, "o_orderkey", _label("Order"), status="o_orderstatus", totalprice="o_totalprice", orderdate="o_orderdate", priority="o_orderpriority"),
        "Event": _nodes(events, 7, "event_id", _label("Event"), etype="event_type", value="value", ts="ts"),
        "Document": documents,
        "Good": documents.filter("quality = 1"),
        "Toxic": documents.filter("toxic = 1"),
        None: _nodes(read("benchmark"), 9, "item_id", F.array().cast("array<string>")),
    }
    line = read("lineitem")
    others = [c for c in line.columns if c != "l_orderkey"]
    # (l_orderkey, l_linenumber) repeats; the place among all lines of the order does not.
    line = line.withColumn("line", F.col("l_orderkey") * 1024 + F.row_number().over(W.partitionBy("l_orderkey").orderBy(*others)))
    lines = dict(quantity="l_quantity", extendedprice="l_extendedprice", discount="l_discount", tax="l_tax", returnflag="l_returnflag", linestatus="l_linestatus", shipdate="l_shipdate", linenumber="l_linenumber")
    relationships = {
        "IN_REGION": _edges(nation, 100, "n_nationkey", (2, "n_nationkey"), (1, "n_regionkey")),
        "IN_NATION": _edges(customer, 101, "c_custkey", (3, "c_custkey"), (2, "c_nationkey")).union(_edges(supplier, 102, "s_suppkey", (4, "s_suppkey"), (2, "s_nationkey"))),
        "PLACED": _edges(orders, 103, "o_orderkey", (3, "o_custkey"), (6, "o_orderkey")),
        "CONTAINS": _edges(line, 104, "line", (6, "l_orderkey"), (5, "l_partkey"), **lines),
        "SUPPLIED_BY": _edges(line, 105, "line", (6, "l_orderkey"), (4, "l_suppkey"), **lines),
        "DID": _edges(events, 106, "event_id", (3, "user_id"), (7, "event_id")),
    }
    # Foreign keys of the schema: these ends always exist, with these labels.
    endpoints = {
        "IN_REGION": (["Nation"], ["Region"]),
        "IN_NATION": ([], ["Nation"]),
        "PLACED": (["Customer"], ["Order"]),
        "CONTAINS": (["Order"], ["Part"]),
        "SUPPLIED_BY": (["Order"], ["Supplier"]),
        "DID": (["Customer"], ["Event"]),
    }
    # Relative sizes, for the join order only.
    rows = {"Region": 5, "Nation": 25, "Customer": 150_000, "Supplier": 10_000, "Debtor": 15_000, "Part": 200_000, "Order": 1_500_000, "Event": 1_000_000, "Document": 100_000, "Good": 30_000, "Toxic": 5_000, None: 200}
    degrees = {"IN_REGION": (25, 25, 5), "IN_NATION": (160_000, 160_000, 25), "PLACED": (1_500_000, 100_000, 1_500_000), "CONTAINS": (6_000_000, 1_500_000, 200_000), "SUPPLIED_BY": (6_000_000, 1_500_000, 10_000), "DID": (1_000_000, 150_000, 1_000_000)}
    return Graph.from_dataframes(spark, nodes, relationships, rows, endpoints, degrees)
