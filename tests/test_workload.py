"""Every workload query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphtables.sources.star import star_graph
from graphtables.streaming import with_stream
from graphtables.workload import CASES, FLAGSHIP, OPENED, ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def graph(spark):
    return star_graph(spark, DATA)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES.split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*CASES, *OPENED])
def test_sql(spark, graph, duck, name):
    df = CASES[name].run(graph) if name in CASES else QUERIES[name](spark, DATA)
    got = df.collect()
    wanted = duck.sql(ORACLE_SQL[name])
    columns, rows = wanted.columns, wanted.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got), key=str) == sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=str)


def test_whole_tables(graph, duck):
    edges = duck.sql("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer))").fetchall()[0][0]
    assert CASES["expand_any_type"].run(graph).count() == edges
    marked = duck.sql("SELECT count(quality) FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id").fetchall()[0][0]
    assert sum(len(r.marks) for r in CASES["collect_skips_null"].run(graph).collect()) == marked > 50


@pytest.mark.parametrize("name", ["order_nulls_asc", "order_nulls_desc"])
def test_order_of_whole_table(graph, duck, name):
    """Row by row: without a limit, only the sequence shows where nulls go."""
    got = [(r.key, r.quality) for r in CASES[name].run(graph).collect()]
    assert got == duck.sql(ORACLE_SQL[name]).fetchall()
    assert {q for _, q in got} == {0, 1, None}


def test_flagship(graph):
    rows = FLAGSHIP.run(graph).collect()
    assert len(rows) == 10 and [r.price for r in rows] == sorted((r.price for r in rows), reverse=True)


def test_stream(spark, graph, tmp_path):
    edges = graph.rel_table("PLACED").withColumn("w", graph.rel_table("PLACED")["_id"] % 7)
    edges.write.parquet(str(tmp_path / "edges"))
    stream = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "edges"))
    text = "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE r.w = 3 AND o.status = 'F' RETURN c.name AS name, o.key AS key"
    live = with_stream(graph, "PLACED", stream).query(text).df()
    assert live.isStreaming
    q = live.writeStream.format("memory").queryName("placed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rest = with_stream(graph, "PLACED", edges).query(text).df()
    assert sorted(spark.table("placed").collect()) == sorted(rest.collect()) != []
