import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from graphtables import Graph, GraphError, GraphWriter
from graphtables.cli import main, parse_param, schema_text
from graphtables.functions import types as t
from graphtables.sources.neo4j import Export, decode
from graphtables.sources.values import text_of


@pytest.fixture
def writer(spark, tmp_path):
    return GraphWriter(spark, f"file://{tmp_path}/g")


def schema(entry):
    return {p.name: (p.type, p.coerced) for p in entry.schema}


def test_multi_label(writer):
    writer.add_node(["Person", "Actor"], {"name": "Ada"})
    writer.add_node(["Person"], {"name": "Cy"})
    g = writer.write()
    assert [(n.label, n.row_count) for n in g.manifest.nodes] == [("Actor", 1), ("Person", 2)]
    assert [r._id for r in g.node_table("Actor").collect()] == [0]
    with pytest.raises(GraphError):
        g.node_table("Nope")
    with pytest.raises(GraphError):
        g.rel_table("Nope")


def test_widening(writer):
    writer.add_node(["A"], {"n": 1, "s": 1})
    writer.add_node(["B"], {"n": 2.5, "s": "x"})
    writer.add_node(["C"], {"k": 3})
    g = writer.write()
    a, b, c = g.manifest.nodes
    assert schema(a) == schema(b) == {"n": ("float64", True), "s": ("string", True)}
    assert schema(c) == {"k": ("int64", False)}
    assert [tuple(r)[2:] for r in g.node_table("A").collect()] == [(1.0, "1")]


def test_temporal_and_lists(writer):
    writer.add_node(["T"], {"day": dt.date(2001, 2, 3), "at": dt.datetime(1970, 1, 1, tzinfo=dt.UTC), "ints": [1, 2], "empty": [], "mixed": [1, 2.5], "text": [dt.date(2000, 1, 1), "x"]})
    writer.add_node(["T"], {"ints": []})
    g = writer.write()
    assert {k: v[0] for k, v in schema(g.manifest.nodes[0]).items()} == {"day": "date", "at": "datetime_utc", "ints": "list_int64", "empty": "list_string", "mixed": "list_float64", "text": "list_string"}
    assert not any(v[1] for v in schema(g.manifest.nodes[0]).values())
    rows = sorted(g.node_table("T").collect(), key=lambda r: r._id)
    assert (rows[0].ints, rows[0].empty, rows[0].mixed, rows[0].text, rows[1].ints) == ([1, 2], [], [1.0, 2.5], ["2000-01-01", "x"], [])


def test_empty_lists_among_scalars(writer):
    writer.add_node(["A"], {"n": 1, "s": "x"})
    writer.add_node(["A"], {"n": [], "s": []})
    rows = sorted(writer.write().node_table("A").collect(), key=lambda r: r._id)
    assert (rows[1].n, rows[1].s) == (None, "[]")


def test_relationships(writer):
    a, b = writer.add_node(["A"], {}), writer.add_node(["B"], {})
    for s, d in ((b, a), (a, a), (a, b), (a, b)):
        writer.add_relationship(s, d, "R", {})
    g = writer.write()
    (r,) = g.manifest.relationships
    assert (r.row_count, r.src_labels, r.dst_labels, r.src_all) == (4, ["A", "B"], ["A", "B"], [])
    assert sorted((x._id, x._src, x._dst) for x in g.rel_table("R").collect()) == [(2, 1, 0), (3, 0, 0), (4, 0, 1), (5, 0, 1)]


def test_chunks(writer):
    for _ in range(50_000):
        writer.add_node(["A"], {"n": 1})
    writer.add_node(["A"], {"n": 2.5, "late": True})
    g = writer.write()
    assert g.manifest.nodes[0].row_count == 50_001 and schema(g.manifest.nodes[0])["n"] == ("float64", True)
    assert g.node_table("A").agg(F.count("late"), F.sum("n")).first()[:] == (1, 50_002.5)


def test_floats(writer):
    values = [math.nan, math.inf, -math.inf]
    for v in values:
        writer.add_node(["A"], {"x": v, "l": [v, 1.0]})
    rows = sorted(writer.write().node_table("A").collect(), key=lambda r: r._id)
    assert str([r.x for r in rows]) == str(values) and str([r.l[0] for r in rows]) == str(values)


def test_file_names(writer):
    for labels in (["Person"], ["PERSON"], ["a/../b"], ["_unlabeled"], []):
        writer.add_node(labels, {})
    files = {n.label: n.file for n in writer.write().manifest.nodes}
    assert files == {None: "nodes/_unlabeled.parquet", "PERSON": "nodes/PERSON.parquet", "Person": "nodes/Person-1.parquet", "_unlabeled": "nodes/_unlabeled-1.parquet", "a/../b": "nodes/a____b.parquet"}


def test_refusals(spark, writer, tmp_path):
    with pytest.raises(GraphError, match="property name `_id` is reserved"):
        writer.add_node(["A"], {"_id": 1})
    with pytest.raises(GraphError):
        writer.add_node(["A"], {"x": object()})
    with pytest.raises(GraphError, match="no graph"):
        Graph.open(spark, f"file://{tmp_path}/none")
    writer.add_node(["A"], {})
    writer.write()
    path = tmp_path / "g" / "manifest.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"version": 1}))
    (tmp_path / "g" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(GraphError, match="layout version 1, but only version 0 is supported"):
        Graph.open(spark, f"file://{tmp_path}/g")


def test_names_that_differ_in_case(writer):
    writer.add_node(["A"], {"x": 1, "X": 2})
    with pytest.raises(GraphError, match="caseSensitive"):
        writer.write()


def test_dataframes(spark, writer):
    people = spark.createDataFrame([(1, "a", 1.5, ["x"]), (2, "b", None, None)], "pid int, name string, score float, tags array<string>")
    writer.add_nodes(people, ["Person", "Thing"], "pid")
    writer.add_nodes(spark.createDataFrame([(7, "7")], "_id long, score string"), [])
    edges = spark.createDataFrame([(1, 2, 3), (2, 7, 4)], "a int, b int, w int")
    writer.add_relationships(edges, "R", "a", "b")
    g = writer.write()
    assert [n.label for n in g.manifest.nodes] == [None, "Person", "Thing"]
    assert schema(g.manifest.nodes[1])["score"] == ("string", True)
    rows = sorted(tuple(r) for r in g.query("MATCH (a:Person)-[r:R]->(b) RETURN a.name, a.score, r.w, labels(b)").df().collect())
    assert rows == [("a", "1.5", 3, ["Person", "Thing"]), ("b", None, 4, [])]
    assert g.rel_table("R").select("_id").distinct().count() == 2


def test_texts(spark):
    floats = [3.0, 2.5, 12345678.0, 1.2345678912e9, 1e22, 1.5e-7, -0.0, -1e7, 0.001, math.inf, -math.inf, math.nan, 123456789.125]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in floats], "x double").select(t.float_text(F.col("x"))).collect()]
    assert got == [text_of(x) for x in floats]
    assert got[:5] == ["3.0", "2.5", "12345678.0", "1234567891.2", "10000000000000000000000.0"]
    row = spark.sql("SELECT date'1970-01-01' d, timestamp'1970-01-01 00:00:00Z' u, timestamp_ntz'2001-02-03 19:30:00.25' l, array(1, 2) i, array(1.5D) f, true b")
    kinds = {"d": t.DATE, "u": t.UTC, "l": t.LOCAL, "i": "list_int64", "f": "list_float64", "b": t.BOOL}
    assert list(row.select(*(t.text(F.col(c), k) for c, k in kinds.items())).first()) == ["1970-01-01", "1970-01-01T00:00:00Z", "2001-02-03T19:30:00.250", "[1, 2]", "[1.5]", "true"]
    assert text_of(dt.datetime(1970, 1, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=1)))) == "1970-01-01T00:00:00Z"


def test_unify():
    assert t.unify(t.INT, t.FLOAT) == t.FLOAT and t.unify("list_int64", "list_float64") == "list_float64"
    assert t.unify("list_int64", "list_string") == "list_string" and t.unify(t.DATE, t.UTC) == t.STRING and t.unify(t.INT, "list_int64") == t.STRING


def test_foreign_layout(spark, tmp_path):
    """Single files, unsigned ids, and no stored labels."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "nodes").mkdir()
    (tmp_path / "relationships").mkdir()
    ids = lambda *x: pa.array(x, pa.uint64())
    pq.write_table(pa.table({"_id": ids(0, 1), "n": pa.array([1, 2], pa.int64())}), tmp_path / "nodes" / "A.parquet")
    pq.write_table(pa.table({"_id": ids(1), "n": pa.array([2], pa.int64())}), tmp_path / "nodes" / "B.parquet")
    pq.write_table(pa.table({"_id": ids(2), "_src": ids(0), "_dst": ids(1)}), tmp_path / "relationships" / "R.parquet")
    prop = [{"name": "n", "type": "int64", "coerced": False}]
    nodes = [{"label": x, "file": f"nodes/{x}.parquet", "row_count": n, "schema": prop} for x, n in (("A", 2), ("B", 1))]
    rels = [{"type": "R", "file": "relationships/R.parquet", "row_count": 1, "src_labels": ["A"], "dst_labels": ["A", "B"], "schema": []}]
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 0, "nodes": nodes, "relationships": rels}))
    g = Graph.open(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in g.query("MATCH (a)-[r:R]->(b:A:B) RETURN id(a), a.n, id(b), labels(b), count(*) AS c").df().collect()] == [(0, 1, 1, ["A", "B"], 1)]


class FakeReader:
    def __init__(self, nodes, rels):
        self.nodes, self.rels = nodes, rels

    def __call__(self, export):
        return self

    def __enter__(self):
        return iter(self.nodes), iter(self.rels)

    def __exit__(self, *_):
        return False


def test_export(spark, tmp_path, capsys):
    nodes = [("x", ["A"], {"n": 1, "gone": None}), ("y", ["B"], {"n": "two"})]
    export = Export("bolt://nowhere", FakeReader(nodes, [("x", "y", "R", {"w": [1, None, 2]})])).user("u").password("p").database("d")
    g = export.write(spark, f"file://{tmp_path}/e")
    assert (export.auth, export.db) == (("u", "p"), "d")
    assert [tuple(r) for r in g.query("MATCH (a:A)-[r]->(b) RETURN a.n, r.w, b.n").df().collect()] == [("1", [1, 2], "two")]
    with pytest.raises(GraphError, match="not among the nodes"):
        Export("", FakeReader(nodes, [("x", "z", "R", {})])).write(spark, f"file://{tmp_path}/f")
    assert main(["schema", f"file://{tmp_path}/e"], spark) == 0
    said = capsys.readouterr().out
    assert "layout version 0" in said and "    n: String (coerced)" in said and 'R (1 rows, ["A"] -> ["B"])' in said
    assert main(["query", f"file://{tmp_path}/e", "MATCH (a:A) WHERE a.n = $n RETURN a.n AS n", "--param", "n='1'"], spark) == 0
    assert "|1  |" in capsys.readouterr().out
    assert main(["query", f"file://{tmp_path}/e", "MATCH (a:A) RETURN a.n", "--explain"], spark) == 0
    assert "logical plan:" in capsys.readouterr().out
    assert main(["query", f"file://{tmp_path}/e", "MATCH (a:Z) RETURN a"], spark) == 1
    assert "error: unknown label `Z`" in capsys.readouterr().err
    assert schema_text(g).count("rows") == 3


def test_keyed_rows(spark, tmp_path, monkeypatch):
    """Keys over many chunks, relationships before their nodes, of one type by key and by id, with clashing names."""
    monkeypatch.setattr("graphtables.sources.writer.CHUNK", 7)
    w = GraphWriter(spark, f"file://{tmp_path}/g")
    for k in range(40):
        w.add_keyed_relationship(f"n{k}", f"n{(k * 3 + 1) % 40}", "R", {"c0": k, "key": str(k), "a": k % 2 == 0} if k % 4 else {"rel": [k]})
    ids = {f"n{k}": w.add_keyed_node(f"n{k}", ["A"] if k % 2 else ["A", "B"], {"k": k}) for k in range(40)}
    w.add_relationship(ids["n0"], ids["n39"], "R", {"c0": 99})
    g = w.write()
    got = {tuple(r) for r in g.query("MATCH (x:A)-[r:R]->(y:A) RETURN x.k, y.k, r.c0, r.key, r.a").df().collect()}
    assert got == {(k, (k * 3 + 1) % 40, *((k, str(k), k % 2 == 0) if k % 4 else (None,) * 3)) for k in range(40)} | {(0, 39, 99, None, None)}
    assert {tuple(r.rel) for r in g.query("MATCH ()-[r:R]->() WHERE r.rel IS NOT NULL RETURN r.rel AS rel").df().collect()} == {(k,) for k in range(0, 40, 4)}
    w = GraphWriter(spark, f"file://{tmp_path}/twice")
    w.add_keyed_node("x", ["A"], {})
    w.add_keyed_node("x", ["A"], {})
    w.add_keyed_relationship("x", "x", "R", {})
    with pytest.raises(GraphError, match="2 nodes have the key `x`"):
        w.write()
    w = GraphWriter(spark, f"file://{tmp_path}/none")
    w.add_keyed_relationship("x", "y", "R", {})
    with pytest.raises(GraphError, match="not among the nodes"):
        w.write()


def test_decode():
    assert decode(dt.datetime(1970, 1, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=1)))) == dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    assert (decode(42), decode(None), decode(dt.date(1970, 1, 11)), decode(b"\x01\x02"), decode([1, None])) == (42, None, dt.date(1970, 1, 11), [1, 2], [1])
    assert decode(dt.time(1, 2)) == "01:02:00"
    with pytest.raises(GraphError):
        decode({"a": 1})


def test_params():
    wanted = {"a='1'": "1", 'a="x"': "x", "a=5": 5, "a=-1.5e3": -1500.0, "a=TRUE": True, "a=null": None, "a=nan": "nan", "a=inf": "inf", "a=x=y": "x=y", "a=": ""}
    assert {k: parse_param(k)[1] for k in wanted} == wanted
    with pytest.raises(GraphError):
        parse_param("novalue")
