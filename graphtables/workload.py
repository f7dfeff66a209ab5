"""Queries over the star-schema graph, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.sources.graph import Graph
from graphtables.sources.star import star_graph
from graphtables.sources.stored import stored_star


@dataclass(frozen=True)
class Case:
    """``rounded``: float columns and the digits that both sides are rounded to."""

    cypher: str
    sql: str
    parameters: dict[str, object] = field(default_factory=dict)
    rounded: dict[str, int] = field(default_factory=dict)

    def run(self, graph: Graph) -> DataFrame:
        builder = graph.query(self.cypher)
        for name, value in self.parameters.items():
            builder.parameter(name, value)
        df = builder.df()
        return df.withColumns({c: F.round(c, n) for c, n in self.rounded.items()}) if self.rounded else df


#: The graph as SQL: node tables n_*, relationship tables r_*.
PRELUDE = """
WITH n_region AS (SELECT 1 * 1000000000000 + r_regionkey AS id, r_regionkey::BIGINT AS key, r_name AS name FROM region),
n_nation AS (SELECT 2 * 1000000000000 + n_nationkey AS id, n_nationkey::BIGINT AS key, n_name AS name FROM nation),
n_customer AS (SELECT 3 * 1000000000000 + c_custkey AS id, c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer),
n_supplier AS (SELECT 4 * 1000000000000 + s_suppkey AS id, s_suppkey AS key, s_name AS name, s_acctbal AS acctbal FROM supplier),
n_part AS (SELECT 5 * 1000000000000 + p_partkey AS id, p_partkey AS key, p_name AS name, p_brand AS brand, p_type AS ptype, p_size::BIGINT AS psize, p_retailprice AS retailprice FROM part),
n_order AS (SELECT 6 * 1000000000000 + o_orderkey AS id, o_orderkey AS key, o_orderstatus AS status, o_totalprice AS totalprice, o_orderdate AS orderdate, o_orderpriority AS priority FROM orders),
n_event AS (SELECT 7 * 1000000000000 + event_id AS id, event_id AS key, event_type AS etype, value, ts FROM events),
n_document AS (SELECT 8 * 1000000000000 + documents.doc_id AS id, documents.doc_id AS key, lang, source, n_chars, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id),
n_unlabeled AS (SELECT 9 * 1000000000000 + item_id AS id, item_id AS key FROM benchmark),
line AS (SELECT *, l_orderkey * 1024 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem),
r_in_region AS (SELECT 100 * 1000000000000 + n_nationkey AS id, 2 * 1000000000000 + n_nationkey AS src, 1 * 1000000000000 + n_regionkey AS dst FROM nation),
r_in_nation AS (SELECT 101 * 1000000000000 + c_custkey AS id, 3 * 1000000000000 + c_custkey AS src, 2 * 1000000000000 + c_nationkey AS dst FROM customer
  UNION ALL SELECT 102 * 1000000000000 + s_suppkey, 4 * 1000000000000 + s_suppkey, 2 * 1000000000000 + s_nationkey FROM supplier),
r_placed AS (SELECT 103 * 1000000000000 + o_orderkey AS id, 3 * 1000000000000 + o_custkey AS src, 6 * 1000000000000 + o_orderkey AS dst FROM orders),
r_contains AS (SELECT 104 * 1000000000000 + n AS id, 6 * 1000000000000 + l_orderkey AS src, 5 * 1000000000000 + l_partkey AS dst, l_quantity AS quantity, l_returnflag AS returnflag, l_linenumber::BIGINT AS linenumber, l_discount AS discount FROM line),
r_supplied_by AS (SELECT 105 * 1000000000000 + n AS id, 6 * 1000000000000 + l_orderkey AS src, 4 * 1000000000000 + l_suppkey AS dst, l_quantity AS quantity, l_returnflag AS returnflag, l_linenumber::BIGINT AS linenumber, l_discount AS discount FROM line),
r_did AS (SELECT 106 * 1000000000000 + event_id AS id, 3 * 1000000000000 + user_id AS src, 7 * 1000000000000 + event_id AS dst FROM events),
n_debtor AS (SELECT id, key, name, acctbal FROM n_customer WHERE acctbal < 0 UNION ALL SELECT id, key, name, acctbal FROM n_supplier WHERE acctbal < 0),
n_all AS (SELECT id, key, name, 'Region' AS label, NULL::DOUBLE AS acctbal FROM n_region UNION ALL SELECT id, key, name, 'Nation', NULL FROM n_nation
  UNION ALL SELECT id, key, name, 'Customer', acctbal FROM n_customer UNION ALL SELECT id, key, name, 'Supplier', acctbal FROM n_supplier
  UNION ALL SELECT id, key, name, 'Part', NULL FROM n_part UNION ALL SELECT id, key, NULL, 'Order', NULL FROM n_order UNION ALL SELECT id, key, NULL, 'Event', NULL FROM n_event
  UNION ALL SELECT id, key, NULL, 'Document', NULL FROM n_document UNION ALL SELECT id, key, NULL, NULL, NULL FROM n_unlabeled),
r_all AS (SELECT id, src, dst, 'IN_REGION' AS type FROM r_in_region UNION ALL SELECT id, src, dst, 'IN_NATION' FROM r_in_nation UNION ALL SELECT id, src, dst, 'PLACED' FROM r_placed
  UNION ALL SELECT id, src, dst, 'CONTAINS' FROM r_contains UNION ALL SELECT id, src, dst, 'SUPPLIED_BY' FROM r_supplied_by UNION ALL SELECT id, src, dst, 'DID' FROM r_did)
"""

CASES: dict[str, Case] = {
    # Scans.
    "node_scan": Case("MATCH (c:Customer) RETURN c.key AS key, c.name AS name, c.mktsegment AS segment", "SELECT key, name, mktsegment AS segment FROM n_customer"),
    "node_scan_filter": Case("MATCH (o:Order) WHERE o.totalprice > 300000 AND o.status = 'F' RETURN o.key AS key, o.totalprice AS price", "SELECT key, totalprice AS price FROM n_order WHERE totalprice > 300000 AND status = 'F'"),
    "node_scan_multi_label": Case("MATCH (d:Debtor:Customer) RETURN d.key AS key, d.acctbal AS acctbal", "SELECT key, acctbal FROM n_customer WHERE acctbal < 0"),
    "node_scan_shared_label": Case("MATCH (d:Debtor) RETURN id(d) AS id, d.name AS name", "SELECT id, name FROM n_debtor"),
    "node_scan_unlabeled": Case("MATCH (n) RETURN id(n) AS id, n.name AS name", "SELECT id, name FROM n_all"),
    "node_scan_unlabeled_filter": Case("MATCH (n) WHERE n.acctbal < 100 RETURN id(n) AS id, n.acctbal AS acctbal", "SELECT id, acctbal FROM n_all WHERE acctbal < 100"),
    "labels_fn": Case("MATCH (n) RETURN size(labels(n)) AS n_labels, count(*) AS c", "SELECT (CASE WHEN label IS NULL THEN 0 ELSE 1 END + CASE WHEN acctbal < 0 THEN 1 ELSE 0 END + coalesce(good, 0) + coalesce(toxic, 0))::BIGINT AS n_labels, count(*) AS c FROM n_all LEFT JOIN (SELECT id AS did, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic FROM n_document) ON did = id GROUP BY 1"),
    "entity_node": Case("MATCH (r:Region) RETURN r, size(labels(r)) AS n", "SELECT {'_id': id, '_labels': ['Region'], 'key': key, 'name': name} AS r, 1::BIGINT AS n FROM n_region"),
    "entity_relationship": Case("MATCH (:Nation)-[r:IN_REGION]->(g:Region) RETURN r, g.name AS region", "SELECT {'_id': r_in_region.id, '_type': 'IN_REGION'} AS r, name AS region FROM r_in_region JOIN n_region ON dst = n_region.id"),
    # Patterns.
    "expand_right": Case("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name, o.key AS order_key", "SELECT c.name, o.key AS order_key FROM n_customer c JOIN r_placed r ON r.src = c.id JOIN n_order o ON o.id = r.dst"),
    "expand_left": Case("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier", "SELECT n.name AS nation, s.name AS supplier FROM n_nation n JOIN r_in_nation r ON r.dst = n.id JOIN n_supplier s ON s.id = r.src"),
    "expand_undirected": Case("MATCH (n:Nation)-[:IN_REGION]-(x) RETURN n.name AS nation, id(x) AS other", "SELECT n.name AS nation, r.dst AS other FROM n_nation n JOIN r_in_region r ON r.src = n.id"),
    "expand_multi_hop": Case("MATCH (g:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN g.name AS region, count(*) AS n_orders", "SELECT g.name AS region, count(*) AS n_orders FROM n_region g JOIN r_in_region a ON a.dst = g.id JOIN r_in_nation b ON b.dst = a.src JOIN n_customer c ON c.id = b.src JOIN r_placed p ON p.src = c.id GROUP BY 1"),
    "expand_multi_type": Case("MATCH (o:Order)-[r:CONTAINS|SUPPLIED_BY]->(x) WHERE o.totalprice > 450000 RETURN o.key AS key, type(r) AS kind, count(*) AS c", "SELECT o.key, r.type AS kind, count(*) AS c FROM n_order o JOIN r_all r ON r.src = o.id WHERE o.totalprice > 450000 AND r.type IN ('CONTAINS', 'SUPPLIED_BY') GROUP BY 1, 2"),
    "expand_any_type": Case("MATCH (c:Customer)-[r]->(x) RETURN id(r) AS rel, id(x) AS other", "SELECT r.id AS rel, r.dst AS other FROM n_customer c JOIN r_all r ON r.src = c.id"),
    "type_fn": Case("MATCH ()-[r]->() RETURN type(r) AS kind, count(*) AS c", "SELECT type AS kind, count(*) AS c FROM r_all GROUP BY 1"),
    "rel_property_filter": Case("MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity >= 45 AND l.returnflag = 'R' RETURN o.key AS key, p.name AS part, l.quantity AS quantity", "SELECT o.key, p.name AS part, l.quantity FROM n_order o JOIN r_contains l ON l.src = o.id JOIN n_part p ON p.id = l.dst WHERE l.quantity >= 45 AND l.returnflag = 'R'"),
    "inline_map_node": Case("MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.key AS key", "SELECT key FROM n_customer WHERE mktsegment = 'BUILDING'"),
    "inline_map_rel": Case("MATCH (o:Order)-[l:CONTAINS {linenumber: 7, returnflag: 'A'}]->(:Part) RETURN o.key AS key, id(l) AS line", "SELECT o.key, l.id AS line FROM n_order o JOIN r_contains l ON l.src = o.id WHERE l.linenumber = 7 AND l.returnflag = 'A'"),
    "inline_map_null": Case("MATCH (c:Customer {name: null}) RETURN count(*) AS c", "SELECT 0::BIGINT AS c"),
    "inline_map_cross_var": Case("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(c:Customer {key: s.key}) RETURN s.name AS supplier, c.name AS customer", "SELECT s.name AS supplier, c.name AS customer FROM n_supplier s JOIN r_in_nation a ON a.src = s.id JOIN r_in_nation b ON b.dst = a.dst JOIN n_customer c ON c.id = b.src WHERE c.key = s.key"),
    "cycle_close": Case(
        "MATCH (s:Supplier)-[:IN_NATION]->(n)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o)-[:SUPPLIED_BY]->(s) RETURN s.key AS supplier, c.key AS customer, count(*) AS n_lines",
        "SELECT s.key AS supplier, c.key AS customer, count(*) AS n_lines FROM n_supplier s JOIN r_in_nation a ON a.src = s.id JOIN r_in_nation b ON b.dst = a.dst JOIN n_customer c ON c.id = b.src JOIN r_placed p ON p.src = c.id JOIN r_supplied_by y ON y.src = p.dst AND y.dst = s.id GROUP BY 1, 2",
    ),
    "rel_uniqueness_anonymous": Case("MATCH (:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(:Supplier) RETURN n.name AS nation, count(*) AS pairs", "SELECT n.name AS nation, count(*) AS pairs FROM n_nation n JOIN r_in_nation a ON a.dst = n.id JOIN n_supplier s ON s.id = a.src JOIN r_in_nation b ON b.dst = n.id JOIN n_supplier t ON t.id = b.src WHERE a.id <> b.id GROUP BY 1"),
    "rel_uniqueness_across_patterns": Case("MATCH (a:Supplier)-[r:IN_NATION]->(n:Nation), (b:Supplier)-[q:IN_NATION]->(n) WHERE a.acctbal < b.acctbal RETURN n.name AS nation, count(*) AS pairs", "SELECT n.name AS nation, count(*) AS pairs FROM n_nation n JOIN r_in_nation r ON r.dst = n.id JOIN n_supplier a ON a.id = r.src JOIN r_in_nation q ON q.dst = n.id JOIN n_supplier b ON b.id = q.src WHERE r.id <> q.id AND a.acctbal < b.acctbal GROUP BY 1"),
    "two_labels_one_type": Case("MATCH (x)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS c", "SELECT n.name AS nation, count(*) AS c FROM r_in_nation r JOIN n_nation n ON n.id = r.dst GROUP BY 1"),
    "repeated_node": Case("MATCH (n:Nation)-[:IN_REGION]->(g)<-[:IN_REGION]-(m:Nation), (n)-[:IN_REGION]->(g) RETURN count(*) AS c", "SELECT 0::BIGINT AS c"),
    "cross_join": Case("MATCH (a:Region), (b:Nation) RETURN a.name AS region, b.name AS nation", "SELECT a.name AS region, b.name AS nation FROM n_region a CROSS JOIN n_nation b"),
    "theta_filter": Case("MATCH (a:Nation)-[:IN_REGION]->(g)<-[:IN_REGION]-(b:Nation) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", "SELECT a.name AS a, b.name AS b FROM n_nation a JOIN r_in_region r ON r.src = a.id JOIN r_in_region q ON q.dst = r.dst JOIN n_nation b ON b.id = q.src WHERE a.name < b.name"),
    "leftover_constant_filter": Case("MATCH (a:Region) WHERE $on AND a.key >= 0 RETURN a.name AS name", "SELECT name FROM n_region", {"on": True}),
    # Projection, order, slices.
    "project_expr": Case("MATCH (p:Part) RETURN p.key AS key, p.psize * 2 + 1 AS x, -p.psize AS y, p.retailprice > 1500.0 AS dear", "SELECT key, psize * 2 + 1 AS x, -psize AS y, retailprice > 1500 AS dear FROM n_part"),
    "default_names": Case("MATCH (r:Region) RETURN r.name, r.key + 1", 'SELECT name AS "r.name", key + 1 AS "r.key + 1" FROM n_region'),
    "distinct": Case("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT n.name AS nation, c.mktsegment AS segment", "SELECT DISTINCT n.name AS nation, c.mktsegment AS segment FROM n_customer c JOIN r_in_nation r ON r.src = c.id JOIN n_nation n ON n.id = r.dst"),
    "order_nulls_asc": Case("MATCH (d:Document) RETURN d.key AS key, d.quality AS quality ORDER BY quality, key", "SELECT key, quality FROM n_document ORDER BY quality ASC NULLS LAST, key"),
    "order_nulls_desc": Case("MATCH (d:Document) RETURN d.key AS key, d.quality AS quality ORDER BY quality DESC, key", "SELECT key, quality FROM n_document ORDER BY quality DESC NULLS FIRST, key"),
    "order_hidden_key": Case("MATCH (c:Customer) RETURN c.name AS name ORDER BY c.acctbal DESC, c.key LIMIT 10", "SELECT name FROM n_customer ORDER BY acctbal DESC, key LIMIT 10"),
    "skip_limit_params": Case("MATCH (n:Nation) RETURN n.name AS name ORDER BY name SKIP $skip LIMIT $limit", "SELECT name FROM n_nation ORDER BY name LIMIT 6 OFFSET 4", {"skip": 4, "limit": 6}),
    "topk": Case("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.name AS name, o.totalprice AS price, o.key AS key ORDER BY price DESC, key LIMIT 20", "SELECT c.name, o.totalprice AS price, o.key FROM n_customer c JOIN r_placed r ON r.src = c.id JOIN n_order o ON o.id = r.dst ORDER BY price DESC, o.key LIMIT 20"),
    # Aggregates.
    "count_star": Case("MATCH (:Customer)-[:DID]->(e:Event) RETURN e.etype AS etype, count(*) AS c", "SELECT etype, count(*) AS c FROM n_event GROUP BY 1"),
    "count_expr": Case("MATCH (d:Document) RETURN d.lang AS lang, count(d.quality) AS marked, count(*) AS c", "SELECT lang, count(quality) AS marked, count(*) AS c FROM n_document GROUP BY 1"),
    "count_distinct": Case("MATCH (d:Document) RETURN d.lang AS lang, count(DISTINCT d.source) AS sources", "SELECT lang, count(DISTINCT source) AS sources FROM n_document GROUP BY 1"),
    "count_entity": Case("MATCH (c:Customer)-[r:PLACED]->(o) RETURN c.mktsegment AS segment, count(c) AS rows_, count(DISTINCT c) AS customers, count(r) AS rels", "SELECT c.mktsegment AS segment, count(*) AS rows_, count(DISTINCT c.id) AS customers, count(*) AS rels FROM n_customer c JOIN r_placed r ON r.src = c.id GROUP BY 1"),
    "sum_int": Case("MATCH (p:Part) RETURN p.brand AS brand, sum(p.psize) AS total, sum(DISTINCT p.psize) AS kinds", "SELECT brand, sum(psize)::BIGINT AS total, sum(DISTINCT psize)::BIGINT AS kinds FROM n_part GROUP BY 1"),
    "sum_float": Case("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.mktsegment AS segment, sum(o.totalprice) AS total", "SELECT c.mktsegment AS segment, round(sum(o.totalprice), 2) AS total FROM n_customer c JOIN r_placed r ON r.src = c.id JOIN n_order o ON o.id = r.dst GROUP BY 1", rounded={"total": 2}),
    "sum_empty": Case("MATCH (c:Customer) WHERE c.acctbal > 1000000 RETURN sum(c.key) AS s, sum(c.acctbal) AS f, count(*) AS c, avg(c.acctbal) AS a, max(c.name) AS m", "SELECT 0::BIGINT AS s, 0::DOUBLE AS f, 0::BIGINT AS c, NULL::DOUBLE AS a, NULL::VARCHAR AS m"),
    "avg": Case("MATCH (o:Order) RETURN o.priority AS priority, avg(o.totalprice) AS mean", "SELECT priority, round(avg(totalprice), 4) AS mean FROM n_order GROUP BY 1", rounded={"mean": 4}),
    "min_max": Case("MATCH (s:Supplier) RETURN min(s.acctbal) AS least, max(s.acctbal) AS most, min(s.name) AS first_, max(s.key) AS last_", "SELECT min(acctbal) AS least, max(acctbal) AS most, min(name) AS first_, max(key) AS last_ FROM n_supplier"),
    "collect": Case("MATCH (n:Nation)-[:IN_REGION]->(g:Region) RETURN g.name AS region, collect(n.name) AS nations", "SELECT g.name AS region, list(n.name ORDER BY n.id) AS nations FROM n_nation n JOIN r_in_region r ON r.src = n.id JOIN n_region g ON g.id = r.dst GROUP BY 1"),
    "collect_skips_null": Case("MATCH (d:Document) RETURN d.lang AS lang, collect(d.quality) AS marks, collect(DISTINCT d.quality) AS kinds", "SELECT lang, list(quality ORDER BY id) FILTER (quality IS NOT NULL) AS marks, list(DISTINCT quality ORDER BY quality) FILTER (quality IS NOT NULL) AS kinds FROM n_document GROUP BY 1"),
    "collect_node": Case("MATCH (n:Nation)-[:IN_REGION]->(g:Region) RETURN g.name AS region, collect(n) AS nations", "SELECT g.name AS region, list({'_id': n.id, '_labels': ['Nation'], 'key': n.key, 'name': n.name} ORDER BY n.id) AS nations FROM n_nation n JOIN r_in_region r ON r.src = n.id JOIN n_region g ON g.id = r.dst GROUP BY 1"),
    "group_by_implicit": Case("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN count(*) AS c, n.name AS nation, c.mktsegment AS segment, min(c.acctbal) AS least", "SELECT count(*) AS c, n.name AS nation, c.mktsegment AS segment, min(c.acctbal) AS least FROM n_customer c JOIN r_in_nation r ON r.src = c.id JOIN n_nation n ON n.id = r.dst GROUP BY 2, 3"),
    "agg_distinct_rows": Case("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT count(*) AS c, n.key % 3 AS k", "SELECT count(*) AS c, n.key % 3 AS k FROM n_customer c JOIN r_in_nation r ON r.src = c.id JOIN n_nation n ON n.id = r.dst GROUP BY 2"),
    "order_by_aggregate": Case("MATCH (c:Customer)-[:PLACED]->(o) RETURN c.key AS key, count(*) AS c ORDER BY count(*) DESC, c.key LIMIT 15", "SELECT c.key, count(*) AS c FROM n_customer c JOIN r_placed r ON r.src = c.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    # Expressions and functions.
    "arith_int_div_mod": Case("MATCH (p:Part) RETURN p.key AS key, -p.psize / 7 AS q, -p.psize % 7 AS r, p.psize % -7 AS s", "SELECT key, -(psize // 7) AS q, -(psize % 7) AS r, psize % 7 AS s FROM n_part"),
    "arith_float": Case("MATCH (p:Part) RETURN p.key AS key, p.retailprice / 2 AS half, -7.5 % 2 AS m, p.psize * 0.5 AS f", "SELECT key, retailprice / 2 AS half, -1.5::DOUBLE AS m, psize * 0.5::DOUBLE AS f FROM n_part"),
    "precedence": Case("MATCH (r:Region) RETURN r.key AS key, 1 + 2 * r.key - 6 / 2 % 2 AS a, NOT r.key = 1 OR r.key = 1 AND r.key > 3 AS b, (1 + 2) * r.key < 7 AS c", "SELECT key, 1 + 2 * key - 1 AS a, (NOT key = 1) OR (key = 1 AND key > 3) AS b, 3 * key < 7 AS c FROM n_region"),
    "string_escapes": Case(r"""MATCH (r:Region) RETURN r.key AS key, 'a\'b\t\\' + "it's" AS s""", r"""SELECT key, 'a''b' || chr(9) || '\' || 'it''s' AS s FROM n_region"""),
    "string_concat": Case("MATCH (n:Nation)-[:IN_REGION]->(g:Region) RETURN g.name + '/' + n.name AS path", "SELECT g.name || '/' || n.name AS path FROM n_nation n JOIN r_in_region r ON r.src = n.id JOIN n_region g ON g.id = r.dst"),
    "bool_xor_3vl": Case("MATCH (d:Document) RETURN d.key AS key, d.quality = 1 XOR d.toxic = 1 AS x, d.quality = 1 AND d.lang = 'en' AS a, d.quality = 1 OR d.lang = 'en' AS o, NOT d.quality = 1 AS n", "SELECT key, (quality = 1) <> (toxic = 1) AS x, quality = 1 AND lang = 'en' AS a, quality = 1 OR lang = 'en' AS o, NOT quality = 1 AS n FROM n_document"),
    "compare_null": Case("MATCH (d:Document) WHERE d.quality <> 1 OR d.quality = null RETURN d.key AS key", "SELECT key FROM n_document WHERE quality <> 1"),
    "compare_mixed_types": Case("MATCH (r:Region) RETURN r.key AS key, r.name = 1 AS eq, r.name <> 1 AS ne, r.key = 1.0 AS num", "SELECT key, false AS eq, true AS ne, key = 1 AS num FROM n_region"),
    "is_null": Case("MATCH (d:Document) WHERE d.quality IS NULL AND d.lang IS NOT NULL RETURN d.key AS key", "SELECT key FROM n_document WHERE quality IS NULL AND lang IS NOT NULL"),
    "in_list": Case("MATCH (n:Nation) WHERE n.key IN [1, 3, 5, 99] OR n.name IN ['CHINA'] RETURN n.name AS name", "SELECT name FROM n_nation WHERE key IN (1, 3, 5, 99) OR name = 'CHINA'"),
    "in_list_null": Case("MATCH (r:Region) RETURN r.key AS key, r.key IN [1, null] AS x", "SELECT key, CASE WHEN key = 1 THEN true END AS x FROM n_region"),
    "in_empty": Case("MATCH (r:Region) WHERE NOT r.key IN [] RETURN r.name AS name", "SELECT name FROM n_region"),
    "starts_ends_contains": Case("MATCH (p:Part) RETURN p.key AS key, p.name STARTS WITH $s AS a, p.name ENDS WITH '1' AS b, p.ptype CONTAINS 'E' AS c", "SELECT key, starts_with(name, 'Part#00000001') AS a, suffix(name, '1') AS b, contains(ptype, 'E') AS c FROM n_part", {"s": "Part#00000001"}),
    "missing_property": Case("MATCH (c:Customer) WHERE c.no_such IS NULL RETURN count(*) AS c, count(c.no_such) AS n", "SELECT count(*) AS c, 0::BIGINT AS n FROM n_customer"),
    "list_literal": Case("MATCH (n:Nation) RETURN n.key AS key, [n.key, 2.5] AS l", "SELECT key, [key::DOUBLE, 2.5::DOUBLE] AS l FROM n_nation"),
    "fn_id": Case("MATCH (n:Nation)-[r:IN_REGION]->(g) RETURN id(n) AS n, id(r) AS r, id(g) AS g, n._id AS m", "SELECT src AS n, id AS r, dst AS g, src AS m FROM r_in_region"),
    "fn_coalesce": Case("MATCH (d:Document) RETURN d.key AS key, coalesce(d.quality, d.toxic, -1) AS q", "SELECT key, coalesce(quality, toxic, -1)::BIGINT AS q FROM n_document"),
    "fn_upper_lower": Case("MATCH (n:Nation) RETURN toUpper(n.name) AS u, toLower(n.name) AS l", "SELECT upper(name) AS u, lower(name) AS l FROM n_nation"),
    "fn_abs": Case("MATCH (d:Debtor) RETURN id(d) AS id, abs(d.acctbal) AS a, abs(-3) AS b", "SELECT id, abs(acctbal) AS a, 3::BIGINT AS b FROM n_debtor"),
    "fn_size_string": Case("MATCH (p:Part) RETURN p.key AS key, size(p.name) AS n", "SELECT key, length(name) AS n FROM n_part"),
    "fn_size_list": Case("MATCH (n:Nation) RETURN n.key AS key, size([1, 2, n.key]) AS n", "SELECT key, 3::BIGINT AS n FROM n_nation"),
    # Larger ones.
    "orders_by_region_and_year": Case(
        "MATCH (g:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity > 30 AND p.psize < 20 RETURN g.name AS region, o.priority AS priority, count(*) AS n_lines, sum(l.linenumber) AS s",
        "SELECT g.name AS region, o.priority, count(*) AS n_lines, sum(l.linenumber)::BIGINT AS s FROM n_region g JOIN r_in_region a ON a.dst = g.id JOIN r_in_nation b ON b.dst = a.src JOIN r_placed p ON p.src = b.src JOIN n_order o ON o.id = p.dst JOIN r_contains l ON l.src = o.id JOIN n_part t ON t.id = l.dst WHERE l.quantity > 30 AND t.psize < 20 GROUP BY 1, 2",
    ),
    "co_suppliers": Case(
        "MATCH (a:Supplier)<-[x:SUPPLIED_BY]-(o:Order)-[y:SUPPLIED_BY]->(b:Supplier) WHERE a.key < b.key RETURN a.key AS a, b.key AS b, count(*) AS c ORDER BY c DESC, a, b LIMIT 25",
        "SELECT a.key AS a, b.key AS b, count(*) AS c FROM r_supplied_by x JOIN r_supplied_by y ON y.src = x.src JOIN n_supplier a ON a.id = x.dst JOIN n_supplier b ON b.id = y.dst WHERE x.id <> y.id AND a.key < b.key GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25",
    ),
}

#: The same kind of graph, written to a folder and opened again: STORED with the labels of each node, PLAIN without, so they are looked up.
_STORED_NODES = """(SELECT key, name, ['Region'] AS labels, NULL::DOUBLE AS rating FROM n_region UNION ALL SELECT key, name, ['Nation'], NULL FROM n_nation
  UNION ALL SELECT key, name, CASE WHEN acctbal < 0 THEN ['Debtor', 'Supplier'] ELSE ['Supplier'] END, (key % 7)::DOUBLE FROM n_supplier
  UNION ALL SELECT key, name, CASE WHEN acctbal < 0 THEN ['Customer', 'Debtor'] ELSE ['Customer'] END, acctbal / 2 FROM n_customer
  UNION ALL SELECT key, NULL, []::VARCHAR[], NULL FROM n_unlabeled)"""
_OPENED: dict[str, Case] = {
    "scan": Case("MATCH (s:Supplier) RETURN s.key AS key, s.name AS name, s.acctbal AS acctbal", "SELECT key, name, acctbal FROM n_supplier"),
    "multi_label": Case("MATCH (d:Debtor:Customer) RETURN d.key AS key, d.acctbal AS acctbal, labels(d) AS labels", "SELECT key, acctbal, ['Customer', 'Debtor'] AS labels FROM n_customer WHERE acctbal < 0"),
    "labels_fn": Case("MATCH (n) RETURN labels(n) AS labels, count(*) AS c", f"SELECT labels, count(*) AS c FROM {_STORED_NODES} GROUP BY 1"),
    "widened": Case("MATCH (n) WHERE n.rating IS NOT NULL RETURN n.name AS name, n.rating AS rating", f"SELECT name, rating FROM {_STORED_NODES} WHERE rating IS NOT NULL"),
    "expand": Case(
        "MATCH (g:Region)<-[:IN_REGION]-(n)<-[r:IN_NATION]-(d:Debtor) RETURN g.name AS region, count(*) AS c, sum(r.share) AS shares, collect(DISTINCT n.name) AS nations",
        "SELECT g.name AS region, count(*) AS c, sum(d.key % 5)::BIGINT AS shares, list(DISTINCT n.name ORDER BY n.name) AS nations FROM n_debtor d JOIN r_in_nation r ON r.src = d.id JOIN n_nation n ON n.id = r.dst JOIN r_in_region q ON q.src = n.id JOIN n_region g ON g.id = q.dst GROUP BY 1",
    ),
}
OPENED = {f"{how}_{name}": (case, how == "stored") for how in ("stored", "plain") for name, case in _OPENED.items()}

FLAGSHIP = Case("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.name AS name, o.totalprice AS price ORDER BY price DESC LIMIT 10", "")


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: case.run(star_graph(spark, sf_dir))


def _opened(case: Case, labels: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: case.run(stored_star(spark, sf_dir, labels))


QUERIES = {name: _query(case) for name, case in CASES.items()} | {name: _opened(case, labels) for name, (case, labels) in OPENED.items()}
ORACLE_SQL = {name: PRELUDE + case.sql for name, case in (CASES | {name: case for name, (case, _) in OPENED.items()}).items()}
