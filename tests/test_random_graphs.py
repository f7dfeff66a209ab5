"""Patterns on random multigraphs against a matcher that tries everything."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphtables import Graph

TEMPLATES = [
    ([("a", "A"), ("b", None)], [("r", ["R"], "right", 0, 1)]),
    ([("a", "A"), ("b", None)], [("r", ["R", "S"], "both", 0, 1)]),
    ([("a", None), ("b", "B"), ("c", None)], [("r", [], "left", 0, 1), ("q", ["R"], "both", 1, 2)]),
    ([("a", None), ("b", None), ("c", None)], [("r", ["R"], "right", 0, 1), ("q", ["R"], "right", 1, 2), ("p", [], "both", 2, 0)]),
    ([("a", "A")], [("r", [], "both", 0, 0)]),
    ([("a", "B"), ("b", "A"), ("c", None)], [("r", ["S"], "both", 0, 1)]),
    ([("a", "A"), ("b", None), ("c", "B")], [("r", ["R"], "both", 0, 1), ("q", ["S"], "both", 1, 2), ("p", ["R", "S"], "left", 2, 0)]),
    ([("a", None), ("b", "A"), ("c", None), ("d", None)], [("r", ["R"], "right", 0, 1), ("q", [], "both", 1, 2), ("p", ["S"], "left", 2, 3), ("o", [], "both", 3, 0)]),
]


def brute(nodes, edges, template):
    variables, rels = template
    out = []
    for ids in itertools.product(nodes, repeat=len(variables)):
        if any(label and label not in nodes[i] for i, (_, label) in zip(ids, variables)):
            continue
        choices = []
        for _, types, way, x, y in rels:
            fits = []
            for k, (s, d, kind) in edges.items():
                if types and kind not in types:
                    continue
                forward, backward = (s, d) == (ids[x], ids[y]), (d, s) == (ids[x], ids[y])
                if (way == "right" and forward) or (way == "left" and backward) or (way == "both" and (forward or backward)):
                    fits.append(k)
            choices.append(fits)
        out += [(*ids, *ks) for ks in itertools.product(*choices) if len(set(ks)) == len(ks)]
    return sorted(out)


def cypher(template):
    variables, rels = template
    node = lambda k: f"({variables[k][0]}{':' + variables[k][1] if variables[k][1] else ''})"
    arrow = {"right": ("-", "->"), "left": ("<-", "-"), "both": ("-", "-")}
    parts = [f"{node(x)}{arrow[w][0]}[{r}{':' + '|'.join(t) if t else ''}]{arrow[w][1]}{node(y)}" for r, t, w, x, y in rels]
    used = {k for *_, x, y in rels for k in (x, y)}
    parts += [node(k) for k in range(len(variables)) if k not in used]
    return "MATCH " + ", ".join(parts) + " RETURN " + ", ".join([f"id({v}) AS {v}" for v, _ in variables] + [f"id({r[0]}) AS {r[0]}" for r in rels])


@pytest.mark.parametrize("seed", range(4))
def test_patterns(spark, seed):
    rng = random.Random(seed)
    nodes = {i: sorted(x for x in "AB" if rng.random() < 0.55) for i in range(6)}
    edges = {100 + k: (rng.randrange(6), rng.randrange(6), rng.choice("RS")) for k in range(11)}
    tables = {x: [(i, labels) for i, labels in nodes.items() if (x in labels if x else not labels)] for x in ("A", "B", None)}
    node_frames = {x: spark.createDataFrame(rows, "_id long, _labels array<string>") for x, rows in tables.items()}
    rel_frames = {t: spark.createDataFrame([(k, s, d) for k, (s, d, kind) in edges.items() if kind == t], "_id long, _src long, _dst long") for t in "RS"}
    stored = Graph.from_dataframes(spark, node_frames, rel_frames)
    plain = Graph.from_dataframes(spark, {x: df.select("_id", F.col("_id").alias("key")) for x, df in node_frames.items()}, rel_frames)
    for template in TEMPLATES:
        wanted = brute(nodes, edges, template)
        for graph in (stored, plain):
            assert sorted(tuple(r) for r in graph.query(cypher(template)).df().collect()) == wanted
