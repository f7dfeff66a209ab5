import numpy as np
import pytest

from graphtables.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, vec binary, ids int, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, b"", 0, 0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v:
            x = np.array(v, np.float32).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                ok.setdefault(len(x), []).append((i, x))
    width = max(ok, key=lambda w: len({x.tobytes() for _, x in ok[w]}))
    pairs = sorted({(i, x.tobytes()) for i, x in ok[width]})
    ids = np.array([i for i, _ in pairs])
    x = np.array([np.frombuffer(b) for _, b in pairs])
    out = {}
    for a in np.flatnonzero(ids % 20 == 0):
        s = (x[a] * x).sum(1)
        order = [b for b in np.lexsort((ids, -s)) if ids[b] != ids[a]][:k]
        out[int(ids[a])] = [(int(ids[b]), float(s[b])) for b in order]
    return out


def found(spark, rows):
    got = {}
    for r in ann.nearest(spark, frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in g] == list(range(1, len(g) + 1)) for g in got.values())
    return {q: [(i, s) for _, i, s in g] for q, g in got.items()}


def recall(got, wanted):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in wanted.items() if w])


@pytest.mark.parametrize("shape", ["clusters", "sphere", "lengths"])
def test_recall(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24))
    if shape == "clusters":
        x = x * 0.3 + rng.normal(size=(30, 24))[rng.integers(0, 30, 6000)]
    if shape != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x *= rng.uniform(0.2, 3, size=(6000, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, wanted = found(spark, rows), brute(rows)
    assert got.keys() == wanted.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, wanted) >= 0.9
    exact = {i: np.array(v) for i, v in rows}
    for q, g in list(got.items())[:50]:
        assert all(abs(s - float((exact[q] * exact[i]).sum())) < 1e-12 for i, s in g)
        assert g == sorted(g, key=lambda p: (-p[1], p[0])) and q not in {i for i, _ in g}


def test_few_odd_and_equal(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (20, [-0.0, 2.0]), (21, [0.0, 2.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    rows += [(100 + i, [3.0, 4.0]) for i in range(50)]
    wanted = brute(rows)
    got = found(spark, rows)
    assert got == wanted and set(got) == {0, 20, 100, 120, 140}
    few = [r for r in rows if r[0] is not None and r[0] < 30]
    assert found(spark, few) == brute(few)
    assert found(spark, [(1, None)]) == {} and found(spark, []) == {}


def test_lists_in_parts(spark, monkeypatch):
    """Lists that are split for their size or for their queries lose nothing."""
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 8)).astype(np.float32).tolist())]
    wanted = found(spark, rows)
    monkeypatch.setattr(ann, "PART", 64)
    monkeypatch.setattr(ann, "ASKING", 10)
    got = found(spark, rows)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in g] for q, g in wanted.items()}


def test_no_list_within_the_ratio_is_left_out(spark, monkeypatch):
    """With a ratio that takes in all lists the search is exact, however few lists are expected."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8000, 16))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist())]
    monkeypatch.setattr(ann, "measured", lambda *_: (100.0, 1))
    assert {q: [i for i, _ in g] for q, g in found(spark, rows).items()} == {q: [i for i, _ in g] for q, g in brute(rows).items()}


@pytest.mark.parametrize("copies", [1, 3])
def test_ties_go_to_the_smaller_id(copies):
    """More vectors share the score at the cut than candidates are taken; some are in two lists."""
    rng = np.random.default_rng(7)
    y = np.unique(rng.integers(0, 2, size=(3000, 14)), axis=0).astype(float)
    y = rng.permutation(y[y.any(1)])
    ids = [sorted(i) for i in rng.permutation(len(y) * copies).reshape(-1, copies).tolist()]
    owner = rng.integers(0, 4, len(y))
    twice = rng.choice(len(y), 300, replace=False)
    y, owner, ids = np.vstack([y, y[twice]]), np.append(owner, (owner[twice] + 1) % 4), ids + [ids[t] for t in twice.tolist()]
    x = y[:40]
    wanted = [[0, 1, 2, 3] if q % 2 else [1, 2] for q in range(40)]
    for q, (scores, got) in enumerate(ann.best_of_group(x, wanted, y, owner, ids, 21)):
        at = np.flatnonzero(np.isin(owner, wanted[q])).tolist()
        best = sorted({(-float(x[q] @ y[t]), i) for t in at for i in ids[t]})[:21]
        assert list(zip(scores, got)) == [(-s, i) for s, i in best]


def test_graph_search():
    rng = np.random.default_rng(5)
    graph = ann.CentroidGraph(rng.normal(size=(500, 16)))
    x = rng.normal(size=(64, 16))
    ids, dist = graph.search(x, 10, beam=64)
    exact = ((x[:, None, :] - graph.centroids) ** 2).sum(-1)
    best = np.argsort(exact, 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, best)]) > 9.5
    assert np.allclose(np.take_along_axis(exact, ids, 1), dist, atol=1e-3)
