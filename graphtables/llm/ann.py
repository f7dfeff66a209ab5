"""Operator 2: approximate nearest neighbours by inner product, with balanced posting lists.

Inner products are searched as distances: every vector gets one more component that
makes all of them as long as the longest, and queries get a zero there.

* Centroids come from balanced hierarchical k-means over a sample (``SAMPLE`` vectors at
  most, drawn by hash); their number follows the number of vectors up to ``MOST``, so
  what is broadcast is bounded.
* Every vector goes to the list of its nearest centroid; boundary vectors also go to
  others that are hardly farther, unless such a centroid is much closer to one already
  taken than the vector is (a softened relative neighbourhood rule: the strict one
  replicates nothing where vectors have no clusters).
* Queries find centroids by best-first search in a graph of near centroids that each
  task holds in memory; lists whose centroid is more than ``ratio`` times as far as the
  nearest are pruned, as soon as the lists taken hold enough vectors.  The search ends
  at a number of lists that is enough for nearly all queries; the others are compared
  with all centroids, so no list within the ratio is left out for that number.  The ratio is
  measured: the least at which the part found of the true neighbours of ``TRIALS``
  sampled vectors, others of the sample, is ``RECALL`` on average, less two standard
  errors of that average.  They are farther than those within all vectors, so the
  measure is on the safe side.
* Lists of more than ``PART`` vectors, or with more than ``ASKING`` queries, are split
  into parts, and each query meets each part: no list is cut short.

Equal vectors are indexed once, with the ``k + 1`` smallest of their ids: no answer of k
neighbours needs more of them.  Equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm.common import Scratch, table

SAMPLE = 40_000
MOST = 4096
LIST = 256
PART = 8192
ASKING = 16_384
SALTS = 64
TRIALS = 256
RECALL = 0.97


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def taking_part(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(id, components as doubles) of the rows (id, vector) whose vectors are neither null, zero nor with a component that is null or not finite."""
    column = batch.column(1)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # nulls become NaN, -0.0 becomes 0.0
    offsets, there = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i, a, b, ok in zip(batch.column(0).to_pylist(), offsets, offsets[1:], there):
        x = values[a:b]
        if ok and x.any() and np.isfinite(x).all():
            yield i, x.tobytes()


def distinct_vectors(df: DataFrame, ids: int) -> DataFrame:
    """vec (the components as doubles) and its ``ids`` smallest ids, of rows (id, vector) that take part.

    Copies are pre-aggregated in each task and then by salt, so a vector of which there
    are very many meets in no task as more than a few thousand ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        known: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(known.keys(), pa.binary()), pa.array([salt] * len(known), pa.int32()), pa.array(known.values(), pa.list_(pa.int64()))], ["vec", "salt", "ids"])
            known.clear()
            return out

        for b in batches:
            for i, x in taking_part(b):
                if i is None:
                    continue
                own = known.setdefault(x, [])
                own.append(i)
                if len(own) > 4 * ids:
                    own[:] = sorted(own)[:ids]
            for own in known.values():
                own[:] = sorted(own)[:ids]
            if len(known) > 50_000:
                yield flush()
        if known:
            yield flush()

    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids")
    return df.mapInArrow(run, "vec binary, salt int, ids array<long>").groupBy("vec", "salt").agg(least).groupBy("vec").agg(least)


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest norm, with the component that makes them of length 1."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])


def balanced_centroids(points: np.ndarray, number: int, rng: np.random.Generator) -> np.ndarray:
    """About ``number`` centroids: clusters are split, with a price on size, until each has its share of the points."""
    if number <= 1 or len(points) <= 1:
        return points.mean(0, keepdims=True)
    b = min(16, number, len(points))
    centers = points[rng.choice(len(points), b, replace=False)].copy()
    price, sizes = 0.0, np.full(b, len(points) / b)
    for _ in range(8):
        d = (centers * centers).sum(1) - 2 * points @ centers.T
        price = price or 0.25 * max(float(np.ptp(d, axis=1).mean()), 1e-12)
        own = (d + price * (sizes / (len(points) / b) - 1)).argmin(1)
        sizes = 0.5 * sizes + 0.5 * np.bincount(own, minlength=b)
        for c in range(b):
            if (own == c).any():
                centers[c] = points[own == c].mean(0)
    if number <= 16:
        return centers
    share = [max(1, round(number * (own == c).sum() / len(points))) for c in range(b)]
    return np.vstack([balanced_centroids(points[own == c], share[c], rng) for c in range(b) if (own == c).any()])


class CentroidGraph:
    """Centroids with links to near ones; all tasks search it in memory."""

    def __init__(self, centroids: np.ndarray, links: int = 24):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        self.norms = (self.centroids**2).sum(1)
        d = self.norms[None, :] - 2 * self.centroids @ self.centroids.T
        np.fill_diagonal(d, np.inf)
        links = min(links, n - 1)
        near = np.argsort(d, axis=1)[:, :links] if links else np.zeros((n, 0), np.int64)
        # A ring makes every centroid reachable from every other.
        self.links = np.hstack([near, (np.arange(n)[:, None] + np.array([1, n - 1, 7, n // 2 + 1])) % n]).astype(np.int64)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, x: np.ndarray, most: int, beam: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest centroids found for each row of x, and their squared distances, nearest first."""
        x = x.astype(np.float32)
        n, m = len(self.centroids), len(x)
        beam = min(max(beam, most), n)
        own = (x * x).sum(1)
        seen = np.zeros((m, n), bool)
        seen[:, self.entries] = True
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        e = min(len(self.entries), beam)
        ids[:, :e] = self.entries[:e]
        dist[:, :e] = self.norms[self.entries[:e]] - 2 * x @ self.centroids[self.entries[:e]].T
        rows = np.arange(m)
        while len(rows):
            open_ = np.where(done[rows] | (ids[rows] < 0), np.inf, dist[rows])
            at = open_.argmin(1)
            go = np.isfinite(open_[np.arange(len(rows)), at])
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            done[rows, at] = True
            to = self.links[ids[rows, at]]
            fresh = ~seen[rows[:, None], to]
            seen[rows[:, None], to] = True
            d = self.norms[to] - 2 * np.einsum("md,mld->ml", x[rows], self.centroids[to])
            d = np.where(fresh, d, np.inf)
            # A link that occurs twice counts once.
            order = np.argsort(to, axis=1, kind="stable")
            sorted_to = np.take_along_axis(to, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], sorted_to[:, 1:] == sorted_to[:, :-1], 1)
            d[twice] = np.inf
            all_d = np.hstack([dist[rows], d])
            all_i = np.hstack([ids[rows], np.where(np.isfinite(d), to, -1)])
            all_o = np.hstack([done[rows], np.zeros_like(twice)])
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[rows] = np.take_along_axis(all_d, best, 1)
            ids[rows] = np.take_along_axis(all_i, best, 1)
            done[rows] = np.take_along_axis(all_o, best, 1)
        order = np.argsort(dist, axis=1)[:, :most]
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1) + own[:, None], 0)

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids for each row of x, and their squared distances, nearest first."""
        x = x.astype(np.float32)
        dist = self.norms[None, :] - 2 * x @ self.centroids.T
        order = np.argsort(dist, axis=1)
        return order, np.maximum(np.take_along_axis(dist, order, 1) + (x * x).sum(1)[:, None], 0)


def posting_lists(graph: CentroidGraph, x: np.ndarray, replicas: int, slack: float) -> list[list[int]]:
    """The lists of each row: its nearest centroid's, and those of others within ``1 + slack`` times that distance that point another way."""
    ids, dist = graph.search(x, 4 * replicas, beam=32)
    dist = np.sqrt(dist)
    out = []
    for row, d in zip(ids, dist):
        taken = [int(row[0])]
        for c, dc in zip(row[1:].tolist(), d[1:].tolist()):
            if c < 0 or dc > (1 + slack) * d[0] or len(taken) >= replicas:
                break
            gap = np.sqrt(((graph.centroids[taken] - graph.centroids[c]) ** 2).sum(1)).min()
            if dc <= 4 * gap:
                taken.append(c)
        out.append(taken)
    return out


class Index:
    """What a search needs: the centroids, the posting lists (list, part, vec, ids) and their sizes."""

    def __init__(self, graph: CentroidGraph, width: int, postings: DataFrame, sizes: dict[int, int], ratio: float, lists: int):
        self.graph, self.width, self.postings, self.sizes = graph, width, postings, sizes
        self.ratio, self.lists = ratio, lists


def build(tmp: Scratch, df: DataFrame, ids: int, replicas: int = 2, slack: float = 0.05, seed: int = 1) -> Index | None:
    """An index of all rows of ``df`` (id, vector) that take part, or None if there are none.

    Vectors of another number of components than most have take no part either.
    """
    vectors = tmp.table(distinct_vectors(df, ids), "vectors")
    widths = vectors.groupBy(F.octet_length("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return None
    width, n = widths["w"], widths["n"]
    vectors = vectors.filter(F.octet_length("vec") == width)
    rate = min(1.0, SAMPLE / n)
    sample = vectors if rate == 1 else vectors.filter(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    points = _matrix(sample.select("vec").orderBy(F.xxhash64("vec", F.lit(seed)), "vec").toArrow().column(0).cast(pa.binary()).to_pylist())

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0).to_pylist())
                yield pa.record_batch([pa.array([float(np.sqrt((x * x).sum(1).max()))])], ["norm"])

    longest = vectors.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    number = int(min(MOST, max(1, n // LIST)))
    graph = CentroidGraph(balanced_centroids(lengthened(points, longest), number, np.random.default_rng(seed)))
    shared = tmp.spark.sparkContext.broadcast((graph, longest))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, longest = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                lists = posting_lists(graph, lengthened(_matrix(part.column(0).to_pylist()), longest), replicas, slack)
                at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.record_batch([pa.array([c for x in lists for c in x], pa.int32()), part.column(0).take(at), part.column(1).take(at)], ["list", "vec", "ids"])

    postings = tmp.table(vectors.select("vec", "ids").mapInArrow(assign, "list int, vec binary, ids array<long>"), "postings")
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Index(graph, width, postings, sizes, *measured(graph, points, longest, ids - 1, replicas, slack))


def measured(graph: CentroidGraph, points: np.ndarray, longest: float, k: int, replicas: int, slack: float) -> tuple[float, int]:
    """The distance ratio that reaches RECALL on the sample, and how many lists that is for nearly all queries, which a first search is for."""
    trials = points[:TRIALS]
    asked = np.hstack([trials / np.sqrt((trials * trials).sum(1, keepdims=True)), np.zeros((len(trials), 1))])
    d = np.sqrt(np.maximum(graph.norms[None, :] - 2 * asked @ graph.centroids.T + 1, 0))
    d = d / np.maximum(d.min(1, keepdims=True), 1e-12)
    ratio, k = 1 + 1e-6, min(k, len(points) - 1)
    if k:
        scores = trials @ points.T
        np.fill_diagonal(scores, -np.inf)  # a trial is not its own neighbour
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        lists = posting_lists(graph, lengthened(points[near.reshape(-1)], longest), replicas, slack)
        needed = np.array([d[i // k, own].min() for i, own in enumerate(lists)]).reshape(-1, k)
        for share in np.linspace(RECALL, 1, 51):
            ratio = float(np.quantile(needed, share)) + 1e-6
            parts = (needed <= ratio).mean(1)
            if parts.mean() - 2 * parts.std() / np.sqrt(len(parts)) >= RECALL:
                break
    return ratio, int(np.quantile((d <= ratio).sum(1), 0.99)) + 1


def packed(sizes: np.ndarray) -> np.ndarray:
    """Groups of lists that follow each other (near centroids do) and hold PART vectors together, or one larger list."""
    out, group, held = np.zeros(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > PART:
            group, held = group + 1, 0
        out[c] = group
        held += n
    return out


def best_of_all(x: np.ndarray, y: np.ndarray, first: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[float], list[int]]:
    """As ``best_of_group``, for one query among all of ``y``, by exact scores alone."""
    exact = (x * y).sum(-1)
    m = min(2 * k, len(exact))  # a vector may be in two lists
    at = np.flatnonzero(exact >= np.partition(exact, -m)[-m])
    at = at[np.lexsort((first[at], -exact[at]))[:m]]
    best = sorted({(-s, i) for s, t in zip(exact[at].tolist(), at.tolist()) for i in ids[t]})[:k]
    return [-s for s, _ in best], [i for _, i in best]


def best_of_group(x: np.ndarray, wanted: list[list[int]], y: np.ndarray, owner: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[list[float], list[int]]]:
    """The k best (scores, ids) for each query among the vectors of the lists it wants, best first, ties to the smaller id.

    Candidates come from a matrix product for each list; their order is settled by
    scores that are summed alike wherever a pair is met.  Where a candidate that was cut
    may equal the k-th, within rounding, the query is settled among all vectors instead.
    """
    lists = np.unique(owner)
    spare = 8
    some = 2 * k + spare  # a vector may be in two lists
    scores = np.full((len(x), len(lists) * (k + spare)), -np.inf)
    which = np.zeros(scores.shape, np.int64)
    lens = [len(w) for w in wanted]
    # Twice what a product and the exact score of a pair may differ by, with a margin.
    rounding = 16 * x.shape[1] * np.finfo(float).eps * np.sqrt((x * x).sum(1) * (y * y).sum(1).max())
    tied = np.zeros(len(x), bool)
    query, asked = np.repeat(np.arange(len(x)), lens), np.concatenate([np.asarray(w, np.int64) for w in wanted])
    for j, c in enumerate(lists.tolist()):
        rows, at = query[asked == c], np.flatnonzero(owner == c)
        if not len(rows):
            continue
        rough = x[rows] @ y[at].T
        m = min(k + spare, len(at))
        top = np.argpartition(-rough, m - 1, axis=1)[:, :m] if m < len(at) else np.tile(np.arange(m), (len(rows), 1))
        to = slice(j * (k + spare), j * (k + spare) + m)
        scores[rows, to] = best = np.take_along_axis(rough, top, 1)
        if m < len(at):
            tied[rows] |= best.min(1) >= np.partition(best, m - k, axis=1)[:, m - k] - rounding[rows]
        which[rows, to] = at[top]
    m = min(some, scores.shape[1])
    top = np.argpartition(-scores, m - 1, axis=1)[:, :m]
    if m < scores.shape[1]:
        best = np.take_along_axis(scores, top, 1)
        least = best.min(1)
        tied |= np.isfinite(least) & (least >= np.partition(best, m - 2 * k, axis=1)[:, m - 2 * k] - rounding)
    found = np.isfinite(np.take_along_axis(scores, top, 1))
    which = np.take_along_axis(which, top, 1)
    exact = np.where(found, (x[:, None, :] * y[which]).sum(-1), -np.inf)
    single = all(len(i) == 1 for i in ids)
    out = []
    first = np.array([i[0] for i in ids])
    order = np.lexsort((first[which], -exact), axis=1)
    for e, w, o, f in zip(exact, which, order, found):
        o = o[f[o]]
        if single:
            _, keep = np.unique(first[w[o]], return_index=True)
            o = o[np.sort(keep)[:k]]
            out.append((e[o].tolist(), first[w[o]].tolist()))
        else:
            best = sorted({(-s, i) for s, t in zip(e[o].tolist(), w[o].tolist()) for i in ids[t]})[:k]
            out.append(([-s for s, _ in best], [i for _, i in best]))
    for q in np.flatnonzero(tied).tolist():
        at = np.flatnonzero(np.isin(owner, wanted[q]))
        out[q] = best_of_all(x[q], y[at], first[at], [ids[t] for t in at.tolist()], k)
    return out


def search(tmp: Scratch, index: Index, queries: DataFrame, k: int, enough: int = 12) -> DataFrame:
    """vec and ``found`` (its k + 1 best (score, id) found, best first) of each of the distinct ``queries`` (vec)."""
    counts = np.zeros(len(index.graph.centroids), np.int64)
    for c, n in index.sizes.items():
        counts[c] = n
    groups = packed(counts)
    shared = tmp.spark.sparkContext.broadcast((index.graph, counts, groups))
    ratio, most = index.ratio, max(index.lists, 16)

    def wanted(ids: np.ndarray, dist: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the lists found are searched, and which rows may want more than those."""
        held = np.where(ids >= 0, counts[ids], 0)
        upto = np.cumsum(held, 1)
        near = np.sqrt(dist) <= ratio * np.sqrt(dist[:, :1]) + 1e-9
        short = (ids[:, -1] < 0) | near[:, -1] | (upto[:, -1] < enough * (k + 1))
        return (ids >= 0) & (held > 0) & (near | (upto - held < enough * (k + 1))), short

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, counts, groups = shared.value
        for b in batches:
            for j in range(0, b.num_rows, 512):
                part = b.slice(j, 512)
                x = _matrix(part.column(0).to_pylist())
                x = np.hstack([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))])
                ids, dist = graph.search(x, min(len(counts), most), beam=64)
                take, short = wanted(ids, dist, counts)
                if ids.shape[1] < len(counts) and short.any():
                    take[short] = False
                    row, col = np.nonzero(take)
                    more, dist = graph.all(x[short])
                    again, at = np.nonzero(wanted(more, dist, counts)[0])
                    row, lists = np.append(row, np.flatnonzero(short)[again]), np.append(ids[row, col], more[again, at])
                else:
                    row, col = np.nonzero(take)
                    lists = ids[row, col]
                order = np.lexsort((lists, row))
                row, lists = row[order], lists[order]
                group = groups[lists]
                cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
                yield pa.record_batch([pa.array(group[cut].astype(np.int32)), part.column(0).take(pa.array(row[cut])), pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32)))], ["grp", "query", "lists"])

    asked = tmp.table(queries.select("vec").filter(F.octet_length("vec") == index.width).mapInArrow(probe, "grp int, query binary, lists array<int>"), "probes")
    askers = {r["grp"]: r["n"] for r in asked.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row for each centroid, MOST at most: its group, and the parts and turns that the group is split into.
    load = np.bincount(groups, weights=counts)
    split = [(c, int(g), int(-(-load[g] // PART)) or 1, -(-askers.get(int(g), 1) // ASKING)) for c, g in enumerate(groups)]
    by_list = F.broadcast(tmp.spark.createDataFrame(split, "list int, grp int, parts int, turns int"))
    by_group = F.broadcast(tmp.spark.createDataFrame(sorted({x[1:] for x in split}), "grp int, parts int, turns int"))
    held = index.postings.join(by_list, "list").select("grp", F.pmod(F.xxhash64("vec"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "list", "vec", "ids")
    asking = asked.join(by_group, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query"), "turns").cast("int").alias("turn"), "query", "lists")

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        names = ["query", "scores", "ids"]
        types = [pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        if not q.num_rows or not v.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        queries, wanted = q.column("query").to_pylist(), q.column("lists").to_pylist()
        x, y = _matrix(queries), _matrix(v.column("vec").to_pylist())
        owner, ids = v.column("list").to_numpy(), v.column("ids").to_pylist()
        out = []
        for j in range(0, len(x), 512):
            out += best_of_group(x[j : j + 512], wanted[j : j + 512], y, owner, ids, k + 1)
        return pa.table([pa.array(queries, types[0]), pa.array([s for s, _ in out], types[1]), pa.array([i for _, i in out], types[2])], names)

    key = ["grp", "part", "turn"]
    met = asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, "query binary, scores array<double>, ids array<long>")
    pair = F.arrays_zip((F.transform("scores", lambda s: -s)).alias("s"), F.col("ids").alias("id"))
    return met.select(F.col("query").alias("vec"), pair.alias("found")).groupBy("vec").agg(F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("found")))), 1, k + 1).alias("found"))


def nearest(spark: SparkSession, df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k of largest inner product found among all other rows.

    Ties go to the smaller id.  Vectors that are null, empty, zero or hold a null or a
    component that is not finite take no part, on either side, nor do rows without an
    id and vectors of another number of components than most distinct ones have (of two
    equally frequent numbers, the smaller one counts).  With fewer candidates all are
    returned.  Rows that repeat id and vector count once.  Other columns are not read.
    """
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("vector"))
    schema = "query_id long, rank int, vec_id long, score double"
    with Scratch(spark) as tmp:
        index = build(tmp, rows, k + 1)
        if index is None:
            return spark.createDataFrame([], schema)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(taking_part(b))
                yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["query_id", "vec"])

        asked = tmp.table(rows.filter(F.col("id") % every == 0).mapInArrow(pick, "query_id long, vec binary"), "queries").distinct()
        found = tmp.table(search(tmp, index, asked.select("vec").distinct(), k), "found")
        own = F.slice(F.filter("found", lambda p: p["id"] != F.col("query_id")), 1, k)
        out = asked.join(found, "vec").select("query_id", F.posexplode(own).alias("place", "p"))
        return tmp.keep(out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.s")).alias("score")))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, table(spark, sf_dir, "embeddings"))
