"""Operator 5: quality scores of hashed word n-gram logistic regression, trained by FTRL-proximal.

Tokens are words without the signs around them, runs of signs, and the shape of a word
(lower, title or upper case, digits).  Features are single tokens and pairs of words that
follow each other, hashed into a table of fixed size; a word that repeats the one before
it is one feature, whatever the word.  A text's features are the shares of its tokens,
so its score is a sparse dot product that needs no sorting: the mean of the tokens'
weights.

The model learns from a sample: about ``per_class`` labelled rows of either class at most, drawn by a
hash of the id from all labelled rows of the learning fold, and of those as many as have
SAMPLE_BYTES of text together.  The log-odds are then set
back to the share that the classes have among all of these rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm.common import fold, map_batches, mix64, slices, table

BITS = 20
PER_CLASS = 4000
SAMPLE_BYTES = 64 << 20
SCALE = 20.0
_PARTS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")


class Tokens:
    """Feature hashes of words, remembered for as many words as ``most``."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.columns: list[list[int]] = [[], [], []]
        self.table = np.zeros((0, 3), np.uint64)

    def _learn(self, words: set[bytes]) -> None:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        rows = []
        for w in words:
            self.known[w] = len(self.known)
            parts = _PARTS.findall(w)
            core = max((p for p in parts if _PARTS.match(p) and (p[:1].isalnum() or p[0] >= 0x80)), key=len, default=b"")
            signs = b"".join(p for p in parts if not (p[:1].isalnum() or p[0] >= 0x80))
            shape = "upper" if core.isupper() and len(core) > 1 else "title" if core[:1].isupper() else "digits" if core.isdigit() else "lower" if core else "none"
            rows.append((digest(core.lower()), digest(b"signs " + signs) if signs else 0, digest(f"shape {shape}")))
        self.table = np.concatenate([self.table, np.array(rows, np.uint64).reshape(-1, 3)])

    def features(self, raws: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature) of every token of every text, and the number of words of each text."""
        words = [r.split() if r else [] for r in raws]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        if len(self.known) > self.most:
            self.clear()
        new = set(flat).difference(self.known)
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(words)), lens)
        core, signs, shape = self.table[at].T if len(at) else np.zeros((3, 0), np.uint64)
        same_row = row[1:] == row[:-1]
        pair = mix64(core[:-1] * np.uint64(0x9E3779B97F4A7C15) + core[1:])
        pair[core[1:] == core[:-1]] = 1
        signed = signs > 0
        rows = np.concatenate([row, row[signed], row, row[1:][same_row]])
        hashed = np.concatenate([core, signs[signed], shape, pair[same_row]])
        return rows, (mix64(hashed) >> np.uint64(64 - bits)).astype(np.int64), lens


class Ftrl:
    """Logistic regression; the weights follow from the sums of gradients, so that L1 keeps most of them at zero."""

    def __init__(self, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(1 << bits)
        self.n = np.zeros(1 << bits)
        self.zb = self.nb = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30)))
        g = (p - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g
        gb = p - y
        self.zb += gb - (np.sqrt(self.nb + gb * gb) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += gb * gb


def train(df: DataFrame, labels: DataFrame, label_col: str, per_class: int = PER_CLASS, bits: int = BITS, epochs: int = 4, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of ``df`` (doc_id, text) that ``labels`` (doc_id, label) marks outside the held-out fold.

    Of the drawn rows, each class learns from those that find room in half of
    ``sample_bytes``, in the order of the draw; what comes to the driver is bounded by it.
    """
    marked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marked = marked.filter(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_class / max(1, counts.get(0, 0))))
    drawn = marked.filter(draw < rate).withColumn("draw", draw)  # about 2 * per_class rows
    sized = df.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y", "draw").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()
    chosen, room = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for r in sorted(sized, key=lambda r: (r["draw"], r["doc_id"])):
        if r["n"] <= room[r["y"]]:
            room[r["y"]] -= r["n"]
            chosen.append((r["doc_id"], r["y"]))
    learn = F.broadcast(df.sparkSession.createDataFrame(chosen, "doc_id long, y int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for piece in slices(batches, "text"):
            row, feature, lens = tokens.features(piece.column("text").to_pylist(), bits)
            at, n = np.unique(row << bits | feature, return_counts=True)
            sizes = np.bincount(at >> bits, minlength=len(lens))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            share = (n / lens[at >> bits]).astype(np.float32)
            yield pa.record_batch([piece.column("doc_id"), piece.column("y"), pa.ListArray.from_arrays(offsets, pa.array((at & ((1 << bits) - 1)).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(share))], ["doc_id", "y", "at", "x"])

    rows = df.join(learn, "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, at array<int>, x array<float>").toArrow()
    model = Ftrl(bits)
    ids, ys = rows.column("doc_id").to_numpy(), rows.column("y").to_numpy()
    at, x = rows.column("at").combine_chunks(), rows.column("x").combine_chunks()
    a, b = at.offsets.to_numpy(), x.offsets.to_numpy()
    at, x = at.values.to_numpy(), x.values.to_numpy().astype(np.float64) * SCALE
    order = np.argsort(mix64(ids.astype(np.int64).view(np.uint64)), kind="stable")  # by id, not as partitions come
    for _ in range(epochs):
        for i in order.tolist():
            model.learn(at[a[i] : a[i + 1]], x[b[i] : b[i + 1]], int(ys[i]))
    odds = lambda one, zero: np.log((one + 1) / (zero + 1))
    prior = odds(counts.get(1, 0), counts.get(0, 0)) - odds(int((ys == 1).sum()), int((ys == 0).sum()))
    return (model.weights() * SCALE).astype(np.float32), float(model.bias() + prior)


def score(df: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``df`` (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    bits = len(weights).bit_length() - 1
    state: list[Tokens] = []

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Tokens())
        row, feature, lens = state[0].features(piece.column("text").to_pylist(), bits)
        sums = np.bincount(row, weights=shared.value[feature], minlength=len(lens))
        logit = sums / np.maximum(lens, 1) + bias
        return pa.record_batch([piece.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], ["doc_id", "score"])

    out = map_batches(df.select("doc_id", "text"), make, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(spark: SparkSession, df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``df``, whole texts.

    Null, empty and blank texts have no features: their score is the model's bias.  A
    null id counts as empty text in the fold.  Labels other than 0 and 1 and labels
    without an id are left out; where an id has several, the more frequent one counts,
    and 1 in a tie.  Without labels all scores are 0.5.  Other columns are not read.
    """
    texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").cast("binary").alias("text"))
    weights, bias = train(texts, labels, label_col)
    return score(texts, weights, bias)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
