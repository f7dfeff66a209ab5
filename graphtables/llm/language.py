"""Operator 7: language identification by hierarchical discrimination.

Features are the 1- to 4-grams of the letters of each lower-cased word with a blank on
either side, hashed into a table of fixed size.  A multinomial naive Bayes model over
the n-grams picks the language family; within it, one linear support vector machine for
each pair of languages votes, and the sum of the margins breaks ties.  All of these
models are linear in the n-gram shares of a text, so a word adds the same to every text
that it is in: each distinct word is taken apart once and its sums are remembered.

The models learn from at most ``rows`` texts, the same number of each language, drawn by
a hash of the id from all texts of the learning fold.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm.common import fold, map_batches, mix64, slices, small_batches, table

BITS = 17
GRAMS = 4
ROWS = 4000
#: Bytes of text whose words are looked up at a time: words and sums take many times as much memory.
PIECE = 1 << 19
#: Languages that a model learns at most: the most frequent ones.
LANGUAGES = 64
UNKNOWN = "und"
# Families of languages by ISO 639-1 code; another language is a family of its own.
FAMILIES = {
    "romance": "ca es fr gl it oc pt ro",
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "finnic": "et fi",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tt ug uz",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
    "celtic": "br cy ga gd",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = re.compile(r"[^\W\d_]+")
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if there is no letter at all."""
    words = _LETTERS.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every n-gram of every word."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = points == 32
    owner = np.minimum(np.cumsum(blank) - 1, len(words) - 1)
    owners, features = [], []
    for k in range(1, GRAMS + 1):
        n = len(points) - k + 1
        ok = ~blank[:n] if k == 1 else np.ones(n, bool)
        for j in range(1, k - 1):
            ok &= ~blank[j : j + n]
        at = np.flatnonzero(ok)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h += mix64(points[at + j]) * np.uint64(_PLACES[j])
        owners.append(owner[at])
        features.append((mix64(h) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(features)


class Model:
    """Families, languages and the weights of all decisions, a column for each."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.families = sorted({FAMILY_OF.get(x, x) for x in languages})
        self.members = [[i for i, x in enumerate(languages) if FAMILY_OF.get(x, x) == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        self.weights = np.zeros((1 << BITS, len(self.families) + len(self.pairs)), np.float32)
        self.bias = np.zeros(len(self.families) + len(self.pairs))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, decay: float = 1e-4) -> None:
        """docs: (features, shares) of each text."""
        for f, members in enumerate(self.members):
            counts = np.ones(1 << BITS)
            for i in np.flatnonzero(np.isin(labels, members)).tolist():
                counts[docs[i][0]] += docs[i][1] * 1000
            self.weights[:, f] = np.log(counts / counts.sum())
        for p, (a, b) in enumerate(self.pairs):
            own = np.flatnonzero((labels == a) | (labels == b))
            w, bias, t, scale = np.zeros(1 << BITS), 0.0, 1 / decay, 1.0
            mean, mean_bias, seen = np.zeros(1 << BITS), 0.0, 0
            for epoch in range(epochs):
                for i in own.tolist():
                    at, x = docs[i]
                    y = 1.0 if labels[i] == a else -1.0
                    margin = y * (scale * (w[at] @ x) + bias)
                    t += 1
                    scale *= 1 - 1 / t
                    if margin < 1:
                        w[at] += y * x / (decay * t) / scale
                        bias += y * 0.1 / (decay * t)
                if epoch >= epochs // 2:
                    mean += scale * w
                    mean_bias += bias
                    seen += 1
            self.weights[:, len(self.families) + p] = mean / max(seen, 1)
            self.bias[len(self.families) + p] = mean_bias / max(seen, 1)

    def decide(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score from the mean of the weights over a text's n-grams."""
        values = means + self.bias
        nf = len(self.families)
        odds = np.exp(np.clip((values[:, :nf] - values[:, :nf].max(1, keepdims=True)) * 20, -60, 0))
        odds /= odds.sum(1, keepdims=True)
        family = odds.argmax(1)
        best = np.zeros(len(means), np.int64)
        score = odds.max(1)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(self.languages)))
            margins = np.zeros_like(votes)
            for p, (a, b) in enumerate(self.pairs):
                if a in members:
                    v = values[rows, nf + p]
                    votes[:, a] += v >= 0
                    votes[:, b] += v < 0
                    margins[:, a] += np.tanh(v)
                    margins[:, b] -= np.tanh(v)
            own = np.array(members)
            rank = votes[:, own] + margins[:, own] / (2 * len(members) + 1)
            pick = rank.argmax(1)
            best[rows] = own[pick]
            if len(members) > 1:
                score[rows] *= 1 / (1 + np.exp(-2 * np.clip(margins[np.arange(len(rows)), own[pick]] / (len(members) - 1) * 2, -20, 20)))
        return best, score


class WordSums:
    """What each word adds to each decision, and its number of n-grams; remembered for as many words as ``most``."""

    def __init__(self, weights: np.ndarray, most: int = 100_000):
        self.weights, self.most = weights, most
        self.known: dict[str, int] = {}
        self.sums = np.zeros((0, weights.shape[1] + 1), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known, self.sums = {}, self.sums[:0]
        new = list(set(words).difference(self.known))
        if new:
            owner, feature = grams(new)
            columns = [np.bincount(owner, weights=self.weights[feature, c], minlength=len(new)) for c in range(self.weights.shape[1])]
            columns.append(np.bincount(owner, minlength=len(new)))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.sums = np.concatenate([self.sums, np.array(columns, np.float32).T])
        return self.sums[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def train(df: DataFrame, rows: int = ROWS, most: int = LANGUAGES) -> Model:
    """A model of the languages that ``df`` (doc_id, text, lang) names outside the held-out fold.

    It learns from about ``rows`` texts and from the ``most`` most frequent languages
    (in a tie the first by name), so its size does not depend on what ``lang`` holds.
    """
    learn = df.filter(fold(F.col("doc_id")) != 2).filter("lang is not null and text is not null")
    named = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    counts = {r["lang"]: r["n"] for r in named.collect()}
    languages = sorted(counts)
    model = Model(languages)
    if not languages:
        return model
    each = max(1, rows // len(languages))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*chain.from_iterable((F.lit(x), F.lit(min(1.0, each / n))) for x, n in counts.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            at, n = [], []
            for text in piece.column("text").to_pylist():
                feature, count = np.unique(grams(words_of(text))[1], return_counts=True)
                at.append(feature.astype(np.int32))
                n.append((count / max(1, count.sum())).astype(np.float32))
            yield pa.record_batch([piece.column("doc_id"), piece.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["doc_id", "lang", "at", "x"])

    got = learn.filter(draw < rates[F.col("lang")]).select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at array<int>, x array<float>").toArrow()
    ids = got.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
    labels = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    at, x = got.column("at").combine_chunks(), got.column("x").combine_chunks()
    a, b, at, x = at.offsets.to_numpy(), x.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
    order = [i for i in np.argsort(mix64(ids.view(np.uint64)), kind="stable").tolist() if a[i + 1] > a[i]]  # by id, not as partitions come
    model.fit([(at[a[i] : a[i + 1]], x[b[i] : b[i + 1]].astype(np.float64) * 10) for i in order], labels[order])
    model.weights[:, len(model.families) :] *= 10
    return model


def decisions(model: Model, sums: WordSums, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    words = [words_of(t) for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    full = np.flatnonzero(lens)
    names, scores = [UNKNOWN] * len(words), np.zeros(len(words))
    if len(full) and model.languages:
        each = sums.of(list(chain.from_iterable(words))).astype(np.float64)
        total = np.add.reduceat(each, (np.cumsum(lens) - lens)[full])
        best, scores[full] = model.decide(total[:, :-1] / np.maximum(total[:, -1:], 1))
        for i, k in zip(full.tolist(), best.tolist()):
            names[i] = model.languages[k]
    return names, scores


def predict(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``df`` (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    state: list[WordSums] = []

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(WordSums(shared.value.weights))
        names, scores = decisions(shared.value, state[0], piece.column("text").to_pylist())
        return pa.record_batch([piece.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = map_batches(df.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double", most=PIECE)
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def _columns(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"))


def languages(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``df``, whole texts.

    ``und`` with score 0 for texts that are null or have no letter, and for all if no
    language can be learned.  Of more than LANGUAGES values of lang the most frequent
    are learned.  A null id counts as empty text in the fold.  Other columns
    are not read.
    """
    rows = _columns(df, id_col, text_col, lang_col)
    return predict(rows, train(rows))


def known_language(spark: SparkSession, df: DataFrame, keep: Collection[str] | None = None, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df``, all columns as they are, that are predicted to be in one of the languages ``keep`` (None: in any that was learned) with a score of ``least`` or more.

    So texts that are null or have no letter go, texts of other languages, and texts
    whose best language is not likely enough.  What the column of languages says of
    a row does not decide about it.
    """
    small_batches(spark)
    model = train(_columns(df, id_col, text_col, lang_col))
    shared = spark.sparkContext.broadcast(model)
    wanted = None if keep is None else frozenset(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = WordSums(shared.value.weights)
        for piece in slices(batches, text_col, PIECE):
            names, scores = decisions(shared.value, sums, piece.column(text_col).to_pylist())
            yield piece.filter(pa.array([x != UNKNOWN and s >= least and (wanted is None or x in wanted) for x, s in zip(names, scores.tolist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, table(spark, sf_dir, "documents"))
