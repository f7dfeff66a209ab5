"""Operator 1: URL filter with host word segmentation and naive Bayes.

A fixed rule decides where one fits.  Other URLs go to the method: the labels of the
host and the parts of the path are split into words, concatenated names by the Viterbi
path of a unigram model, and a multinomial naive Bayes model scores the words of host
and path as separate vocabularies.

The unigram model counts the words of all page texts.  The Bayes model learns from the
URLs of all pages, with weak labels: those whose host has a word of ``SEEDS`` count as
unwanted, and what else is in their hosts and paths becomes evidence too.

Both models are whole: totals are over all words and tokens.  The ``VOCABULARY`` most
frequent go to every task; all others, each of them rarer, are joined by value, where
there are any.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm.common import ASCII_UPPER, Scratch, most_frequent, slices, table

VOCABULARY = 50_000
LONGEST = 24
#: (host, path), verdict; the string of a rule is host + path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Words that make a host unwanted.
SEEDS = (
    "adult ads adserver bet bets betting casino cams counterfeit crack dating doubleclick escort gamble gambling hentai "
    "jackpot keygen lottery malware nude payday pharmacy phishing pills poker popunder porn replica roulette sex slots "
    "spam torrent track tracker viagra warez webcam xxx"
).split()
_LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
_TAG = re.compile(rb"<[^>]*>")
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_RUN = re.compile(r"[a-z]+|[0-9]+|[^\W\d_a-z]+")


class Url(NamedTuple):
    host: str
    path: str


def split_url(url: str | None) -> Url:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return Url("", "")
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return Url(m[1].translate(_LOWER), m[2])


def rule_for(url: Url, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule whose host is the url's or above it and whose path begins the url's."""
    fits = [(h + p, v) for h, p, v in rules if (url.host == h or url.host.endswith("." + h)) and url.path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=None)


class Segmenter:
    """Splits runs of letters into words by the most likely path."""

    """``total``: of the counts of all words, where ``counts`` holds some of them."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.logs = {w: math.log(n / self.total) for w, n in counts.items()}
        self.unknown = math.log(1 / (self.total * 10))
        self.known: dict[str, list[str]] = {}
        #: Runs whose words are settled.
        self.settled: dict[str, list[str]] = {}

    def split(self, run: str) -> list[str]:
        if run in self.settled:
            return self.settled[run]
        if run not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[run] = self._viterbi(run)
        return self.known[run]

    def parts(self, run: str) -> set[str]:
        """What may be a word of ``run`` and is none of the counts held here."""
        return {run[j:i] for i in range(1, len(run) + 1) for j in range(max(0, i - LONGEST), i)}.difference(self.logs)

    def settle(self, run: str, rare: dict[str, int]) -> list[str]:
        """Words of ``run``, with the counts of those of its ``parts`` that are words."""
        return self._viterbi(run, {w: math.log(n / self.total) for w, n in rare.items()})

    def _viterbi(self, run: str, rare: dict[str, float] = {}) -> list[str]:
        logs = ChainMap(self.logs, rare) if rare else self.logs
        # best[i]: log probability of the best path over run[:i], and where its last word begins.
        best, back = [0.0], [0]
        for i in range(1, len(run) + 1):
            score, at = max((best[j] + logs.get(run[j:i], self.unknown - 2.3 * (i - j)), j) for j in range(max(0, i - LONGEST), i))
            best.append(score)
            back.append(at)
        out, i = [], len(run)
        while i:
            out.append(run[back[i] : i])
            i = back[i]
        return out[::-1]

    def words(self, text: str, splits: dict[str, list[str]] = {}) -> list[str]:
        """Words of a host or a path; a run of digits is the word ``0``."""
        out = []
        for run in _RUN.findall(text.lower()):
            out += ["0"] if run[0].isdigit() else (splits.get(run) or self.split(run)) if run.isascii() else [run]
        return out

    def tokens(self, url: Url, splits: dict[str, list[str]] = {}) -> list[str]:
        return ["h:" + w for w in self.words(url.host, splits)] + ["p:" + w for w in self.words(url.path, splits)]


def letter_runs(url: Url) -> list[str]:
    """The runs of host and path that ``Segmenter.split`` is asked for."""
    return [r for part in url for r in _RUN.findall(part.lower()) if r.isascii() and not r[0].isdigit()]


class Bayes:
    """Log-odds of unwanted against wanted for each token, and for a url without tokens.

    ``whole``: number of all tokens and their counts of either kind, where ``tokens`` holds some of them.
    """

    def __init__(self, tokens: dict[str, tuple[int, int]], urls: tuple[int, int], smooth: float = 0.5, whole: tuple[int, int, int] | None = None):
        number, good, bad = whole or (len(tokens), sum(t[0] for t in tokens.values()), sum(t[1] for t in tokens.values()))
        self.smooth, self.wanted, self.unwanted = smooth, good + smooth * (number + 1), bad + smooth * (number + 1)
        self.odds = {w: self.odds_of(*t) for w, t in tokens.items()}
        self.prior = math.log((urls[1] + 1) / (urls[0] + 1))

    def odds_of(self, good: int, bad: int) -> float:
        return math.log((bad + self.smooth) / self.unwanted) - math.log((good + self.smooth) / self.wanted)

    def score(self, tokens: list[str], rare: dict[str, float] = {}) -> float:
        """Probability that a url is unwanted; tokens that no url had say nothing."""
        odds = ChainMap(self.odds, rare) if rare else self.odds
        z = self.prior + sum(odds.get(t, 0.0) for t in tokens)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _counted(df: DataFrame, column: str, count, fields: str) -> DataFrame:
    """Sums over all rows of what ``count`` adds to a Counter for a piece of rows, cut by the bytes of ``column``; keys are pre-summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys, values = list(counts), list(counts.values())
            counts.clear()
            return pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(values, pa.int64())], ["word", "kind", "n"])

        for piece in slices(batches, column, 1 << 20):
            count(counts, piece)
            if len(counts) > 300_000:
                yield flush()
        if counts:
            yield flush()

    return df.mapInArrow(run, fields).groupBy("word", "kind").agg(F.sum("n").alias("n"))


def _parsed(piece: pa.RecordBatch) -> list[Url]:
    return [split_url(url.decode() if url else None) for url in piece.column("url").to_pylist()]


def _given(piece: pa.RecordBatch, name: str) -> list[list[dict]]:
    """What was joined to each row as ``name``, if that was done."""
    return [x or [] for x in piece.column(name).to_pylist()] if name in piece.schema.names else [[]] * piece.num_rows


def _tokens(segmenter: Segmenter, piece: pa.RecordBatch) -> Iterator[tuple[Url, dict[str, list[str]], list[str]]]:
    for url, given in zip(_parsed(piece), _given(piece, "splits")):
        splits = {x["word"]: x["words"] for x in given}
        yield url, splits, segmenter.tokens(url, splits)


def _numbered(tmp: Scratch, urls: DataFrame) -> DataFrame:
    """``urls`` with a uid for each row, stored so that it stays the same."""
    if "uid" in urls.columns:
        return urls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            yield pa.record_batch([pa.array(range(uid, uid + b.num_rows), pa.int64()), *b.columns], ["uid", *b.schema.names])
            uid += b.num_rows

    return tmp.table(urls.mapInArrow(run, "uid long, page_id long, url binary"), "urls")


def _joined(tmp: Scratch, urls: DataFrame, asked: Callable[[pa.RecordBatch], Iterator[set[str]]], found: DataFrame, name: str) -> DataFrame:
    """``urls`` with the rows of ``found`` (word, ...) whose words ``asked`` gives for each row, as the array ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "url", 1 << 20):
            uids, words = [], []
            for uid, own in zip(piece.column("uid").to_pylist(), asked(piece)):
                uids += [uid] * len(own)
                words += own
            yield pa.record_batch([pa.array(uids, pa.int64()), pa.array(words, pa.string())], ["uid", "word"])

    urls = _numbered(tmp, urls)
    got = urls.mapInArrow(run, "uid long, word string").join(found, "word").groupBy("uid").agg(F.collect_list(F.struct(*found.columns)).alias(name))
    return tmp.table(urls.join(got, "uid", "left"), name)


def unigrams(tmp: Scratch, pages: DataFrame, seeds: list[str], most: int = VOCABULARY) -> tuple[Segmenter, DataFrame | None]:
    """A segmenter with the most frequent words of all page texts and the seed words; the counts of all words (word, n), if there are others."""

    def count(counts: Counter, piece: pa.RecordBatch) -> None:
        for html in piece.column("html").to_pylist():
            if html:
                counts.update((w.decode(), 0) for w in _WORD.findall(_TAG.sub(b" ", html.lower())) if w.isascii() and len(w) <= LONGEST)

    counted = tmp.table(_counted(pages.select(pages["html"]), "html", count, "word string, kind int, n long"), "words").select("word", "n")
    number, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = {r["word"]: r["n"] for r in most_frequent(counted, "n", most).collect()}
    own = {r["word"]: r["n"] for r in counted.filter(F.col("word").isin(seeds)).collect()}
    rest = number > len(out.keys() | own.keys())
    for w in seeds:
        n = own.get(w, 0)
        out[w] = own[w] = max(n, 1 + total // 10_000)
        total += out[w] - n
    return Segmenter(out, total), counted if rest else None


def settle_runs(tmp: Scratch, urls: DataFrame, segmenter: Segmenter, counted: DataFrame, most: int) -> DataFrame:
    """``urls`` with the words of their runs (splits) by the counts of all words; those of the most frequent runs go into the segmenter."""

    def count(counts: Counter, piece: pa.RecordBatch) -> None:
        counts.update((r, 0) for url in _parsed(piece) for r in letter_runs(url))

    runs = tmp.table(_counted(urls, "url", count, "word string, kind int, n long").select("word", "n"), "runs")
    shared = urls.sparkSession.sparkContext.broadcast(segmenter)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, of = [], []
            for run in b.column("word").to_pylist():
                own = shared.value.parts(run)
                words += own
                of += [run] * len(own)
                if len(words) > 50_000:
                    yield pa.record_batch([pa.array(words, pa.string()), pa.array(of, pa.string())], ["word", "run"])
                    words, of = [], []
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(of, pa.string())], ["word", "run"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [shared.value.settle(run, {x["word"]: x["n"] for x in rare or []}) for run, rare in zip(b.column("word").to_pylist(), b.column("rare").to_pylist())]
            yield pa.record_batch([b.column("word"), b.column("n"), pa.array(words, pa.list_(pa.string()))], ["word", "n", "words"])

    rare = runs.select("word").mapInArrow(parts, "word string, run string").join(counted, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("rare"))
    split = tmp.table(runs.join(rare.withColumnRenamed("run", "word"), "word", "left").mapInArrow(settle, "word string, n long, words array<string>"), "split")
    segmenter.settled = {r["word"]: r["words"] for r in most_frequent(split, "n", most).collect()}
    settled = urls.sparkSession.sparkContext.broadcast(segmenter.settled)

    def asked(piece: pa.RecordBatch) -> Iterator[set[str]]:
        return (set(letter_runs(url)).difference(settled.value) for url in _parsed(piece))

    return _joined(tmp, urls, asked, split.select("word", "words"), "splits")


def train_bayes(tmp: Scratch, urls: DataFrame, segmenter: Segmenter, seeds: list[str], most: int = VOCABULARY) -> tuple[Bayes, DataFrame | None]:
    """A model with the most frequent tokens of all urls and those of the seeds; the counts of all tokens (word, good, bad), if there are others."""
    shared = urls.sparkSession.sparkContext.broadcast(segmenter)
    marks = {"h:" + w for w in seeds}

    def count(counts: Counter, piece: pa.RecordBatch) -> None:
        for _, _, tokens in _tokens(shared.value, piece):
            bad = int(not marks.isdisjoint(tokens))
            counts[("", bad)] += 1
            counts.update((t, bad) for t in tokens)

    counted = _counted(urls, "url", count, "word string, kind int, n long")
    rows = counted.groupBy("word").agg(F.sum(F.expr("if(kind = 0, n, 0)")).alias("good"), F.sum(F.expr("if(kind = 1, n, 0)")).alias("bad"))
    rows = tmp.table(rows.withColumn("n", F.col("good") + F.col("bad")), "tokens")
    named = rows.filter("word <> ''")
    number, good, bad = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    top = most_frequent(named, "n", most).union(rows.filter((F.col("word") == "") | F.col("word").isin(sorted(marks)))).collect()
    tokens = {r["word"]: (r["good"], r["bad"]) for r in top}
    seen = tokens.pop("", (0, 0))
    rest = number > len(tokens)
    for w in marks:  # a seed is evidence even where no url has it
        number += w not in tokens
        g, b = tokens.get(w, (0, 0))
        tokens[w] = (g, b + 1)
    return Bayes(tokens, seen, whole=(number, good, bad + len(marks))), named.select("word", "good", "bad") if rest else None


def judge(spark: SparkSession, df: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEEDS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = VOCABULARY) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the method, for every url) and words (of the host) of every row of ``df``.

    A null url and one without ``://`` have an empty host and path, which no rule fits;
    the method then goes by the share of unwanted urls alone.  Null and empty page texts
    add no words.  Rows repeat as they do in the input; other columns are not read.
    ``most`` bounds what is broadcast, not what counts.
    """
    pages = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").cast("binary").alias("url"), df[html_col].cast("string").cast("binary").alias("html"))
    with Scratch(spark) as tmp:
        segmenter, counted = unigrams(tmp, pages, seeds, most)
        urls = pages.select("page_id", "url")
        if counted is not None:
            urls = settle_runs(tmp, urls, segmenter, counted, most)
        bayes, tokens = train_bayes(tmp, urls, segmenter, seeds, most)
        shared = spark.sparkContext.broadcast((segmenter, bayes))
        if tokens is not None:

            def asked(piece: pa.RecordBatch) -> Iterator[set[str]]:
                segmenter, bayes = shared.value
                return (set(own).difference(bayes.odds) for _, _, own in _tokens(segmenter, piece))

            urls = _joined(tmp, urls, asked, tokens, "odds")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segmenter, bayes = shared.value
            for piece in slices(batches, "url", 1 << 20):
                rows = []
                for (parts, splits, own), given in zip(_tokens(segmenter, piece), _given(piece, "odds")):
                    score = bayes.score(own, {x["word"]: bayes.odds_of(x["good"], x["bad"]) for x in given})
                    rule, verdict = rule_for(parts, rules) or (None, "block" if score > 0.5 else "allow")
                    rows.append((parts.host, parts.path, rule, verdict, score, segmenter.words(parts.host, splits)))
                host, path, rule, verdict, score, words = zip(*rows)
                yield pa.record_batch([piece.column("page_id"), pa.array(host), pa.array(path), pa.array(rule, pa.string()), pa.array(verdict), pa.array(score, pa.float64()), pa.array(words, pa.list_(pa.string()))], ["page_id", "host", "path", "rule", "verdict", "score", "words"])

        out = urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double, words array<string>")
        return out if counted is None and tokens is None else tmp.keep(out)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))
