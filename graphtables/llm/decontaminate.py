"""Operator 6: benchmark items inside documents, by MinHash containment search in size partitions.

Items are short and documents may be long, so the similarity of an item with a whole
document says little.  Items are therefore partitioned by the size of their shingle
sets: partition ``c`` has the items of more than 2**(c - 1) and up to W = 2**c
shingles, and for it a document is cut into windows of 5/4 W shingle places that begin
every W / 4 places, so that every run of W places lies in one window.  An item of which
a share of at least ``percent`` is in such a run has a Jaccard similarity of 0.29 or
more with the window (0.40 if all of it is), and each of the ``hashes`` MinHash values
of both agrees with that probability.  One agreeing value makes a candidate; with 32
values one in 70,000 of the least similar, and one in ten million of the whole ones, is
missed.  Block minima are shared by all windows and partitions.

A candidate counts if the document's whole set holds at least ``percent`` of the item's
distinct shingles.  Items come in blocks of a bounded number of bytes, each of which
goes to all tasks in turn and is met with all documents; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm.common import raw_texts, slices, small_batches, table
from graphtables.llm.shingle_sets import PIECE, shingle_hashes, shingles_sql, whole_texts

BLOCK_BYTES = 8 << 20
HASHES = 32
FILTER_BITS = 22


def _shingles(raws: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in the order of their places, and how many each text has."""
    rows = whole_texts(raws)
    h, row, _ = shingle_hashes(rows.words, rows.lens, width)
    counts = np.bincount(row, minlength=len(raws))
    if (np.diff(row) < 0).any():  # texts of few words come first
        h = h[np.argsort(row, kind="stable")]
    return h, counts


def _hashed(tokens: np.ndarray, k: int) -> np.ndarray:
    """The k-th random order of the tokens."""
    return (tokens ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)


class ItemIndex:
    """Items of one block: their sets, and their MinHash values by size partition."""

    def __init__(self, ids: list[int], texts: list[bytes], width: int, hashes: int):
        self.width, self.hashes = width, hashes
        self.ids, self.sets = [], []
        for i, t in zip(ids, texts):
            tokens = np.unique(_shingles([t], width)[0])
            if len(tokens):
                self.ids.append(i)
                self.sets.append(tokens)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        part = [max(2, int(np.ceil(np.log2(len(s))))) for s in self.sets]
        for c in sorted(set(part)):
            items = [i for i, p in enumerate(part) if p == c]
            values = np.array([[_hashed(self.sets[i], k).min() for k in range(hashes)] for i in items]).reshape(-1)
            owner = np.repeat(items, hashes)
            order = np.argsort(values)
            marks = np.zeros(1 << FILTER_BITS, bool)
            marks[self.mark(values)] = True
            self.parts[c] = (values[order], owner[order], marks)

    @staticmethod
    def mark(values: np.ndarray) -> np.ndarray:
        # Minima of large sets are small numbers: the filter takes mixed bits.
        return ((values * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def candidates(self, tokens: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs with a MinHash value in common in some window."""
        found: set[tuple[int, int]] = set()
        texts = np.flatnonzero(counts)
        if not len(texts) or not self.parts:
            return found
        counts = counts[texts]
        sizes = {c: (1 << c) // 4 for c in self.parts}
        # Blocks of the smallest partition; those of the others are pairs, fours, ... of them within the text.
        least = min(sizes.values())
        number = -(-counts // least)
        first = np.cumsum(number) - number
        inside = np.arange(int(number.sum())) - np.repeat(first, number)
        begins = np.repeat(np.cumsum(counts) - counts, number) + inside * least
        layout = {}
        for c, size in sizes.items():
            n = -(-counts // size)
            f = np.cumsum(n) - n
            ins = np.arange(int(n.sum())) - np.repeat(f, n)
            layout[c] = (np.repeat(first, n) + ins * (size // least), np.repeat(n, n) - ins, np.repeat(texts, n))
        for k in range(self.hashes):
            fine = np.minimum.reduceat(_hashed(tokens, k), begins)
            for c, (starts, left, owner) in layout.items():
                values, items, marks = self.parts[c]
                block = np.minimum.reduceat(fine, starts)
                window = block.copy()
                for j in range(1, 5):
                    ok = np.flatnonzero(left > j)
                    window[ok] = np.minimum(window[ok], block[ok + j])
                for at in np.flatnonzero(marks[self.mark(window)]).tolist():
                    lo = np.searchsorted(values, window[at], "left")
                    while lo < len(values) and values[lo] == window[at]:
                        found.add((int(owner[at]), int(items[lo])))
                        lo += 1
        return found

    def hits(self, raws: list[bytes | None], percent: int) -> list[tuple[int, int, int, int]]:
        """(text, item id, shared, size of the item) of every verified pair."""
        tokens, counts = _shingles(raws, self.width)
        ends = np.cumsum(counts)
        out = []
        last, own = -1, np.empty(0, np.uint64)
        for text, item in sorted(self.candidates(tokens, counts)):
            if text != last:
                last, own = text, np.unique(tokens[ends[text] - counts[text] : ends[text]])
            want = self.sets[item]
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            shared = int((own[at] == want).sum())
            if 100 * shared >= percent * len(want):
                out.append((text, self.ids[item], shared, len(want)))
        return out


def item_blocks(items: DataFrame, width: int, hashes: int, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """Indexes of all items, each of about ``block_bytes`` of text at most (one longer item makes a block of its own size)."""
    picked = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").cast("binary").alias("text")).filter("text is not null")
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        block = picked if n == 1 else picked.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k)
        got = block.toArrow()
        yield ItemIndex(got.column("item_id").to_pylist(), got.column("text").cast(pa.binary()).to_pylist(), width, hashes)


def contained_items(spark: SparkSession, df: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item for every document and item of which it holds enough; clean documents give no row.

    Null, empty and blank texts and items match nothing.  Fewer words than ``width`` are
    one shingle, so such an item is found in documents of just these words only.
    Repeated rows on either side give repeated rows here.  Other columns are not read.
    """
    texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").cast("binary").alias("text"))
    out = None
    for index in item_blocks(items, width, hashes, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, "text", PIECE):
                rows = shared.value.hits(piece.column("text").to_pylist(), percent)
                if rows:
                    at, item, n, m = zip(*rows)
                    yield pa.record_batch([piece.column("doc_id").take(pa.array(at)), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])

        part = texts.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long")
        out = part if out is None else out.union(part)
    return out


def without_contaminated(spark: SparkSession, df: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, hashes: int = HASHES, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that hold no item."""
    small_batches(spark)
    for index in item_blocks(items, width, hashes, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, text_col, PIECE):
                bad = {x[0] for x in shared.value.hits(raw_texts(piece, text_col), percent)}
                yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)])) if bad else piece

        df = df.mapInArrow(run, df.schema)
    return df


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, g FROM ({shingles_sql("doc_id", "documents")})),
     i AS (SELECT DISTINCT item_id, g FROM ({shingles_sql("item_id", "benchmark")})),
     n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM d JOIN i USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
