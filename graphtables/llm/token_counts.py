"""Operator 3: token counts without token ids.

A pre-token here is a maximal run without ASCII white space.  The tokenizer's own
pre-tokens never reach across white space, so a text has as many tokens as its
pre-tokens together, and special strings, which hold no white space, lie within one.

1. All pre-tokens of the corpus are counted and each distinct one is tokenized once.
2. The ``head`` most frequent at most (a fixed number, so the size of what is broadcast is
   bounded) go to every task, which sums them while it reads a text again.
3. All others, each of them rarer than any of the head, are joined by value: one row
   for each document and rare pre-token, so no key of that join is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm.common import Scratch, most_frequent, slices, table

HEAD = 1 << 18
#: Longer pre-tokens are never broadcast, so what is takes HEAD * WORD_BYTES at most.
WORD_BYTES = 64
#: No pre-token holds a blank, so these join with none.
OWN = b" "


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


_heads: dict[str, dict[bytes, int]] = {}


def _head(key: str, shared) -> dict[bytes, int]:
    """The broadcast table as a dict, built once for each Python worker."""
    if key not in _heads:
        _heads.clear()
        words, pieces = shared.value
        _heads[key] = dict(zip(words.to_pylist(), pieces.to_pylist()))
    return _heads[key]


def piece_table(texts: DataFrame, path: str) -> DataFrame:
    """word (binary), n_seen, n_pieces of every distinct pre-token of ``texts`` (text binary)."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for piece in slices(batches, "text"):
            for text in piece.column(0).to_pylist():
                if text:
                    counts.update(text.split())
            if len(counts) > 300_000:
                yield flush()
        if counts:
            yield flush()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            words = [w.decode("utf-8") for w in b.column(0).to_pylist()]
            n: list[int] = []
            for k in range(0, len(words), 5000):
                n.extend(len(e.ids) for e in tok.encode_batch_fast(words[k : k + 5000], add_special_tokens=False))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], ["word", "n_seen", "n_pieces"])

    counted = texts.select("text").mapInArrow(seen, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(pieces, "word binary, n_seen long, n_pieces long")


def count_tokens(spark: SparkSession, df: DataFrame, path: str, limit: int = 2048, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``df``.

    Null and empty texts have no bytes and no tokens.  Rows repeat as they do in the
    input, rows with a null or repeated id are counted one by one, and other columns
    are not read.  Rows are told apart by partition and place, so ``df`` must give the
    same rows in the same order when a task runs again, as a scan of files does.
    """
    texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").cast("binary").alias("text"))
    with Scratch(spark) as tmp:
        vocab = tmp.table(piece_table(texts, path), "pieces")
        top = most_frequent(vocab.filter(F.octet_length("word") <= WORD_BYTES), "n_seen", head).select("word", "n_pieces").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((top.column(0).cast(pa.binary()), top.column(1)))

        key = tmp.root

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _head(key, shared)
            uid = TaskContext.get().partitionId() << 33
            for piece in slices(batches, "text", 1 << 20):
                uids, ids, sizes, sums, words, times = [], [], [], [], [], []
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    uid += 1
                    total, text = 0, text or b""
                    counts = Counter(text.split())
                    rare = [w for w in counts if w not in known]
                    if rare:
                        uids += [uid] * len(rare)
                        ids += [None] * len(rare)
                        sizes += [0] * len(rare)
                        sums += [0] * len(rare)
                        words += rare
                        times += [counts.pop(w) for w in rare]
                    for w, n in counts.items():
                        total += known[w] * n
                    uids.append(uid)
                    ids.append(doc_id)
                    sizes.append(len(text))
                    sums.append(total)
                    words.append(OWN + uid.to_bytes(8, "big"))
                    times.append(0)
                yield pa.record_batch([pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["uid", "doc_id", "n_bytes", "n_head", "word", "times"])

        rows = texts.mapInArrow(split, "uid long, doc_id long, n_bytes long, n_head long, word binary, times long")
        joined = rows.join(vocab.select("word", "n_pieces"), "word", "left")
        # A row's own line is the one that has its id and size; the sums are over all its lines.
        out = (
            joined.groupBy("uid")
            .agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n_head") + F.col("times") * F.coalesce("n_pieces", F.lit(0))).alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
        )
        return tmp.keep(out)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
