"""Operator 9: token ids in training order, as shards of records of one size.

The texts of each input partition are tokenized, ended by ``eos``, and packed one after
the other into sequences of ``length`` tokens; only a partition's last one is padded.
No text has more tokens than bytes, so the sizes of the texts give each partition a
range of places, large enough before anything is tokenized, in one dense domain.  A
keyed Feistel network with cycle-walking permutes that domain.  The permuted place
decides the shard (ranges of places, so shards are of about one size; each is one
partition and one file) and the order in it; the global slot of a sequence is the number
of sequences before it in that order.  So texts are tokenized once and moved once.

A record is a header (place, doc_id of the first token, tokens that are no padding)
followed by ``length`` ids of two or four bytes and a line feed; all have the same
number of bytes, so a record's offset in its file tells its slot.  Records are bytes that
go through Spark's text writer, which copies them as they are; sizes that are no
multiple of a record's, or a shard of several files, are an error.  ``read`` goes from
any slot on, in order, and opens only the shards that it needs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm.common import Scratch, mix64, slices, table

LENGTH = 2048
PLACES_A_SHARD = 1 << 15
NO_ID = -(1 << 63)
HEADER = np.dtype([("place", "<i8"), ("doc_id", "<i8"), ("n", "<i4")])


class Feistel:
    """A keyed permutation of range(size)."""

    def __init__(self, size: int, key: int, rounds: int = 6):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        shift, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> shift, x & mask
        for k in keys:
            if back:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
        return left << shift | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys, back)
        while (outside := np.flatnonzero(out >= self.size)).size:
            out[outside] = self._once(out[outside], keys, back)
        return out.astype(np.int64)

    def place(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys, False)

    def index(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self.keys[::-1], True)


@lru_cache(2)
def encoder(path: str, pattern: str):
    import tiktoken

    from graphtables.llm.bpe import vocabulary

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary(path).ranks, special_tokens={})


def _capacities(texts: DataFrame, length: int) -> np.ndarray:
    """Sequences that each partition may need at most, by its number: a place for each byte of its texts and the end of each."""
    size = F.octet_length("text")
    sizes = texts.select(F.spark_partition_id().alias("p"), F.when(size > 0, size + 1).otherwise(0).cast("long").alias("n"))
    found = {r["p"]: r["n"] for r in sizes.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    out = np.zeros(max(found, default=-1) + 1, np.int64)
    for p, n in found.items():
        out[p] = -(-n // length)
    return out


def write(spark: SparkSession, df: DataFrame, out: str, path: str, pattern: str, eos: int, key: int, length: int = LENGTH, places_a_shard: int = PLACES_A_SHARD, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the shards of ``df`` and their manifest below ``out``; returns the manifest.

    ``df`` is read twice and must have the same rows in the same partitions each time,
    as a scan of files does; a partition that outgrows its range raises.  Null and empty
    texts give no token, not even ``eos``.  A null id is kept as such.  Rows that repeat
    are written as often.  Other columns are not read.
    """
    texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").cast("binary").alias("text"))
    need = _capacities(texts, length)
    domain = int(need.sum())
    ranges = spark.sparkContext.broadcast((need, np.cumsum(need) - need))
    order = Feistel(domain, key)
    shards = max(1, -(-domain // places_a_shard))
    width = 2 if eos < 1 << 16 else 4
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        p = TaskContext.get().partitionId()
        room, first = (int(x[p]) if p < len(x) else 0 for x in ranges.value)
        done = 0
        tokens, owners = np.empty(0, kind), np.empty(0, np.int64)

        def cut(tokens: np.ndarray, owners: np.ndarray, real: int) -> pa.RecordBatch:
            nonlocal done
            n = len(tokens) // length
            if done + n > room:
                raise RuntimeError("the input changed between two reads: write it to a table first")
            head = np.zeros(n, HEADER)
            head["place"] = order.place(first + done + np.arange(n))
            head["doc_id"] = owners[::length]
            head["n"] = np.minimum(length, real - np.arange(n) * length)
            done += n
            body = tokens.reshape(n, length)
            values = [h.tobytes() + b.tobytes() for h, b in zip(head, body)]
            return pa.record_batch([pa.array((head["place"] // places_a_shard).astype(np.int32)), pa.array(head["place"]), pa.array(values, pa.binary())], ["shard", "place", "value"])

        for piece in slices(batches, "text", 2 << 20):
            ids, own = [tokens], [owners]
            for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                if t:
                    got = enc.encode_ordinary(t.decode("utf-8"))
                    got.append(eos)
                    ids.append(np.array(got, kind))
                    own.append(np.full(len(got), NO_ID if i is None else i))
            tokens, owners = np.concatenate(ids), np.concatenate(own)
            whole = len(tokens) // length * length
            if whole:
                yield cut(tokens[:whole], owners[:whole], whole)
                tokens, owners = tokens[whole:], owners[whole:]
        if len(tokens):
            real = len(tokens)
            yield cut(np.concatenate([tokens, np.full(length - real, eos, kind)]), np.concatenate([owners, np.full(length - real, owners[-1])]), real)

    if domain:
        rows = texts.mapInArrow(run, "shard int, place long, value binary")
        sorted_ = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "place")
        sorted_.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(f"{out}/shards")
    stride = HEADER.itemsize + width * length + 1
    manifest = {"key": key, "length": length, "width": width, "eos": eos, "stride": stride, "places": domain, "places_a_shard": places_a_shard, "shards": _counts(spark, out, stride) if domain else {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{out}/manifest")
    return manifest


def _counts(spark: SparkSession, out: str, stride: int) -> dict[str, int]:
    """Records of each shard, by the sizes of the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/shards").select("shard", "length")
    found = files.groupBy("shard").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("files")).orderBy("shard").collect()
    for r in found:
        if r["files"] != 1 or r["n"] % stride:
            raise RuntimeError(f"shard {r['shard']} is not one file of whole records")
    return {str(r["shard"]): r["n"] // stride for r in found}


def open_manifest(spark: SparkSession, out: str) -> dict:
    return json.loads(spark.read.text(f"{out}/manifest", wholetext=True).first()[0])


def _records(spark: SparkSession, out: str, manifest: dict, shards: list[int] | None = None) -> DataFrame:
    """The records (record: its number in its shard, value binary) of some or all shards."""
    where = "*" if shards is None else "{" + ",".join(map(str, shards)) + "}"
    kind = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    found = spark.sparkContext.newAPIHadoopFile(f"{out}/shards/shard={where}/part-*", kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{kind}.recordLength": str(manifest["stride"])})
    return found.toDF("record long, value binary")


def _slots(spark: SparkSession, manifest: dict) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """shard, first (its first slot); and the same with the number of records on the driver."""
    out, at = [], 0
    for shard, n in manifest["shards"].items():
        out.append((int(shard), at, n))
        at += n
    return spark.createDataFrame([x[:2] for x in out], "shard int, first long"), out


def _heads(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(v[: HEADER.itemsize] for v in values), HEADER)


def read(spark: SparkSession, out: str, start: int = 0, count: int | None = None) -> DataFrame:
    """slot, shard, record, doc_id (of the first token), n_tokens, tokens array<int> (without padding), for ``count`` slots from ``start`` on, in the order of slots."""
    manifest = open_manifest(spark, out)
    first, shards = _slots(spark, manifest)
    total = sum(n for *_, n in shards)
    stop = total if count is None else min(total, start + count)
    wanted = [x for x, a, n in shards if a < stop and a + n > start]
    if not wanted:
        return spark.createDataFrame([], "slot long, shard int, record int, doc_id long, n_tokens int, tokens array<int>")
    width, a_shard = manifest["width"], manifest["places_a_shard"]

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("value").to_pylist()
            head = _heads(values)
            tokens = [np.frombuffer(v, f"<u{width}", n, HEADER.itemsize).astype(np.int32) for v, n in zip(values, head["n"].tolist())]
            yield pa.record_batch([b.column("record").cast(pa.int32()), pa.array((head["place"] // a_shard).astype(np.int32)), pa.array(head["doc_id"], mask=head["doc_id"] == NO_ID), pa.array(head["n"]), pa.array(tokens, pa.list_(pa.int32()))], ["record", "shard", "doc_id", "n_tokens", "tokens"])

    rows = _records(spark, out, manifest, None if len(wanted) == len(shards) else wanted).mapInArrow(take_apart, "record int, shard int, doc_id long, n_tokens int, tokens array<int>")
    slot = F.col("first") + F.col("record")
    out_ = rows.join(first, "shard").withColumn("slot", slot).filter((F.col("slot") >= start) & (F.col("slot") < stop))
    return out_.select("slot", "shard", "record", "doc_id", "n_tokens", "tokens").orderBy("slot")


def digests(spark: SparkSession, out: str) -> DataFrame:
    """slot, shard, record, doc_id, n_tokens and tokens_sha256 (of the ids as little-endian int32) of every record, from the files."""
    manifest = open_manifest(spark, out)
    first, shards = _slots(spark, manifest)
    if not shards:
        return spark.createDataFrame([], "slot long, shard int, record int, doc_id long, n_tokens int, tokens_sha256 string")
    width, a_shard = manifest["width"], manifest["places_a_shard"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("value").to_pylist()
            head = _heads(values)
            sha = [hashlib.sha256(np.frombuffer(v, f"<u{width}", n, HEADER.itemsize).astype("<i4").tobytes()).hexdigest() for v, n in zip(values, head["n"].tolist())]
            yield pa.record_batch([b.column("record").cast(pa.int32()), pa.array((head["place"] // a_shard).astype(np.int32)), pa.array(head["doc_id"], mask=head["doc_id"] == NO_ID), pa.array(head["n"]), pa.array(sha)], ["record", "shard", "doc_id", "n_tokens", "tokens_sha256"])

    rows = _records(spark, out, manifest).mapInArrow(digest, "record int, shard int, doc_id long, n_tokens int, tokens_sha256 string")
    return rows.join(first, "shard").select((F.col("first") + F.col("record")).alias("slot"), "shard", "record", "doc_id", "n_tokens", "tokens_sha256")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with Scratch(spark) as tmp:
        out = f"{tmp.root}/order"
        write(spark, table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, eos=50256, key=20240229)
        return tmp.keep(digests(spark, out))
