"""Sets of word shingles for many texts at once, in one order for the whole corpus.

Words are runs without ASCII white space, A-Z lower-cased.  A text's set holds its
distinct shingles of ``width`` words as 64-bit hashes; with fewer words it holds the
whole sequence as one; without words it is empty.

The order is by rarity, the rarest first: a shingle is as rare as its rarest word, and
words are counted over all texts in a table of fixed size, where words may share a
counter.  Any order that all tasks agree on gives exact joins; this one keeps shingles
of wide-spread passages out of the prefixes, however many texts hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtables.llm.common import Scratch, hash_words, joined, mix64, slices

COUNTER_BITS = 17
SLOTS = 1 << 25
TILE = 1024
#: Sets of more tokens have a long signature besides.
LONG = 512
PIECE = 2 << 20
MOST = 1 << 18
COUNTERS = 1 << 19
#: Counters come in rows of LANES, and BLOCK rows of them to the driver at a time.
LANES = 16
BLOCK = 256
#: Odd multipliers for the places of a shingle's words.
PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class Rows(NamedTuple):
    """Units whose sets are joined: the hashes of all their words, how many words each has, the text it is from and its number there."""

    words: np.ndarray
    lens: np.ndarray
    text: np.ndarray
    number: np.ndarray


def whole_texts(raws: list[bytes | None]) -> Rows:
    text, begins = joined(raws)
    words, starts = hash_words(text)
    ends = np.searchsorted(starts, np.append(begins[1:], len(text)))
    return Rows(words, np.diff(ends, prepend=0), np.arange(len(raws)), np.zeros(len(raws), np.int64))


def lines(raws: list[bytes | None]) -> Rows:
    """The lines that have words."""
    text, begins = joined(raws)
    words, starts = hash_words(text)
    feeds = np.flatnonzero(text == 10)
    ends = np.searchsorted(starts, feeds)
    lens = np.diff(ends, prepend=0)
    line_begins = np.concatenate([[0], feeds[:-1] + 1])
    owner = np.searchsorted(begins, line_begins, "right") - 1
    first = np.searchsorted(line_begins, begins)
    full = np.flatnonzero(lens)
    return Rows(words, lens[full], owner[full], full - first[owner[full]])


def word_rarity(texts: DataFrame, bits: int = COUNTER_BITS) -> np.ndarray:
    """How often the words of each counter occur in all texts, in 64 logarithmic steps; 2**bits counters, whatever the corpus holds."""

    lanes = [f"c{k}" for k in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for piece in slices(batches, "text", PIECE):
            words, _ = hash_words(joined(piece.column("text").to_pylist())[0])
            total += np.bincount((words >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        table = total.reshape(-1, LANES)
        at = np.flatnonzero(table.any(axis=1))
        if len(at):
            yield pa.record_batch([pa.array(at.astype(np.int32)), *(pa.array(table[at, k]) for k in range(LANES))], ["slot", *lanes])

    def pack(counters: pa.Table) -> pa.Table:
        at = counters.column("slot").to_numpy()
        out = np.zeros((BLOCK, LANES), np.uint8)
        for k, lane in enumerate(lanes):
            out[at % BLOCK, k] = np.minimum(1.5 * np.log2(counters.column(lane).to_numpy() + 1.0), 63)
        return pa.table([pa.array([at[0] // BLOCK], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "steps"])

    counted = texts.select("text").mapInArrow(run, "slot int, " + ", ".join(f"{x} long" for x in lanes)).groupBy("slot").agg(*(F.sum(x).alias(x) for x in lanes))
    blocks = counted.groupBy(F.expr(f"slot div {BLOCK}")).applyInArrow(pack, "block int, steps binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    size = BLOCK * LANES
    for r in blocks:
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["steps"]), np.uint8)
    return out


class Sets:
    """Sets of a list of texts: the i-th one is tokens[offsets[i]:offsets[i + 1]], in the order of the corpus."""

    def __init__(self, tokens: np.ndarray, rows: np.ndarray, n: int):
        self.tokens, self.rows = tokens, rows
        self.sizes = np.bincount(rows, minlength=n)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.nodes = np.zeros(n, np.int64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            sums = np.add.reduceat(mix64(tokens), self.offsets[full])
            self.nodes[full] = mix64(sums + self.sizes[full].astype(np.uint64)).view(np.int64)

    def _first(self, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The first most[k] tokens of the k-th of the (ascending) rows, one after the other."""
        size = np.zeros(len(self.sizes), np.int64)
        size[rows] = most
        place = np.arange(len(self.tokens)) - self.offsets[self.rows]
        return self.tokens[place < size[self.rows]].view(np.int64)

    def lists(self, rows: np.ndarray) -> pa.ListArray:
        """All tokens of each of the (ascending) rows."""
        sizes = self.sizes[rows]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(self._first(rows, sizes)))

    def prefixes(self, rows: np.ndarray, percent: int) -> pa.Array:
        """For every set, the tokens of its prefix as bytes; null but for the (ascending) rows."""
        most = np.zeros(len(self.sizes), np.int64)
        most[rows] = self.sizes[rows] - least_overlap(self.sizes[rows], percent) + 1
        valid = np.zeros(len(self.sizes), bool)
        valid[rows] = True
        ends = np.concatenate([[0], 8 * np.cumsum(most)]).astype(np.int32)
        bits = np.packbits(valid, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), len(most), [pa.py_buffer(bits), pa.py_buffer(ends), pa.py_buffer(self._first(rows, most[rows]))])


def tokens_in(prefix: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of prefixes without nulls: all tokens, the row and the place in it of each."""
    prefix = prefix.cast(pa.binary())
    ends = np.frombuffer(prefix.buffers()[1], np.int32)[prefix.offset : prefix.offset + len(prefix) + 1].astype(np.int64)
    if not len(prefix) or ends[0] == ends[-1]:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    tokens = np.frombuffer(prefix.buffers()[2], np.int64, (ends[-1] - ends[0]) // 8, ends[0])
    sizes = np.diff(ends) // 8
    row = np.repeat(np.arange(len(sizes)), sizes)
    return tokens, row, np.arange(len(tokens)) - (np.cumsum(sizes) - sizes)[row]


def shingle_hashes(flat: np.ndarray, lens: np.ndarray, width: int, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and rarity (the least of its words') of every shingle of rows of ``lens`` words each."""
    row = np.repeat(np.arange(len(lens)), lens)
    begins = np.cumsum(lens) - lens
    left = np.repeat(begins + lens, lens) - np.arange(len(flat))
    spread = mix64(flat)
    rare = steps[(flat >> np.uint64(65 - len(steps).bit_length())).astype(np.int64)] if steps is not None else np.zeros(len(flat), np.uint8)
    hs, rs, ks = [], [], []
    for w in range(1, width + 1):
        at = np.flatnonzero(left >= w) if w == width else begins[lens == w]
        if not len(at):
            continue
        # Of every run of w words, then of those that lie in one row.
        runs = len(flat) - w + 1
        if w < width:
            h, k = np.full(len(at), w, np.uint64), rare[at]
            for j in range(w):
                h += spread[at + j] * np.uint64(PLACES[j % 5]) + np.uint64(j)
                k = np.minimum(k, rare[at + j])
        else:
            h, k = np.full(runs, w, np.uint64), rare[:runs]
            for j in range(w):
                h += spread[j : j + runs] * np.uint64(PLACES[j % 5]) + np.uint64(j)
                k = np.minimum(k, rare[j : j + runs])
            h, k = h[at], k[at]
        hs.append(mix64(h))
        rs.append(row[at])
        ks.append(k)
    if not hs:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    return np.concatenate(hs), np.concatenate(rs), np.concatenate(ks)


def ordered_sets(flat: np.ndarray, lens: np.ndarray, width: int, steps: np.ndarray) -> Sets:
    """``steps``: the rarity of each counter."""
    h, r, k = shingle_hashes(flat, lens, width, steps)
    if not len(h):
        return Sets(h, r, len(lens))
    key = (r.astype(np.uint64) << np.uint64(44)) | (k.astype(np.uint64) << np.uint64(38)) | (h >> np.uint64(26))
    order = np.argsort(key)
    if ((key[order][1:] == key[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
        order = np.lexsort((h, key))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return Sets(h[new], r[new], len(lens))


def pieces_of(rows: Rows, width: int, steps: np.ndarray) -> Iterator[tuple[slice, Sets]]:
    """The sets of the rows, as many at a time as have about MOST words together; one long row makes a piece of its own."""
    ends = np.cumsum(rows.lens)
    block = (ends - rows.lens) // MOST
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(rows.lens)] if len(rows.lens) else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield slice(a, b), ordered_sets(rows.words[ends[a] - rows.lens[a] : ends[b - 1]], rows.lens[a:b], width, steps)


def signatures(sets: Sets, words: int) -> np.ndarray:
    """The parity bitmap of every set, as a row of 64-bit words; counted for as many sets at a time as COUNTERS allow."""
    bits = 64 * words
    out = np.empty((len(sets.sizes), words), np.int64)
    step = max(1, COUNTERS // bits)
    for k in range(0, len(out), step):
        a, b = sets.offsets[k], sets.offsets[min(k + step, len(out))]
        n = min(step, len(out) - k)
        bit = (sets.tokens[a:b] >> np.uint64(20)).astype(np.int64) % bits
        parity = np.bincount((sets.rows[a:b] - k) * bits + bit, minlength=n * bits) & 1
        out[k : k + n] = np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(-1, words)
    return out


def apart(a: list[Column], b: list[Column]) -> Column:
    """The differing bits of two signatures."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:]):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def long_signatures(sets: Sets, rows: np.ndarray) -> pa.Array:
    """For every set, a parity bitmap as long as the set asks for; null but for the (ascending) rows, and for those of up to LONG tokens.

    It has a power of two of 64-bit words, 2 to 4 bits for each token.  Parity bitmaps
    fold: the halves of a longer one, one upon the other, are the shorter one.
    """
    out: list[np.ndarray | None] = [None] * len(sets.sizes)
    for i in rows[sets.sizes[rows] > LONG].tolist():
        n = int(sets.sizes[i])
        bits = 64 << (n // 32 - 1).bit_length()
        tokens = sets.tokens[sets.offsets[i] : sets.offsets[i + 1]]
        parity = np.bincount(((tokens >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(parity.astype(np.uint8)).view(np.int64)
    return pa.array(out, pa.list_(pa.int64()))


def long_may_link(x: Column, y: Column, na: Column, nb: Column, percent: int) -> Column:
    """``may_link`` of long signatures, where both have one."""
    half = lambda v: F.zip_with(F.slice(v, 1, F.floor(F.size(v) / 2).cast("int")), F.slice(v, F.floor(F.size(v) / 2).cast("int") + 1, F.size(v)), lambda p, q: p.bitwiseXOR(q))
    both = F.when(F.size(x) == F.size(y), F.array(F.struct(x.alias("x"), y.alias("y")))).when(F.size(x) == 2 * F.size(y), F.array(F.struct(half(x).alias("x"), y.alias("y")))).when(2 * F.size(x) == F.size(y), F.array(F.struct(x.alias("x"), half(y).alias("y"))))
    pair = F.get(both, F.lit(0))
    bits = F.aggregate(F.zip_with(pair["x"], pair["y"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    return F.coalesce((100 + percent) * (na + nb - bits) >= 2 * percent * (na + nb), F.lit(True))


def may_link(a: list[Column], b: list[Column], na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of these sizes and signatures can link: their overlap is at most (na + nb - differing bits) / 2."""
    return (100 + percent) * (na + nb - apart(a, b)) >= 2 * percent * (na + nb)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits, of fixed size, that has the bit of every ``key``; Spark makes it in buckets."""
    slot = (F.col("key").bitwiseAND(F.lit(SLOTS - 1)) + 1).alias("slot")  # the bitmap functions count from 1
    rows = keys.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in rows:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(bits)] = bits
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit set."""
    slot = keys & (SLOTS - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) > 0


def tiles_of(tmp: Scratch, rows: DataFrame) -> DataFrame:
    """leader, node, n, pos: the classes of ``rows`` (node, n, prefix) by the leaders of their prefix tokens.

    A token that several classes have in their prefixes is led by the least of them; a
    class is in the tile of each leader of its tokens, with the first place in its
    prefix of a token of that leader.  Leaders come from sums by token, so no task
    meets all classes of a token.  Most tokens belong to one class: a bitmap of fixed
    size drops those (a part of them, once it fills up) before classes are joined to
    leaders, and Spark may split that join.
    """
    full = rows.filter("prefix is not null").select("node", "n", "prefix")
    least, most = F.min("node").alias("leader"), F.max("node").alias("last")
    size = dict(rows.dtypes)["n"]

    def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row, _ = tokens_in(batch.column("prefix"))
            yield pa.record_batch([pa.array(tokens), batch.column("node").take(pa.array(row))], ["token", "node"])

    shared = full.select("node", "prefix").mapInArrow(all_tokens, "token long, node long").groupBy("token").agg(least, most).filter("leader <> last")
    shared = tmp.table(shared.select("token", "leader"), "shared")
    bits = tmp.spark.sparkContext.broadcast(bit_filter(shared.select(F.col("token").alias("key"))))

    def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row, pos = tokens_in(batch.column("prefix"))
            at = np.flatnonzero(_has(bits.value, tokens))
            own = pa.array(row[at])
            yield pa.record_batch([pa.array(tokens[at]), batch.column("node").take(own), batch.column("n").take(own), pa.array(pos[at].astype(np.int32))], ["token", "node", "n", "pos"])

    held = full.mapInArrow(shared_tokens, f"token long, node long, n {size}, pos int")
    tiles = tmp.table(held.join(shared, "token").groupBy("leader", "node", "n").agg(F.min("pos").alias("pos")), "tiles")
    tmp.free(shared)
    return tiles


def blocks_of(tiles: DataFrame) -> DataFrame:
    """leader, members, blocks: into how many blocks of about TILE classes each tile is split."""
    return tiles.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / TILE).cast("int"))


def block() -> Column:
    """The block of a class in its tile."""
    return F.pmod(F.hash("node"), F.col("blocks")).alias("block")


def all_blocks() -> Column:
    """Every block of a tile."""
    return F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")


def signed_classes(tmp: Scratch, rows: DataFrame, tiles: DataFrame, signature: list[str]) -> DataFrame:
    """node, h and the signature of each class that is in a tile."""
    mine = rows.filter(F.col(signature[0]).isNotNull()).select("node", "h", *signature).join(tiles.select("node").distinct(), "node", "left_semi")
    return tmp.table(mine.groupBy("node").agg(F.first("h").alias("h"), *(F.first(s).alias(s) for s in signature)), "signatures")


def sets_of_nodes(tmp: Scratch, texts: DataFrame, wanted: DataFrame, units: Callable[[list[bytes | None]], Rows], steps: np.ndarray, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """node, tokens array<long> of the classes in ``wanted`` (node, h) and of some others; and the tables to free after use.

    ``h`` is the hash of one text (in column h of ``texts``) that has the class; only
    texts whose bit is set are taken apart again, and of their classes those whose bit
    is set go on.  A class that several tasks met is kept once.
    """
    shared = texts.sparkSession.sparkContext.broadcast((bit_filter(wanted.select(F.col("h").alias("key"))), bit_filter(wanted.select(F.col("node").alias("key"))), steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_text, by_node, steps = shared.value
        part = TaskContext.get().partitionId()
        seen: set[int] = set()
        for batch in batches:
            some = batch.filter(pa.array(_has(by_text, batch.column("h").to_numpy())))
            for piece in slices(iter([some]), "text", PIECE):
                for _, sets in pieces_of(units(piece.column("text").to_pylist()), width, steps):
                    rows = []
                    for i in np.flatnonzero((sets.sizes > 0) & _has(by_node, sets.nodes)).tolist():
                        node = int(sets.nodes[i])
                        if node not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(node)
                            rows.append(i)
                    if rows:
                        at = np.array(rows)
                        yield pa.record_batch([pa.array(sets.nodes[at]), pa.array(np.full(len(at), part, np.int32)), sets.lists(at)], ["node", "part", "tokens"])

    sets = tmp.table(texts.select("h", "text").mapInArrow(run, "node long, part int, tokens array<long>"), "sets")
    again = tmp.table(sets.groupBy("node").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most").select("node", "least"), "again")
    if not again.isEmpty():
        once = sets.join(again, "node", "left").filter("least is null or part = least")
    else:
        once = sets
    return once.select("node", "tokens"), [sets, again]


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n elements shares at least with any set that it links with."""
    return -(-percent * n // 100)


def overlap_links(na: str, nb: str, common, percent: int):
    """Whether sets of na and nb elements with ``common`` of them in common are similar enough."""
    return (100 + percent) * common >= percent * (F.col(na) + F.col(nb))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, na, b, nb) whose sets overlap enough, as (a, b)."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(overlap_links("na", "nb", F.size(F.array_intersect("ta", "tb")), percent)).select("a", "b")


def shingles_sql(key: str, table: str) -> str:
    """DuckDB SQL of (key, g): the shingles of five words of each row's ``text``, g as text, repeats and all."""
    return f"""
    SELECT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})
    """
