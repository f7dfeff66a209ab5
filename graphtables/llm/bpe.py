"""Operator 8: byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex.  Each code point gets a class by table lookup, and
two facts about it follow from scans over the class array: where its run of equal
classes begins, and where the contractions lie.  A contraction such as ``'re`` can
only be told from the state that the characters before it leave, so that state is
found by composing transition functions: each character is a function from states
to states, composition is associative, and the functions of blocks of characters are
composed side by side before the blocks' results are chained.

The slices then go through a table of pieces already merged; only a piece that was
not seen before is merged pair by pair.  Byte offsets of every token are kept, so
that ids can be decoded as a whole or from any span of a text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphtables.llm.common import map_batches, table

# Classes of code points.  Fixed values: the apostrophe and the letters of the contractions
# 's 't 're 've 'm 'll 'd have classes of their own.
LETTER, NUMBER, SPACE, BLANK, OTHER, APOSTROPHE = 0, 1, 2, 3, 4, 5
C_SINGLE, C_R, C_V, C_L, C_E = 6, 7, 8, 9, 10
CLASSES = 11
# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Ranges of letters and numbers of Unicode 16 that Python's tables lack (first, last, class).
NEWER = [
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER),
    (0x10D40, 0x10D49, NUMBER), (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER),
    (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER), (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER),
    (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER), (0x116D0, 0x116E3, NUMBER),
    (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER),
    (0x1CCF0, 0x1CCF9, NUMBER), (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
]


@lru_cache(1)
def class_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    for first, last, kind in NEWER:
        out[first : last + 1] = kind
    out[WHITE_SPACE] = SPACE
    out[0x20] = BLANK
    out[ord("'")] = APOSTROPHE
    out[[ord(c) for c in "stmd"]] = C_SINGLE
    for c, kind in (("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        out[ord(c)] = kind
    return out


# States after a character: what a match that covers it would be, as far as the next one needs it.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_APOS, S_R, S_V, S_L, S_DONE = range(11)
STATES = 11


@lru_cache(1)
def transition_table() -> np.ndarray:
    """next state = table[class, state].

    S_APOS: an apostrophe that begins a match, so a contraction may follow; S_R, S_V,
    S_L: such an apostrophe and one letter, of which the contraction needs a second;
    S_DONE: a whole contraction, after which a new match begins.
    """
    plain = {LETTER: S_LETTER, NUMBER: S_NUMBER, SPACE: S_SPACE, BLANK: S_BLANK, OTHER: S_OTHER, C_SINGLE: S_LETTER, C_R: S_LETTER, C_V: S_LETTER, C_L: S_LETTER, C_E: S_LETTER}
    out = np.zeros((CLASSES, STATES), np.uint8)
    for kind in range(CLASSES):
        for state in range(STATES):
            if kind == APOSTROPHE:
                # After a blank it belongs to the match that the blank opens, and inside other signs to theirs.
                out[kind, state] = S_OTHER if state in (S_BLANK, S_OTHER, S_APOS) else S_APOS
            elif state == S_APOS and kind == C_SINGLE:
                out[kind, state] = S_DONE
            elif state == S_APOS and kind in (C_R, C_V, C_L):
                out[kind, state] = {C_R: S_R, C_V: S_V, C_L: S_L}[kind]
            elif (state in (S_R, S_V) and kind == C_E) or (state == S_L and kind == C_L):
                out[kind, state] = S_DONE
            else:
                out[kind, state] = plain[kind]
    return out


def scan_states(kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The state after each character; at ``begins`` a new text starts from S_START.

    Blocks of about sqrt(n) characters compose their functions side by side, one short
    pass chains the blocks, and a second pass over all blocks at once fills the states.
    """
    n = len(kinds)
    table_ = transition_table()
    functions = np.vstack([table_, np.repeat(table_[:, S_START : S_START + 1], STATES, 1)])  # the second half forgets the state
    ids = kinds.astype(np.int32)
    ids[begins] += CLASSES
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.int32)
    padded[:n] = ids
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    composed = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for row in grid:
        composed = functions[row[:, None], composed]
    entry = np.empty(blocks, np.uint8)
    state = S_START
    for b in range(blocks):
        entry[b] = state
        state = composed[b, state]
    out = np.empty((width, blocks), np.uint8)
    now = entry
    for k, row in enumerate(grid):
        now = functions[row, now]
        out[k] = now
    return out.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; ``begins`` are the starts of the texts."""
    n = len(points)
    kinds = class_table()[points]
    first = np.zeros(n, bool)
    first[begins] = True
    state = scan_states(kinds, begins)
    broad = np.where(kinds >= C_SINGLE, LETTER, kinds)
    broad = np.where(broad == APOSTROPHE, OTHER, np.where(broad == BLANK, SPACE, broad))
    last = np.roll(first, -1)  # of its text
    space = broad == SPACE
    start = first.copy()
    start[1:] |= broad[1:] != broad[:-1]
    # The last blank before a word joins it; other last white space stands alone.
    ends_run = space & ~last
    ends_run[:-1] &= ~space[1:]
    ends_run[-1] = False
    tail = np.flatnonzero(ends_run)
    start[tail] = True
    joins = tail[points[tail] == 0x20]
    start[joins + 1] = False
    # A contraction is a match of its own; what follows it, or an apostrophe that begins none, is as the classes say.
    done = np.flatnonzero(state == S_DONE)
    if len(done):
        two = np.isin(state[done - 1], (S_R, S_V, S_L))
        at = done - 1 - two
        start[at] = True
        start[at + 1] = False
        start[done] = False
        follow = done[done < n - 1] + 1
        start[follow] = True
    return start


class Vocabulary:
    """Ranks of a byte-level BPE, its merges and its table for decoding."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = list(map(str, range(len(self.tokens))))
        self.sizes = np.array(list(map(len, self.tokens)), np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.most = most

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the adjacent pair of least rank is joined, leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self.merge_long(parts)
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == 1 << 30:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        return tuple(map(ranks.__getitem__, parts))

    def merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same with a heap and links between neighbours, for pieces of many bytes."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive: list[bytes | None] = list(parts)
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if alive[i] is not None else n
            if j >= n or len(alive[i]) + len(alive[j]) != size:
                continue
            alive[i] += alive[j]
            alive[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    both = alive[k] + alive[after[k]]
                    if (r := ranks.get(both)) is not None:
                        heapq.heappush(heap, (r, k, len(both)))
        return tuple(ranks[p] for p in alive if p is not None)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = self.merge(p)
        return list(map(known.__getitem__, pieces))

    def encode(self, raws: list[bytes]) -> list[list[tuple[int, ...]]]:
        """For each UTF-8 text the ids of its pre-tokens."""
        live = [r for r in raws if r]
        out: list[list[tuple[int, ...]]] = [[] for _ in raws]
        if not live:
            return out
        whole = b"".join(live)
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)  # byte offset of each code point
        byte_begins = np.cumsum([0, *map(len, live[:-1])])
        begins = np.searchsorted(lead, byte_begins)
        starts = lead[piece_starts(points, begins)]
        cuts = starts.tolist() + [len(whole)]
        pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        ids = self.encode_pieces(pieces)
        bounds = [*np.searchsorted(starts, byte_begins).tolist(), len(pieces)]
        k = 0
        for i, r in enumerate(raws):
            if r:
                out[i] = ids[bounds[k] : bounds[k + 1]]
                k += 1
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text, and the text's length at the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The text of the ids: each byte is taken from its token, which lies at its offset; a piece of tokens at a time, so memory follows the text."""
        out = []
        for k in range(0, len(ids), 1 << 16):
            at = offsets[k : k + (1 << 16) + 1]
            some = ids[k : k + (1 << 16)]
            out.append(self.spelled[np.repeat(self.begins[some] - at[:-1], np.diff(at)) + np.arange(at[0], at[-1])].tobytes())
        return b"".join(out)

    def span(self, ids: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> bytes:
        """Bytes ``begin`` to ``end`` of the text, from the tokens that lie there alone."""
        if begin >= end:
            return b""
        i, j = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left")
        return self.decode(ids[i:j], offsets[i : j + 1])[begin - offsets[i] : end - offsets[i]]


#: Bytes of text taken apart at a time: their pre-tokens and ids take some thirty times as much memory.
PIECE = 1 << 19


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker: pieces merged for a task serve the next."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, ids array<int>, offsets array<int> (byte offset of each token, then the length).

    A null or empty text has no ids.  Rows repeat as they do in the input, a null id
    stays null, and other columns are not read.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(path)
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in vocab.encode([t or b"" for t in batch.column(1).to_pylist()])]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([vocab.offsets(x) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids", "offsets"])

    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").cast("binary").alias("text"))
    return map_batches(picked, make, "doc_id long, ids array<int>, offsets array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text (binary) of the ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            ids = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([vocab.decode(x, vocab.offsets(x)) for x in ids], pa.binary())], ["doc_id", "decoded"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; the ids themselves stay in the task that makes them.

    Nulls and empty texts count as empty: no tokens and the digests of nothing.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(path)
        n, coded, decoded = [], [], []
        for x in vocab.encode([t or b"" for t in batch.column(1).to_pylist()]):
            listed = list(chain.from_iterable(x))
            ids = np.array(listed, np.int64)
            n.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(vocab.decimal.__getitem__, listed)).encode()).hexdigest())
            decoded.append(hashlib.sha256(vocab.decode(ids, vocab.offsets(ids))).hexdigest())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").cast("binary").alias("text"))
    return map_batches(picked, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", most=PIECE)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
