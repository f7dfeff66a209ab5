import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from graphtables.llm import bpe, token_counts, token_shards

WORDS = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_50k.tiktoken")
ODD = ["it's they'RE we'll 'd'd ''s x'", "a  b   c \n\n d\t\te  ", "naïve ÉCOLE 日本語 123٣½ … 😀", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a​b c　d\x1ce\x85f", "é İ ΣΑΣ", "w" * 3000, " " * 3000]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(corpus):
    return corpus + [(900 + k, x) for k, x in enumerate(ODD)]


def test_pieces_at_random(reference):
    rng = random.Random(3)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "a", "Z", "é", "1", "٣", "½", "!", ",", "日本", "́", "😀", "\x1c", "​", "\x85", "r", "v", "'S", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    vocab = bpe.vocabulary(BYTES)
    for text, ids in zip(texts, vocab.encode([x.encode() for x in texts])):
        assert [i for piece in ids for i in piece] == reference.encode_ordinary(text)


def test_classes_of_all_code_points(reference):
    """Whether each code point joins a letter or a digit, as the library has it."""
    ranks = {bytes([i]): i for i in range(256)}
    for lead in range(0xC2, 0xF5):
        for before in b"x1":
            ranks[bytes([before, lead])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = bpe.class_table()
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2A000, 0x32400)]:
        n = len(chr(cp).encode())
        kind = bpe.LETTER if len(probe.encode_ordinary("x" + chr(cp))) == n else bpe.NUMBER if len(probe.encode_ordinary("1" + chr(cp))) == n else None
        assert kind == (int(table[cp]) if table[cp] in (bpe.LETTER, bpe.NUMBER) else None), hex(cp)


def test_encode_and_decode(documents, corpus, reference):
    rows = rows_of(corpus)
    df = documents(rows)
    got = bpe.round_trip(df, BYTES).collect()
    wanted = Counter()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        wanted[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == wanted
    coded = bpe.encode(df, BYTES)
    back = bpe.decode(coded, BYTES).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t in rows)
    for r in coded.collect():
        if r.doc_id == 901:
            raw, vocab = ODD[1].encode(), bpe.vocabulary(BYTES)
            assert [raw[a:b] for a, b in zip(r.offsets, r.offsets[1:])] == [vocab.tokens[i] for i in r.ids]
            ids, offsets = np.array(r.ids), np.array(r.offsets)
            assert all(vocab.span(ids, offsets, a, b) == raw[a:b] for a in range(len(raw) + 1) for b in range(a, min(len(raw), a + 40) + 1))
    assert bpe.round_trip(documents([]), BYTES).count() == 0


@pytest.mark.parametrize("head", [token_counts.HEAD, 5, 0])
def test_token_counts(spark, documents, corpus, head):
    rows = rows_of(corpus)
    library = Tokenizer.from_file(WORDS)
    wanted = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted[i, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, token_counts.count_tokens(spark, documents(rows), WORDS, head=head).collect())) == wanted
    assert token_counts.count_tokens(spark, documents([]), WORDS, head=head).count() == 0


def test_long_pretokens_are_not_broadcast(spark, documents, monkeypatch):
    import graphtables.llm.token_counts as module

    rows = [(k, "ab" * 100_000 + " one two") for k in range(3)]
    heads = []
    most = module.most_frequent
    monkeypatch.setattr(module, "most_frequent", lambda *a: heads.append(most(*a)) or heads[0])
    got = module.count_tokens(spark, documents(rows), WORDS).collect()
    n = len(Tokenizer.from_file(WORDS).encode(rows[0][1], add_special_tokens=False).ids)
    assert {(r.n_bytes, r.n_tokens) for r in got} == {(200_008, n)}
    assert len(heads) == 1


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel(size):
    order = token_shards.Feistel(size, 7)
    places = order.place(np.arange(size))
    assert sorted(places.tolist()) == list(range(size))
    assert (order.index(places) == np.arange(size)).all()
    if size > 100:
        assert (places != token_shards.Feistel(size, 8).place(np.arange(size))).any()


def test_shards(spark, documents, corpus, reference, tmp_path):
    rows = rows_of(corpus)
    source = f"file://{tmp_path}/docs"
    documents(rows).write.parquet(source)
    df, out = spark.read.parquet(source), f"file://{tmp_path}/out"
    manifest = token_shards.write(spark, df, out, BYTES, P.PATTERN, 50256, key=9, length=64, places_a_shard=500)
    assert token_shards.open_manifest(spark, out) == manifest and len(manifest["shards"]) > 3
    whole = sorted(token_shards.read(spark, out).collect(), key=lambda r: r.slot)
    assert [r.slot for r in whole] == list(range(sum(manifest["shards"].values())))
    for f in (tmp_path / "out" / "shards").glob("shard=*/part-*"):
        assert f.stat().st_size % manifest["stride"] == 0
    # Undone, the permutation gives the texts of each partition again, one after the other.
    order = token_shards.Feistel(manifest["places"], 9)
    raw = b"".join(f.read_bytes() for f in (tmp_path / "out" / "shards").glob("shard=*/part-*"))
    heads = [np.frombuffer(raw, token_shards.HEADER, 1, k)[0] for k in range(0, len(raw), manifest["stride"])]
    tokens = [np.frombuffer(raw, "<u2", int(h["n"]), k + token_shards.HEADER.itemsize) for h, k in zip(heads, range(0, len(raw), manifest["stride"]))]
    index = order.index(np.array([h["place"] for h in heads]))
    stream = np.concatenate([tokens[k] for k in np.argsort(index)]).tolist()
    texts, at = [], 0
    while at < len(stream):
        end = stream.index(50256, at)
        texts.append(reference.decode_bytes(stream[at:end]).decode())
        at = end + 1
    assert Counter(texts) == Counter(t for _, t in rows if t)
    # A read that resumes anywhere goes on in the same order.
    part = sorted(token_shards.read(spark, out, 700, 90).collect(), key=lambda r: r.slot)
    assert part == whole[700:790]
    assert token_shards.digests(spark, out).count() == len(whole)
    empty = f"file://{tmp_path}/none"
    token_shards.write(spark, documents([(1, None), (2, "")]), empty, BYTES, P.PATTERN, 50256, key=9)
    assert token_shards.read(spark, empty).count() == token_shards.digests(spark, empty).count() == 0
    # One row, nothing but nulls, nothing but empty texts, no row.
    for k, texts in enumerate([["one two"], [None], ["", ""], []]):
        few = f"file://{tmp_path}/few{k}"
        token_shards.write(spark, documents(list(enumerate(texts))), few, BYTES, P.PATTERN, 50256, key=9)
        assert [reference.decode_bytes(r.tokens[:-1]).decode() for r in token_shards.read(spark, few).collect()] == [t for t in texts if t]
    # Inside one shard, in the order of slots.
    first = next(iter(manifest["shards"].values()))
    assert token_shards.read(spark, out, 3, first - 5).collect() == whole[3 : first - 2]
    with pytest.raises(ZeroDivisionError):
        token_shards.write(spark, df, f"file://{tmp_path}/bad", BYTES, P.PATTERN, 50256, key=9, length=0)
