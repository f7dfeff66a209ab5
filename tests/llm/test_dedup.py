import random
from collections import Counter

import numpy as np
import pytest

from graphtables.llm import decontaminate, jaccard_join, line_dedup, shingle_sets
from tests.llm.conftest import make_words, shingles_of, words_of


def similar(a, b):
    n = len(a & b)
    return bool(a) and bool(b) and 100 * n >= 80 * (len(a) + len(b) - n)


def components_of(rows):
    sets = [shingles_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                label[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


def near_copies(rng, n, size, edits):
    base = make_words(rng, size)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = rng.choice(make_words(rng, 1)) + "x"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, documents, corpus):
    assert Counter(map(tuple, jaccard_join.near_duplicates(spark, documents(corpus)).collect())) == components_of(corpus)


def test_large_groups_and_shared_passages(spark, documents):
    """A group of near copies at and below the threshold, and texts that share a long passage only."""
    rng = random.Random(11)
    passage = " ".join(make_words(rng, 40))
    texts = near_copies(rng, 120, 120, 4) + near_copies(rng, 60, 60, 6) + [" ".join([*make_words(rng, 70), passage, *make_words(rng, 60)]) for _ in range(80)]
    chain = make_words(rng, 100)
    for k in range(12):  # each like the one before it, the ends unlike
        chain = chain[4:] + make_words(rng, 4)
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert Counter(map(tuple, jaccard_join.near_duplicates(spark, documents(rows)).collect())) == components_of(rows)


def test_one_of_each(spark, documents, corpus):
    df = documents(corpus)
    kept = jaccard_join.one_of_each(spark, df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    marks = components_of(corpus)
    gone = {i for i, n, c in marks if n and i is not None and i != c}
    assert got == Counter({(i, t): 1 if (i, t) == corpus[0] else n for (i, t), n in Counter(corpus).items() if i not in gone})


def test_empty_tables(spark, documents):
    none = documents([])
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.near_duplicates(spark, none).count() == line_dedup.late_lines(spark, none).count() == 0
    assert jaccard_join.one_of_each(spark, none).count() == decontaminate.without_contaminated(spark, none, items).count() == 0
    assert decontaminate.contained_items(spark, none, items).count() == 0
    blank = documents([(1, None), (2, ""), (3, " \n ")])
    assert sorted(map(tuple, jaccard_join.near_duplicates(spark, blank).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert line_dedup.without_lines(blank, line_dedup.late_lines(spark, blank)).count() == 3


def late_of(rows, hashes):
    keyed = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if words_of(line):
                keyed[(i is not None, i, hashes[i, t]) + (k,)] = shingles_of(line)
    order = sorted(keyed, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
    return {key for j, key in enumerate(order) if any(similar(keyed[key], keyed[e]) for e in order[:j])}


@pytest.mark.parametrize("seed", [0, 1])
def test_lines(spark, documents, corpus, seed):
    rng = random.Random(seed)
    pool = near_copies(rng, 40, 30, 2) + near_copies(rng, 20, 8, 1) + near_copies(rng, 30, 60, 5) + [" ".join(make_words(rng, rng.randint(1, 9))) for _ in range(40)]
    rows = corpus + [(2000 + k, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(1, 8)))) for k in range(60)]
    df = documents(rows)
    hashes = {(r.doc_id, r.text): r.h2 for r in df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h2").collect()}
    late = line_dedup.late_lines(spark, df)
    wanted = late_of(rows, hashes)
    assert {(r.doc_id is not None, r.doc_id, r.h, r.line_no) for r in late.collect()} == wanted
    kept = line_dedup.without_lines(df, late)
    assert kept.columns == df.columns
    left = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k for k in range(len(lines)) if (i is not None, i, hashes[i, t], k) in wanted]
        text = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or words_of(text):
            left[i, text] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == left


def test_one_word_lines(spark, documents):
    """A very long text of very many short lines."""
    rng = random.Random(4)
    lines = [f"w{rng.randrange(300_000)}" for _ in range(500_000)]
    late = line_dedup.late_lines(spark, documents([(1, "\n".join(lines))])).collect()
    seen, wanted = set(), set()
    for k, x in enumerate(lines):
        if x in seen:
            wanted.add(k)
        seen.add(x)
    assert {r.line_no for r in late} == wanted


def test_large_tile(spark, documents):
    """Thousands of classes that share a rare passage, of which few are near copies: more than a block of one tile."""
    rng = random.Random(9)
    shared = " ".join(make_words(rng, 12))
    rows = [(k, f"{shared} {' '.join(f'u{k}x{j}' for j in range(20))}") for k in range(2500)]
    copies = [(5000 + k, f"{t} z{k}") for k, (_, t) in enumerate(rows[::50])]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark, documents(rows + copies)).collect()}
    assert got == {k: k for k, _ in rows} | {5000 + k: 50 * k for k in range(len(copies))}
    late = line_dedup.late_lines(spark, documents(rows + copies)).collect()
    assert {r.doc_id for r in late} == {i for i, _ in copies}


def test_signatures_bound_the_difference():
    """Parity bitmaps of one set, whole or in blocks, are the same, and fold to shorter ones."""
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 60, 6000).astype(np.uint64)
    lens = np.array([5000, 7, 0, 993])
    sets = shingle_sets.ordered_sets(words, lens, 5, np.zeros(1 << 17, np.uint8))
    whole = shingle_sets.signatures(sets, 4)
    few = shingle_sets.COUNTERS
    try:
        shingle_sets.COUNTERS = 256
        assert (shingle_sets.signatures(sets, 4) == whole).all()
    finally:
        shingle_sets.COUNTERS = few
    long = shingle_sets.long_signatures(sets, np.arange(4))
    assert [None if x is None else len(x) for x in long.to_pylist()] == [256, None, None, 32]
    x = np.array(long[0].as_py(), np.int64)
    while len(x) > 4:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    assert (x == whole[0]).all()


def test_contained_items(spark, documents, corpus):
    rng = random.Random(2)
    items = [(k, " ".join(make_words(rng, n))) for k, n in enumerate([1, 3, 5, 6, 8, 9, 17, 18, 30, 33, 60, 64, 65, 200])]
    items += [(50, None), (51, ""), (52, items[8][1]), (None, items[9][1]), (53, "one two")]
    rows = list(corpus)
    for k, (_, t) in enumerate(items[:14]):
        filler = lambda n: " ".join(make_words(rng, n))
        edited = t.split()
        edited[0] += "q"
        rows += [(3000 + 10 * k, t), (3001 + 10 * k, f"{filler(400)} {t.upper()}\n{filler(300)}"), (3002 + 10 * k, f"{filler(50)} {' '.join(edited)} {filler(9)}"), (3003 + 10 * k, filler(100) + " " + " ".join(t.split()[: len(t.split()) // 2]))]
    table = spark.createDataFrame([(*x, None) for x in items], "item_id long, text string, doc_id string")
    sets = [(i, shingles_of(t)) for i, t in items]
    wanted = Counter()
    for i, t in rows:
        own = shingles_of(t)
        for item, s in sets:
            if s and 100 * len(s & own) >= 80 * len(s):
                wanted[i, item, len(s & own), len(s)] += 1
    df = documents(rows)
    assert Counter(map(tuple, decontaminate.contained_items(spark, df, table).collect())) == wanted
    kept = decontaminate.without_contaminated(spark, df, table)
    assert kept.columns == df.columns
    bad = {t for _, t in rows if any(s and 100 * len(s & shingles_of(t)) >= 80 * len(s) for _, s in sets)}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(x for x in rows if x[1] not in bad)


def test_items_in_blocks(spark, documents, corpus, monkeypatch):
    """Items that come in many blocks give the same."""
    some = [(i, t) for i, t in corpus if i is not None and t and len(t) < 2000 and words_of(t)]
    items = spark.createDataFrame(some, "item_id long, text string")
    whole = Counter(map(tuple, decontaminate.contained_items(spark, documents(corpus), items).collect()))
    blocks = list(decontaminate.item_blocks(items, 5, 32, "item_id", "text", block_bytes=4000))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == len(some)
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (4000,))
    assert Counter(map(tuple, decontaminate.contained_items(spark, documents(corpus), items).collect())) == whole
