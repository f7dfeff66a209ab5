import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphtables.llm import language, quality, url_filter
from graphtables.llm.common import most_frequent

HEADS = {"es": "que de la los con", "fr": "le de les dans avec", "en": "the of and with that", "de": "der und die nicht mit"}
LETTERS = {"es": "aeosrnñí", "fr": "eéèauxt", "en": "ethoanws", "de": "enrschüä"}


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def made_texts(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(HEADS))
        words = [rng.choice(HEADS[lang].split()) if rng.random() < 0.4 else "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(8, 60))]
        bad = rng.random() < 0.3
        if bad:
            words = [w + rng.choice(["&&&", "###", "!!"]) for w in words] if rng.random() < 0.5 else [w for w in words[:8] for _ in range(9)]
        rows.append((i, " ".join(words).capitalize() + ".", lang, int(not bad)))
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \n"), (1003, "123 ... !!"), (None, "the of and with that"), (1004, "x" * 200_000), (1005, "日本語 の"), (7, "the of and")]


def frame(documents, rows):
    whole = [(i, t) for i, t, *_ in rows] + ODD
    return documents(whole, [x[2] for x in rows] + [None] * len(ODD)), whole


def test_languages(spark, documents):
    rows = made_texts()
    df, whole = frame(documents, rows)
    got = language.languages(spark, df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in whole)
    truth = {i: lang for i, _, lang, _ in rows}
    by_id = {r.doc_id: r for r in got if r.doc_id != 7}
    test = [i for i in truth if held_out(i) and i != 7]
    assert np.mean([by_id[i].lang_pred == truth[i] for i in test]) > 0.97
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0) for i in (1000, 1001, 1002, 1003))
    assert all(by_id[i].lang_pred in HEADS for i in (None, 1004, 1005))
    kept = language.known_language(spark, df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in whole if i not in (1000, 1001, 1002, 1003))
    again = language.languages(spark, df.repartition(7)).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in got} == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in again}


def test_languages_without_any(spark, documents):
    df = documents([(1, "the of"), (2, None)], [None, None])
    assert {(r.lang_pred, r.score) for r in language.languages(spark, df).collect()} == {("und", 0.0)}
    assert language.known_language(spark, df).count() == 0
    assert language.languages(spark, documents([])).count() == 0


def test_language_decides(spark, documents):
    """What goes is what the prediction says, and it alone."""
    df, _ = frame(documents, made_texts(4, 300))
    said = {(r.doc_id, r.lang_pred) for r in language.languages(spark, df).filter("score >= 0.5").collect()}
    learned = {x for _, x in said} - {"und"}
    assert len(learned) > 1
    for keep in [None, *({x} for x in sorted(learned))]:
        kept = language.known_language(spark, df, keep, 0.5)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, x in said if x in (learned if keep is None else keep)}
    assert language.known_language(spark, df, least=1.1).count() == 0


def test_many_languages(spark, documents):
    """A model learns from the most frequent ones, however many there are."""
    rows = [(k, f"wort satz text {k % 7}") for k in range(5300)]
    df = documents(rows, [f"x{k}" if k < 5000 else "de" if k % 2 else "en" for k in range(5300)])
    model = language.train(df)
    assert len(model.languages) == language.LANGUAGES and {"de", "en"} <= set(model.languages)
    assert language.train(df, most=2).languages == ["de", "en"]


def test_word_sums_are_sums_of_grams():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << language.BITS, 3)).astype(np.float32)
    words = ["der", "ä", "straße", "der"]
    sums = language.WordSums(weights).of(words)
    for w, s in zip(words, sums):
        _, feature = language.grams([w])
        assert np.allclose(s[:-1], weights[feature].sum(0), atol=1e-4) and s[-1] == len(feature)
    assert len(language.grams(["ab"])[1]) == 2 + 3 + 2 + 1  # a b, " a" "ab" "b ", " ab" "ab ", " ab "


def test_quality(spark, documents):
    rows = made_texts(2, 600)
    df, whole = frame(documents, rows)
    marks = [(i, q, 0) for i, _, _, q in rows if i % 3] + [(None, 1, 0), (5, None, 0), (8, 7, 0), (8, rows[8][3], 0), (8, rows[8][3], 0), (99999, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.quality(spark, df, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in whole)
    truth = {i: q for i, _, _, q in rows}
    by_id = {r.doc_id: r for r in got if r.doc_id != 7}
    test = [i for i in truth if held_out(i) and i != 7]
    assert np.mean([by_id[i].predicted == truth[i] for i in test]) > 0.95
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert by_id[1000].score == by_id[1001].score == by_id[1002].score
    again = quality.quality(spark, df.repartition(5), labels.repartition(2)).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in got} == {(r.doc_id, round(r.score, 9)) for r in again}
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.quality(spark, df, none).collect()} == {0.5}
    assert quality.quality(spark, documents([]), labels).count() == 0


def test_quality_sample_is_bounded(spark, documents):
    """Labelled texts that find no room are not learned from, and are scored all the same."""
    rows = made_texts(6, 200)
    long = [(9000 + k, "word " * 20000) for k in range(4)]
    df = documents([(i, t) for i, t, *_ in rows] + long)
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(i, 1) for i, _ in long], "doc_id long, quality int")
    texts = df.selectExpr("doc_id", "cast(text as binary) AS text")
    bounded, _ = quality.train(texts, labels, "quality", sample_bytes=100_000)
    without, _ = quality.train(texts.filter("doc_id < 9000"), labels, "quality", sample_bytes=100_000)
    assert (bounded == without).all() and (bounded != 0).any()
    assert quality.quality(spark, df, labels).count() == len(rows) + 4


def test_ftrl_finds_the_weights():
    rng = np.random.default_rng(1)
    model = quality.Ftrl(4)
    for _ in range(3000):
        at = rng.choice(16, 3, replace=False)
        model.learn(at, np.ones(3), int(3 in at))
    w = model.weights()
    assert w.argmax() == 3 and w[3] > 2 and np.abs(np.delete(w, 3)).max() < 1.5


URLS = [
    ("http://a.EXAMPLE.net/en/x?q=/fr/", "a.example.net", "/en/x", "example.net/en/"),
    ("https://example.net/de/", "example.net", "/de/", "net/"),
    ("https://example.net/en", "example.net", "/en", "net/"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None),
    ("http://m.example.com/de/1#x", "m.example.com", "/de/1", "example.com/de/"),
    ("ftp://x.org/fr/a", "x.org", "/fr/a", "org/fr/"),
    ("http://x.org/en/a", "x.org", "/en/a", None),
    ("http://x.net", "x.net", "", None),
    ("http://x.net?a=/b", "x.net", "", None),
    ("http://x.net#/b", "x.net", "", None),
    ("//x.net/a", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("http://ÄB.net/a://b", "Äb.net", "/a://b", "net/"),
    ("://net/", "net", "/", "net/"),
    ("http://x.net:80/a", "x.net:80", "/a", None),
    ("http:///a", "", "/a", None),
    ("http://casinobonus.example.com/play", "casinobonus.example.com", "/play", None),
]


def test_urls(spark):
    html = "<div class='bonus'>free bonus garden flower house <b>play</b></div>"
    rows = [(k, u, html if k % 5 else None, 3) for k, (u, *_) in enumerate(URLS)] + [(None, "http://garden-flowerhouse.org/x", html, 1)] * 2
    rows += [(200 + k, f"http://best{w}bonus.com/play/{k}", html, 1) for k, w in enumerate(["casino", "poker", "slots"] * 20)] + [(300 + k, f"http://gardenhouse{k}.com/flower/{k}", html, 1) for k in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(spark, df).collect()}
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    for k, (u, host, path, rule) in enumerate(URLS):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdicts[rule] if rule else r.verdict in ("allow", "block")
    assert got[17].words == ["casino", "bonus", "example", "com"] and got[17].verdict == "block"
    assert got[None].words == ["garden", "flower", "house", "org"] and got[None].verdict == "allow"
    assert got[200].verdict == "block" and got[300].verdict == "allow" and got[9].rule is None
    assert url_filter.judge(spark, df.limit(0)).count() == 0


def test_url_models_are_whole(spark):
    """Words and tokens beyond those that are broadcast count alike: no result depends on how many are."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(3, 7))) for _ in range(120)]
    rows = []
    for k in range(300):
        a, b, c = (names[min(int(rng.expovariate(0.04)), 119)] for _ in range(3))
        rows.append((k, f"http://{a}{b}{rng.choice(['', '', 'casino'])}.info/{c}{a}/{k}", f"<p>{a} {b}</p> {c} " + names[k % 120]))
    df = spark.createDataFrame([*rows, (None, None, None), (7, "http://ÄB.org/straße", "")], "page_id long, url string, html string").repartition(3)

    def judged(**most):
        return sorted(((r.page_id or -1, r.host, r.path, r.rule, r.verdict, round(r.score, 9), r.words) for r in url_filter.judge(spark, df, **most).collect()), key=str)

    whole = judged()
    assert len(whole) == 302 and {x[4] for x in whole} == {"allow", "block"}
    for most in (0, 40):
        assert judged(most=most) == whole


def test_segmenter_is_the_best_path():
    counts = {"a": 5, "ab": 3, "b": 2, "aba": 4, "ba": 1}
    s = url_filter.Segmenter(counts)

    def price(words):
        return sum(s.logs.get(w, s.unknown - 2.3 * len(w)) for w in words)

    def splits(x):
        return [[]] if not x else [[x[:k], *rest] for k in range(1, len(x) + 1) for rest in splits(x[k:])]

    for run in ("abab", "ababa", "xab", "bbb", "aabbaaxb"):
        assert price(s.split(run)) == pytest.approx(max(map(price, splits(run))))


def test_most_frequent(spark):
    df = spark.createDataFrame([(f"w{k}", k % 50 + 1) for k in range(500)], "word string, n long")
    for most in (0, 9, 10, 100, 499, 500, 1000):
        got = most_frequent(df, "n", most).collect()
        assert len(got) <= most
        rest = {r.n for r in df.collect()} - {r.n for r in got}
        assert not got or not rest or min(r.n for r in got) > max(rest)
    assert most_frequent(df, "n", 500).count() == 500
