import random
import re

import pytest

LONG = 200_000
#: Columns beside those of documents, with names that the operators use inside.
CLASH = "node int, h string, n int, token string, tokens string, uid string, key string, place int, `a b` string, comp int"
SYLLABLES = "ba de fi go ku la me ni po ru sa te vi wo xu ya ze".split()


def make_words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def words_of(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))


def shingles_of(text, width=5):
    w = words_of(text)
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs, with the other columns of the table and some that clash."""

    def make(rows, langs=None):
        whole = [(i, t, langs[k] if langs else "en", "s", len(t) if t is not None else None, *[None] * 10) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(whole, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared lines and the awkward cases: (id, text) rows."""
    rng = random.Random(5)
    rows, k = [], 0
    line = " ".join(make_words(rng, 12))
    for family in range(12):
        lines = [make_words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))]
        for copy in range(rng.randint(1, 6)):
            changed = [list(x) for x in lines]
            for _ in range(copy if family % 3 else 0):
                x = rng.choice(changed)
                x[rng.randrange(len(x))] = rng.choice(SYLLABLES) + "q"
            text = "\n".join(" ".join(x) for x in changed)
            rows.append((k, text + ("\n" + line if family % 2 else "")))
            k += 1
    long = " ".join(make_words(rng, LONG // 5))
    rows += [(k, long), (k + 1, long + " end"), (k + 2, ""), (k + 3, None), (k + 4, " \n\t \r\n"), (k + 5, "one two"), (k + 6, "One  TWO"), (k + 7, "one two three"), (None, "a line of no id at all here"), (None, None)]
    rows += [rows[0], rows[0], (rows[1][0], "another text under an id that there is already")]
    return rows
