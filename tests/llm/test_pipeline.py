"""Each stage on what its predecessor kept, and the whole."""

import os

import pytest

import corpus_pipeline
from graphtables.llm import bpe, decontaminate, jaccard_join, language, queries
from tests.llm.conftest import shingles_of, words_of

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    import public_tokenizers as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        seen[name] = spark.read.parquet(str(tmp_path / name))
        docs = seen[name]
    kept = {name: {r.doc_id: r for r in df.collect()} for name, df in seen.items()}
    for r in kept["lines"].values():
        assert r.n_chars == len(r.text)
    lines = [(r.doc_id, k, shingles_of(x)) for r in kept["lines"].values() for k, x in enumerate(r.text.split("\n")) if words_of(x)]
    assert len({s for *_, s in lines}) == len(lines)
    # By brute force: a line stays if no earlier one is a near copy, and a document with a line that stays.
    earlier, wanted = [], {}
    for i, r in sorted(kept["language"].items()):
        stay = []
        for x in r.text.split("\n"):
            s = shingles_of(x)
            if not s or not any(100 * len(s & e) >= 80 * len(s | e) for e in earlier if 0.8 <= len(s) / len(e) <= 1.25):
                stay.append(x)
            if s:
                earlier.append(s)
        if words_of("\n".join(stay)) or not words_of(r.text):
            wanted[i] = "\n".join(stay)
    assert {i: r.text for i, r in kept["lines"].items()} == wanted
    said = language.languages(spark, docs := spark.read.parquet(f"{DATA}/documents.parquet")).filter("score >= 0.5").collect()
    assert set(kept["language"]) == {r.doc_id for r in said if r.lang_pred in corpus_pipeline.LANGUAGES} <= {r.doc_id for r in docs.collect()}
    sets = [shingles_of(r.text) for r in kept["near_duplicates"].values()]
    for i, a in enumerate(sets):
        assert not any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i] if a and b and 0.8 <= len(a) / len(b) <= 1.25)
    marks = jaccard_join.near_duplicates(spark, seen["lines"]).collect()
    assert {r.doc_id for r in marks if not r.n_shingles or r.doc_id == r.component_id} == set(kept["near_duplicates"])
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.contained_items(spark, seen["benchmark"], items).count() == 0
    bad = {r.doc_id for r in decontaminate.contained_items(spark, seen["near_duplicates"], items).collect()}
    assert set(kept["benchmark"]) == set(kept["near_duplicates"]) - bad
    assert sorted(seen["tokens"].collect()) == sorted(bpe.round_trip(seen["benchmark"], P.path("byte_bpe_50k.tiktoken")).collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, seen["tokens"].collect()))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(map(tuple, got.select(wanted.columns).collect())) == sorted(wanted.fetchall())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
