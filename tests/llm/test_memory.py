"""What Python workers, which live on after a task, still hold."""

import os
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from graphtables.llm import bpe, language
from graphtables.llm.common import map_batches


def held_mb(pid):
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


def test_worker_gives_memory_back(spark):
    """Arrays that a task has freed below a small object that stays do not stay with the idle worker."""

    def make(batch):
        before = held_mb(os.getpid())
        np.ones(30 << 17)  # 30 MB, freed at once: malloc takes smaller blocks from its heap from now on
        big = [np.ones(1 << 17) for _ in range(300)]
        np.kept = np.ones(1 << 13)  # stays with the worker, above them
        del big
        return pa.record_batch([pa.array([os.getpid()], pa.int64()), pa.array([before]), pa.array([held_mb(os.getpid())])], ["pid", "before", "after"])

    rows = spark.createDataFrame([("a",)], "text string").coalesce(1)
    [r] = map_batches(rows, make, "pid long, before double, after double").collect()
    assert r.after > r.before + 250  # else the test shows nothing
    for _ in range(50):
        if held_mb(r.pid) < r.before + 60:
            break
        time.sleep(0.1)
    assert held_mb(r.pid) < r.before + 60


@pytest.mark.parametrize("module", [bpe, language])
def test_small_pieces(spark, monkeypatch, module):
    """Texts are taken apart at most half a MiB at a time, whatever a batch holds."""
    taken = []

    def spy(df, make, schema, column="text", most=4 << 20):
        taken.append(most)
        return map_batches(df, make, schema, column, most)

    monkeypatch.setattr(module, "map_batches", spy)
    docs = spark.createDataFrame([(k, "the quick brown fox " * 30, "en") for k in range(8)], "doc_id long, text string, lang string")
    if module is bpe:
        import public_tokenizers

        assert len({r.ids_sha256 for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}) == 1
    else:
        assert {r.lang_pred for r in language.languages(spark, docs).collect()} == {"en"}
    assert taken and max(taken) <= 1 << 19
