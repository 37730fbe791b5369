"""What workers and batches hold: all workers of an executor share its memory, and live on from stage to stage."""

import os

import numpy as np
import psutil
import pyarrow as pa
import pytest

import corpus_pipeline
from fleetops.llm import lang_id, packing, runtime
from tests.llm.helpers import documents


def held_mb() -> float:
    return psutil.Process(os.getpid()).memory_info().rss / 1e6


def test_a_task_gives_back_what_it_held(spark, monkeypatch):
    docs = documents(spark, ["a"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    pins = []

    def run(batches):
        for batch in batches:
            held = [np.ones(8000) for _ in range(6000)]  # below the size that is mapped apart
            pins.extend(held[::1000])  # between the others, so that the heap cannot shrink from its end
            yield batch

    task = runtime.in_arrow(docs, run, docs.schema)
    before = held_mb()
    assert len(list(task(iter([pa.RecordBatch.from_pydict({"text": ["a"]})])))) == 1
    assert pins and held_mb() - before < 150


@pytest.mark.parametrize(
    "plan", [lambda d: lang_id.predict(d, lang_id.Model([], np.zeros((0, 1)), np.zeros((lang_id.BUCKETS, 1)), np.ones(1))), packing.pieces]
)
def test_operators_give_back(spark, monkeypatch, plan):
    docs = documents(spark, ["a b", "c"]).select("doc_id", "text")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    calls = []
    monkeypatch.setattr(runtime, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b", "c"]})
    assert sum(b.num_rows for b in plan(docs)(iter([batch]))) == 2
    assert calls == [1]


@pytest.mark.parametrize("stage", ["language", "near copies", "passages", "packing"])
def test_stages_take_batches_of_few_rows(spark, testdata, stage):
    session = spark.newSession()
    docs = documents(session, ["one two three"] * 3)
    dict(corpus_pipeline.STAGES)[stage](session, docs, testdata)
    size = session.range(0, 2500, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r["n"] for r in size.collect()) <= 1000


def test_smaller_batches_of_a_session_stay(spark):
    session = spark.newSession()
    session.conf.set(runtime.BATCH_ROWS, "64")
    runtime.small_batches(session)
    assert session.conf.get(runtime.BATCH_ROWS) == "64"
    session.conf.set(runtime.BATCH_ROWS, "0")  # no bound
    runtime.small_batches(session)
    assert session.conf.get(runtime.BATCH_ROWS) == str(runtime.ROWS)
