"""The embedding queue: failures, a restart and a change of version end as a batch would."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.streaming import embedder as E

DIM = {"v1": 2, "v2": 3}


def encoder(version, failing):
    """Length and version of a text; a text in the folder of failures fails until the file is taken away."""
    import os

    def encode(batches):
        for pdf in batches:
            bad = os.path.exists(failing)
            rows = [None if bad and ("fail" in t) else [float(len(t))] * DIM[version] for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "embedding": rows})

    return encode


def wait(query, ready, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise AssertionError(query.exception())
        if ready():
            return
        time.sleep(0.5)
    raise AssertionError("not in time")


@pytest.fixture
def rows(spark):
    data = [(i, f"title {i}", f"text {'fail ' if i % 4 == 0 else ''}{'x' * i}") for i in range(20)] + [(20, None, None)]
    return spark.createDataFrame(data, "id long, title string, content_text string")


def test_queue_equals_batch(spark, rows, tmp_path):
    queue, out, state, failing = (str(tmp_path / n) for n in ("queue", "out", "state", "failing"))
    open(failing, "w").close()
    E.enqueue(rows.where("id < 12"), queue, "v1")
    E.enqueue(rows.where("id < 3"), queue, "v1")  # announced twice
    run = lambda version: E.embed_queue(spark, queue, out, state, encoder(version, failing), delay=1.0, every="500 milliseconds")
    done = lambda version: {r["id"]: list(r["embedding"]) for r in E.embedded(spark, out).where(F.col("embedding_version") == version).collect()}
    some = lambda: any(p.name.startswith("batch") for p in (tmp_path / "out").rglob("batch=*"))
    query = run("v1")
    wait(query, lambda: some() and len(done("v1")) == 9)
    wait(query, lambda: len(list((tmp_path / "queue").glob("retry-*"))) >= 2)  # several attempts fail
    query.stop()
    assert set(done("v1")) == {i for i in range(12) if i % 4}
    E.enqueue(rows.where("id >= 12"), queue, "v1")
    query = run("v1")  # a restart: what waited still waits
    (tmp_path / "failing").unlink()
    wait(query, lambda: len(done("v1")) == 21)
    query.stop()
    length = lambda n: {r["id"]: [float(len(f"{r['title'] or ''} {r['content_text'] or ''}"))] * n for r in rows.collect()}
    assert done("v1") == length(2)
    tried = spark.read.schema(E.EMBEDDED).parquet(f"{out}/run=0/*").collect()
    assert sorted(r["id"] for r in tried) == list(range(21)), "each article is encoded once"
    assert max(r["attempt"] for r in tried) >= 2 and {r["attempt"] for r in tried if r["id"] % 4 and r["id"] < 12} == {0}

    assert E.stale(rows, E.embedded(spark, out), "v1").count() == 0
    E.sweep(rows, E.embedded(spark, out), queue, "v2")  # another version: all are stale
    query = run("v2")
    wait(query, lambda: len(done("v2")) == 21)
    query.stop()
    assert done("v2") == length(3) and done("v1") == {}
