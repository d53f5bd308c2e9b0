"""Stored histograms equal the full recomputation, whatever the steps, retries and restarts."""

import numpy as np
import pytest

from pairscope.operators import growing
from pairscope.plans import tiled

SCHEMA = "sample_id long, identity long, v array<double>, path string"


def planted(n=90, dim=8):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(k, int(rng.integers(0, 7)), x[k].tolist(), f"p{k}") for k in range(n)]


def collected(hist):
    return {r["bin"]: (r["n_pos"], r["n_neg"]) for r in hist.collect()}


def test_versions_equal_the_whole(spark, tmp_path, monkeypatch):
    rows = planted()
    whole = collected(tiled.histogram(spark.createDataFrame(rows, SCHEMA)))
    store = growing.Store(spark, str(tmp_path / "s"), size=20)
    parts = [rows[:40], rows[40:70], [], rows[70:]]
    for v, part in enumerate(parts):
        store.add(spark.createDataFrame(part, SCHEMA), v)
    assert collected(store.histogram()) == whole and store.versions() == [0, 1, 2, 3]
    row = growing.conserved(store).first()
    assert row["counted"] == row["pairs"] == 90 * 89 // 2
    # the last version again, as after a failure: only new pairs are scored, and nothing is added twice
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(tiled, "COUNTED", counted)
    store.add(spark.createDataFrame(parts[3], SCHEMA), 3)
    assert counted.value == 1 + 1 * 4 and collected(store.histogram()) == whole
    with pytest.raises(ValueError, match="versions after"):
        store.add(spark.createDataFrame(rows[:1], SCHEMA), 2)
    with pytest.raises(ValueError, match="already"):
        store.add(spark.createDataFrame(rows[:1], SCHEMA), 4)
    assert collected(store.histogram()) == whole  # a version without its end counts nothing
    assert collected(store.compact(str(tmp_path / "t")).histogram()) == whole


def test_stream_equals_the_batch_after_a_restart(spark, tmp_path):
    rows = planted()
    gallery = spark.createDataFrame(rows[:50], SCHEMA)
    for k, part in enumerate((rows[50:60], rows[60:75], rows[75:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 1:
            store = growing.Store(spark, str(tmp_path / "s"))
            source = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            store.follow(source(), gallery, str(tmp_path / "c"), availableNow=True).awaitTermination()
    store.follow(source(), gallery, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert len(store.versions()) == 3
    # a batch that is repeated replaces itself
    store.add_probes(spark.createDataFrame(rows[75:], SCHEMA), gallery, 2)
    probes = spark.createDataFrame(rows[50:], SCHEMA)
    want = collected(tiled.histogram(probes, chosen=tiled.cross_cells(probes, gallery)))
    x, who = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    assert sum(a + b for a, b in want.values()) == 50 * 40 and sum(a for a, _ in want.values()) == int((who[:50, None] == who[50:]).sum())
    assert collected(store.histogram()) == want


def test_an_empty_store(spark, tmp_path):
    store = growing.Store(spark, str(tmp_path / "none"))
    assert store.versions() == [] and store.histogram().count() == 0 and store.samples().count() == 0
