"""Tiles that cannot hold a wanted pair are not joined, and the pairs are those of the plain plan."""

import numpy as np
import pytest

from pairscope.operators import extraction
from pairscope.plans import pruned, tiled

SCHEMA = "sample_id long, identity long, v array<double>, path string"


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    mid = rng.standard_normal((12, 8))
    x = np.repeat(mid / np.linalg.norm(mid, axis=1, keepdims=True), 25, 0) + 0.05 * rng.standard_normal((300, 8))
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.repeat([np.eye(8)[0]], 20, 0)])  # and copies
    who = np.concatenate([np.repeat(np.arange(12), 25) // 2, np.full(20, 99)])
    return spark.createDataFrame([(k, int(w), v.tolist(), "p") for k, (v, w) in enumerate(zip(x, who))], SCHEMA).repartition(3).persist()


def listed(pairs):
    return sorted((r["i"], r["j"], r["is_pos"], round(r["sim"], 9)) for r in pairs.collect())


def test_pairs_and_share_of_skipped_tiles(spark, samples, monkeypatch):
    near = pruned.near_blocks(samples, size=10, pivots=24)
    row = pruned.skipped(near, 0.9).first()
    assert row["share_skipped"] > 0.5
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(tiled, "COUNTED", counted)
    got = pruned.beyond(samples, "all", ">", 0.9, near)
    assert listed(got) == listed(extraction.beyond(samples, "all", ">", 0.9))
    assert counted.value <= row["met"] + 2  # the tiles that may hold a pair, one of centroids, one of the plain plan
    for side, op, t in (("neg", ">=", 0.5), ("pos", "<", 0.3), ("neg", "<=", -0.8)):
        assert listed(pruned.beyond(samples, side, op, t, near)) == listed(extraction.beyond(samples, side, op, t))


@pytest.mark.parametrize("side, k, highest", [("neg", 15, True), ("pos", 15, False), ("all", 5000, True)])
def test_first_pairs(samples, side, k, highest):
    near = pruned.near_blocks(samples, size=10, pivots=24)
    one, two = ([(r["i"], r["j"]) for r in f.collect()] for f in (pruned.top(samples, side, k, highest, near), extraction.top(samples, side, k, highest)))
    # of scores that differ in their last bits only the order may differ
    assert len(one) == len(two) and len(set(one) ^ set(two)) <= 2


def test_nothing(samples):
    none = samples.where("false")
    assert pruned.beyond(none, "all", ">", 0.1).count() == pruned.top(none, "neg", 3).count() == 0
