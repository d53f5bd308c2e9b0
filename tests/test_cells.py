from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pairscope.plans import tiled


def frame(spark, n, groups, first=0, dim=3):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(first + k, int(rng.integers(groups)), rng.uniform(-1, 1, dim).tolist()) for k in range(n)], "sample_id long, identity long, v array<double>")


def meeting():
    def met(state, a, b, same):
        """The pairs of ids of a tile."""
        wanted = np.ones((len(a.ids), len(b.ids)), bool)
        x, y = np.nonzero(np.triu(wanted, 1) if same else wanted)
        one, two = a.ids[x], b.ids[y]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["i", "j"])

    return met


def listed(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("partitions, held", [(1, 64 << 20), (8, 64 << 20), (1, 200), (8, 1)])
def test_every_pair_meets_once(spark, monkeypatch, partitions, held):
    """For any number of bands: few partitions and room for all, or bands of a single block."""
    monkeypatch.setattr(tiled, "HELD", held)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        s = frame(spark, 60, 4)
        pairs = [(i, j) for i in range(60) for j in range(i + 1, 60)]
        run = lambda **k: tiled.run_tiles(s, meeting(), "i long, j long", size=7, **k)
        assert listed(run()) == pairs
        who = dict(listed(s.select("sample_id", "identity")))
        assert listed(run(within=True)) == [(i, j) for i, j in pairs if who[i] == who[j]]
        other = frame(spark, 25, 4, first=100)
        assert listed(run(chosen=tiled.cross_cells(s, other, 7))) == [(i, j) for i in range(60) for j in range(100, 125)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_copies_follow_the_bands_and_not_the_blocks(spark, monkeypatch):
    s = frame(spark, 400, 4)
    blocks = tiled.blocks(s, 4).count()
    bands = 8  # ceil(sqrt(8 * 8 partitions))
    rows = tiled.cells(s, 4)
    assert rows.count() == blocks * bands < blocks * (blocks + 1) // 2
    assert rows.select("x", "y").distinct().count() == bands * (bands + 1) // 2
    monkeypatch.setattr(tiled, "HELD", 24 * 4 * 3)  # three blocks of 4 vectors of 24 bytes
    tight = tiled.cells(s, 4)
    waiting = tight.where(tiled.F.col("role") != tiled.MEET).groupBy("x", "y").count()
    assert waiting.agg({"count": "max"}).first()[0] <= 3


def test_no_rows(spark):
    s, none = frame(spark, 5, 2), frame(spark, 5, 2).where("false")
    assert tiled.histogram(none).count() == 0
    assert tiled.histogram(s, chosen=tiled.cross_cells(s, none)).count() == 0 == tiled.histogram(s, chosen=tiled.cross_cells(none, s)).count()
    assert tiled.histogram(s.limit(1)).count() == 0
