"""Single precision with a bound gives what double gives."""

import numpy as np
import pytest

from pairscope.operators import extraction
from pairscope.plans import certified, pruned, tiled

SCHEMA = "sample_id long, identity long, v array<double>, path string"


@pytest.mark.parametrize("dim", [2, 64, 512])
def test_the_bound_holds(dim):
    rng = np.random.default_rng(dim)
    for scale in (1.0, 1e3, 1e-3):
        x = scale * rng.standard_normal((200, dim)) * 10.0 ** rng.integers(-4, 1, (200, dim))
        b = tiled.Block(np.arange(200), np.zeros(200, np.int64), x)
        rough, reach = certified.single(b, b)
        assert np.abs(rough.astype(np.float64) - x @ x.T).max() <= reach
        assert reach < 1e-4 * (x * x).sum(1).max()


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((160, 16))
    x[100:120] = x[0]  # copies, whose score is the last edge
    x[120] = -x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(k, int(k % 9), v.tolist(), "p") for k, v in enumerate(x)], SCHEMA).repartition(3).persist()


@pytest.mark.parametrize("bins", [20, 2000])
def test_histogram(samples, bins):
    one, two = ({r["bin"]: (r["n_pos"], r["n_neg"]) for r in f(samples, bins, 50).collect()} for f in (certified.histogram, tiled.histogram))
    assert one == two


@pytest.mark.parametrize("side, op, t", [("all", ">", 0.4), ("neg", "<=", -0.3), ("pos", ">=", 0.2), ("pos", "<", 0.0)])
def test_pairs(samples, side, op, t):
    listed = lambda d: sorted((r["i"], r["j"], r["id_i"], r["id_j"], r["is_pos"], round(r["sim"], 9)) for r in d.collect())
    want = listed(extraction.beyond(samples, side, op, t))
    assert listed(certified.beyond(samples, side, op, t, 50)) == want and want
    near = pruned.near_blocks(samples, 30)
    assert listed(certified.beyond(samples, side, op, t, chosen=near.tiles(near.meeting(t, op[0] == ">")))) == want
