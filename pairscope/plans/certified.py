"""Tiles in single precision with a proved bound; only scores near an edge or a threshold are made again in double.

For vectors of d numbers, rounded to single precision (unit roundoff u = 2^-24) and multiplied in any order of summation, the error
is at most (d + 3) u / (1 - (d + 3) u) times the product of the norms: d u for the sums, and 3 u for both roundings of the inputs
and their product. A score farther from every edge than that is on the edge's right side; the others are summed again in double.

With 512 numbers the bound is 3e-5, so it serves grids of bins wider than that (2,000 bins: 6 of 100 scores are made again, with 64
numbers 1 of 100) and thresholds; the grid of 200,000 bins is finer than single precision can tell, and stays with ``tiled``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.plans import tiled

UNIT = 2.0**-24


def single(a: tiled.Block, b: tiled.Block) -> tuple[np.ndarray, float]:
    """Scores in single precision, and how far they can be from those of the vectors."""
    n = (a.v.shape[1] + 3) * UNIT
    norms = (np.sqrt((x.v * x.v).sum(1).max(initial=0.0)) for x in (a, b))
    reach = n / (1 - n) * float(np.prod(list(norms))) * (1 + 1e-6)
    return a.v.astype(np.float32) @ b.v.astype(np.float32).T, reach


def again(a: tiled.Block, b: tiled.Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The scores of some pairs of a tile in double, clamped."""
    return np.concatenate([np.clip(np.einsum("ij,ij->i", a.v[x[k : k + 65536]], b.v[y[k : k + 65536]]), -1.0, 1.0) for k in range(0, len(x), 65536)] or [np.zeros(0)])


def histogram(samples: DataFrame, bins: int = 2000, size: int = tiled.SIZE) -> DataFrame:
    """bin, n_pos, n_neg as ``tiled.histogram`` with its floor policy."""

    def each(state, a, b, same):
        rough, reach = single(a, b)
        want = np.triu(np.ones(rough.shape, bool), 1) if same else np.ones(rough.shape, bool)
        pos = a.who[:, None] == b.who[None, :]
        place = (np.clip(rough, -1, 1).astype(np.float64) + 1) * (bins / 2)
        at = np.minimum(bins - 1, np.floor(place).astype(np.int64))
        near = np.abs(place - np.rint(place)) <= reach * (bins / 2) + 1e-9
        x, y = np.nonzero(near & want)
        at[x, y] = tiled.binned(again(a, b, x, y), bins, "floor")
        for side, mask in (("pos", pos), ("neg", ~pos)):
            state[side] = state.get(side, 0) + np.bincount(at[mask & want], minlength=bins)
        return ()

    def finish(state):
        if state:
            at = np.flatnonzero(state["pos"] + state["neg"])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(state["pos"][at]), pa.array(state["neg"][at])], names=["bin", "n_pos", "n_neg"])

    found = tiled.run_tiles(samples, each, "bin long, n_pos long, n_neg long", size, finish=finish)
    return found.groupBy("bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def beyond(samples: DataFrame, side: str, op: str, threshold: float, size: int = tiled.SIZE, chosen: DataFrame | None = None) -> DataFrame:
    """As ``extraction.beyond``: what may pass is scored again in double, and that decides."""
    test = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[op]

    def each(state, a, b, same):
        rough, reach = single(a, b)
        pos = a.who[:, None] == b.who[None, :]
        may = rough >= threshold - reach - 1e-9 if op[0] == ">" else rough <= threshold + reach + 1e-9
        may &= {"pos": pos, "neg": ~pos, "all": True}[side]
        x, y = np.nonzero(np.triu(may, 1) if same else may)
        sim = again(a, b, x, y)
        good = test(sim, threshold)
        x, y, sim = x[good], y[good], sim[good]
        if len(x):
            turn = a.ids[x] > b.ids[y]
            one, two = np.where(turn, b.ids[y], a.ids[x]), np.where(turn, a.ids[x], b.ids[y])
            who1, who2 = np.where(turn, b.who[y], a.who[x]), np.where(turn, a.who[x], b.who[y])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (one, two, who1, who2, pos[x, y], sim)], names=["i", "j", "id_i", "id_j", "is_pos", "sim"])

    return tiled.run_tiles(samples, each, tiled.PAIR, size, side == "pos" and chosen is None, chosen=chosen)
