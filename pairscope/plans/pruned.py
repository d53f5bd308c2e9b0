"""Extraction that never joins tiles which cannot hold a wanted pair.

Samples are dealt to the nearest of a bounded number of pivots, so that a block's vectors lie near each other. A block has a centroid
c and a radius r (no vector is farther from c), and for vectors a, b of two blocks |ab - c_a c_b| <= |c_a| r_b + |c_b| r_a + r_a r_b.
The blocks' centroids are tiled as samples are, which leaves the pairs of blocks whose bound reaches the threshold; only those blocks
meet. The result is that of the plain plan: a bound drops no pair. On data without groups nothing is skipped, and the price is the
pass over the centroids, a millionth of the pairs at blocks of 1,024.

For the first k pairs a threshold is found first: the k-th score among the pairs inside single blocks, which the answer reaches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.operators import extraction
from pairscope.plans import tiled
from pairscope.sources.tables import kept

PIVOTS = 256
SLACK = 1e-9  # beyond the rounding of the bound itself


@dataclass(frozen=True)
class Blocks:
    """A table of packed blocks (number, ids, who, v) and one of their centroids, each with its radius behind it."""

    packed: DataFrame
    centroids: DataFrame

    def meeting(self, at: float, highest: bool) -> DataFrame:
        """bi, bj of the pairs of blocks that may hold a score of at least (at most) ``at``."""

        def each(state, a, b, same):
            ca, cb, ra, rb = a.v[:, :-1], b.v[:, :-1], a.v[:, -1], b.v[:, -1]
            room = np.outer(np.linalg.norm(ca, axis=1), rb) + np.outer(ra, np.linalg.norm(cb, axis=1)) + np.outer(ra, rb) + SLACK
            middle = ca @ cb.T
            meet = middle + room >= at if highest else middle - room <= at
            x, y = np.nonzero(np.triu(meet) if same else meet)
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[x]), pa.array(b.ids[y])], names=["bi", "bj"])

        return tiled.run_tiles(self.centroids, each, "bi long, bj long")

    def tiles(self, meeting: DataFrame) -> DataFrame:
        """The blocks with the numbers of those they meet, written once, each file with each other one: no tile is shuffled."""
        met = meeting.groupBy(F.col("bi").alias("number")).agg(F.collect_set("bj").alias("met"))
        left = kept(self.packed.join(met, "number").repartition(tiled.files(self.packed), "number"))
        on = F.array_contains("met", F.col("bj"))
        return tiled.every_two(tiled.side_of(left, "number", "i", "met"), tiled.side_of(self.packed, "number", "j"), on).drop("met")


def _cells(pivots: np.ndarray):
    def emit(batches):
        for batch in batches:
            v = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
            cell = (v @ pivots.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "cell"])

    return emit


def _centroids(batches):
    for batch in batches:
        out = []
        for number, v, ids in zip(batch.column("number").to_pylist(), batch.column("v"), batch.column("ids")):
            x = np.frombuffer(v.as_buffer(), np.float64).reshape(len(ids.as_buffer()) // 8, -1)
            c = x.mean(0)
            out.append((number, 0, [*c.tolist(), float(np.sqrt(((x - c) ** 2).sum(1)).max())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["sample_id", "identity", "v"])


def near_blocks(samples: DataFrame, size: int = tiled.SIZE, pivots: int = PIVOTS) -> Blocks:
    """Blocks of samples that have one nearest pivot. Pivots are samples, by the least hashes of their ids."""
    rows = samples.select("sample_id", "identity", "v")
    some = rows.orderBy(F.xxhash64("sample_id"), "sample_id").limit(pivots).select("v").collect()  # bounded by ``pivots``
    if not some:
        return Blocks(kept(samples.sparkSession.createDataFrame([], "number long, ids binary, who binary, v binary")), rows.where("false"))
    dealt = rows.mapInArrow(_cells(np.array([r["v"] for r in some])), "sample_id long, identity long, v array<double>, cell long")
    packed = tiled.blocks(dealt, size, "cell", tiled.files(samples)).select((F.col("grp") * (1 << 32) + F.col("block")).alias("number"), "ids", "who", "v")
    packed = kept(packed)
    return Blocks(packed, kept(packed.mapInArrow(_centroids, "sample_id long, identity long, v array<double>")))


def _side(sim: np.ndarray, pos: np.ndarray, side: str) -> np.ndarray:
    return {"pos": pos, "neg": ~pos, "all": np.ones_like(pos)}[side]


def beyond(samples: DataFrame, side: str, op: str, threshold: float, near: Blocks | None = None) -> DataFrame:
    """As ``extraction.beyond``."""
    near = near or near_blocks(samples)
    test = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[op]
    chosen = near.tiles(near.meeting(threshold, op[0] == ">"))
    return tiled.pairs(samples, lambda sim, pos: _side(sim, pos, side) & test(sim, threshold), chosen=chosen)


def top(samples: DataFrame, side: str, k: int, highest: bool = True, near: Blocks | None = None) -> DataFrame:
    """As ``extraction.top`` without a threshold."""
    near = near or near_blocks(samples)
    alone = near.packed.select(F.col("number").alias("bi"), F.col("number").alias("bj"))
    first = extraction.in_order(tiled.pairs(samples, extraction.best_of(side, k, highest), chosen=near.tiles(alone)), highest).limit(k).select("sim").collect()  # at most k
    if len(first) < k:
        at, op = (-1.0, ">=") if highest else (1.0, "<=")
    else:
        at, op = first[-1]["sim"], ">=" if highest else "<="
    chosen = near.tiles(near.meeting(at, highest))
    return extraction.in_order(tiled.pairs(samples, extraction.best_of(side, k, highest, op, at), chosen=chosen), highest).limit(k)


def skipped(near: Blocks, threshold: float, highest: bool = True) -> DataFrame:
    """tiles, met, share of tiles that are never joined at a threshold."""
    n = near.packed.count()
    return near.meeting(threshold, highest).agg(F.lit(n * (n + 1) // 2).alias("tiles"), F.count("*").alias("met")).withColumn("share_skipped", 1 - F.try_divide("met", "tiles"))
