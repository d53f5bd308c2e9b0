"""Pair plans by name; each gives the same rows.

``hof``: a self-join on i < j with the dot product as a column, for small sets (every pair is evaluated in the JVM).
``tiled``: blocks and matrix products, for large sets. ``joined``: the same from a join of blocks on bi <= bj, ``banded``: from cells
of bands, in which blocks wait for others. ``group``: pairs of one identity only, tiled inside identities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions import vectors as V
from pairscope.plans import tiled


def hof_pairs(samples: DataFrame) -> DataFrame:
    a, b = (samples.select(F.col("sample_id").alias(k), F.col("identity").alias(f"id_{k}"), F.col("v").alias(f"v_{k}")) for k in "ij")
    sim = V.clamped(V.dot(F.col("v_i"), F.col("v_j")))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", "id_i", "id_j", (F.col("id_i") == F.col("id_j")).alias("is_pos"), sim.alias("sim"))


def hof_histogram(samples: DataFrame, bins: int = V.BINS, policy: str = "floor", **_) -> DataFrame:
    b = hof_pairs(samples).select(V.bin_of(F.col("sim"), bins, policy).alias("bin"), F.col("is_pos").cast("long").alias("p"))
    return b.groupBy("bin").agg(F.sum("p").alias("n_pos"), F.sum(1 - F.col("p")).alias("n_neg"))


def group_histogram(samples: DataFrame, bins: int = V.BINS, policy: str = "floor", **how) -> DataFrame:
    return tiled.histogram(samples, bins, policy=policy, within=True, **how)


def joined_histogram(samples: DataFrame, bins: int = V.BINS, policy: str = "floor", size: int = tiled.SIZE) -> DataFrame:
    return tiled.histogram(samples, bins, size, policy, chosen=tiled.tiles(samples, size))


def banded_histogram(samples: DataFrame, bins: int = V.BINS, policy: str = "floor", size: int = tiled.SIZE) -> DataFrame:
    return tiled.histogram(samples, bins, size, policy, chosen=tiled.cells(samples, size))


HISTOGRAMS = {"hof": hof_histogram, "tiled": tiled.histogram, "joined": joined_histogram, "banded": banded_histogram, "group": group_histogram}


def pair_histogram(samples: DataFrame, strategy: str = "tiled", **how) -> DataFrame:
    return HISTOGRAMS[strategy](samples, **how)


def positive_pairs(samples: DataFrame) -> DataFrame:
    return tiled.pairs(samples, lambda sim, pos: pos, within=True)


def pairs_beyond(samples: DataFrame, side: str, op: str, threshold: float) -> DataFrame:
    """side: pos, neg or all; positives alone never meet other identities."""
    test = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[op]
    if side == "pos":
        return tiled.pairs(samples, lambda sim, pos: pos & test(sim, threshold), within=True)
    return tiled.pairs(samples, lambda sim, pos: test(sim, threshold) & (~pos if side == "neg" else True))
