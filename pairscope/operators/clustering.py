"""Groups around a density centre, and absorption of what resembles the main group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions import vectors as V
from pairscope.plans import tiled

THRESHOLD = 0.48


def neighbours(samples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sample_id, n and s: how many samples score at least the threshold with it (itself, too), and the sum of these scores.
    Counted inside the tiles: a tile sends a row a sample, never its pairs."""

    def each(state, a, b, same):
        sim, _ = tiled.scores(a, b, False)
        near = np.where(sim >= threshold, sim, 0.0)
        sides = [(a.ids, (near != 0).sum(1), near.sum(1))]
        if not same:
            sides.append((b.ids, (near != 0).sum(0), near.sum(0)))
        for ids, n, s in sides:
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0]), pa.array(s[n > 0])], names=["sample_id", "n", "s"])

    if threshold <= 0:
        raise ValueError("neighbours need a threshold above 0")
    return tiled.run_tiles(samples, each, "sample_id long, n long, s double").groupBy("sample_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def density_centre(samples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sample_id, cluster (0 or -1), is_centre. The centre has most neighbours, then the greatest sum of their scores, then the least id."""
    first = neighbours(samples, threshold).orderBy(F.col("n").desc(), F.round("s", 6).desc(), "sample_id").limit(1).select(F.col("sample_id").alias("c"))
    centre = samples.join(F.broadcast(first), F.col("sample_id") == F.col("c")).select("c", F.col("v").alias("cv"))  # at most one sample
    near = V.clamped(V.dot(F.col("v"), F.col("cv"))) >= threshold
    return samples.join(F.broadcast(centre), F.lit(True), "left").select("sample_id", F.when(near, 0).otherwise(-1).alias("cluster"), F.coalesce(F.col("sample_id") == F.col("c"), F.lit(False)).alias("is_centre"))


def absorbed(samples: DataFrame, clusters: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sample_id, how (main or matched): the largest cluster and what resembles its mean. clusters: sample_id, cluster (-1: none).

    A single cluster absorbs noise like any other largest one; without clusters nothing is returned.
    """
    sizes = clusters.where("cluster >= 0").groupBy("cluster").count()
    main = F.broadcast(sizes.orderBy(F.col("count").desc(), "cluster").limit(1).select(F.col("cluster").alias("main")))
    rows = samples.join(clusters, "sample_id").crossJoin(main)  # one row
    inside = rows.where(F.col("cluster") == F.col("main"))
    parts = inside.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x"))
    mean = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("m"))
    centroid = F.broadcast(mean.select(V.normalised(F.col("m")).alias("m")))  # one vector
    others = rows.where(F.col("cluster") != F.col("main")).crossJoin(centroid).where(V.dot(F.col("v"), F.col("m")) >= threshold)
    return inside.select("sample_id", F.lit("main").alias("how")).union(others.select("sample_id", F.lit("matched").alias("how")))


def matrix_histogram(samples: DataFrame, bins: int = 50, lo: float = 0.4, hi: float = 1.0) -> DataFrame:
    """Counts of scores within [lo, hi], the right edge included."""

    def each(state, a, b, same):
        sim, want = tiled.scores(a, b, same)
        pos = a.who[:, None] == b.who[None, :]
        inside = (sim >= lo) & (sim <= hi) if want is None else want & (sim >= lo) & (sim <= hi)
        at = np.minimum(bins - 1, np.floor((sim - lo) / ((hi - lo) / bins)).astype(np.int64))
        for side, mask in ((True, pos), (False, ~pos)):
            state[side] = state.get(side, 0) + np.bincount(at[inside & mask], minlength=bins)
        return ()

    def finish(state):
        if state:
            at = np.flatnonzero(state[True] + state[False])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(state[True][at]), pa.array(state[False][at])], names=["bin", "n_pos", "n_neg"])

    found = tiled.run_tiles(samples, each, "bin long, n_pos long, n_neg long", finish=finish)
    return found.groupBy("bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
