"""Histograms of scores: bin, n_pos, n_neg; at most as many rows as bins, and added by addition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairscope.functions import vectors as V
from pairscope.plans import tiled

# windows over whole histograms: their rows are bounded by the number of bins


def _down():
    return Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)


def _up():
    return Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def _all():
    return Window.partitionBy()


def added(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def rebinned(hist: DataFrame, factor: int, bins: int = V.BINS) -> DataFrame:
    if bins % factor:
        raise ValueError(f"{bins} bins do not divide by {factor}")
    return hist.groupBy(F.floor(F.col("bin") / factor).cast("long").alias("bin")).agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def negatives_by_subtraction(full: DataFrame, positive: DataFrame) -> DataFrame:
    """full: bin, n; positive: bin, n_pos; a negative remainder is an error, never clipped."""
    left = F.col("n") - F.coalesce("n_pos", F.lit(0))
    checked = F.when(left >= 0, left).otherwise(F.raise_error(F.lit("more positives than pairs in a bin")).cast("long"))
    return full.join(positive, "bin", "left").select("bin", F.coalesce("n_pos", F.lit(0)).cast("long").alias("n_pos"), checked.alias("n_neg"))


def cumulated(hist: DataFrame) -> DataFrame:
    """With s_pos, s_neg (counts at this bin or above) and the totals tp, tn."""
    return hist.select("bin", "n_pos", "n_neg", *(F.sum(f"n_{s}").over(_down()).alias(f"s_{s}") for s in ("pos", "neg")), F.sum("n_pos").over(_all()).alias("tp"), F.sum("n_neg").over(_all()).alias("tn"))


def density(hist: DataFrame, bins: int = V.BINS) -> DataFrame:
    width = 2.0 / bins
    rate = lambda s: F.try_divide(F.col(f"n_{s}"), F.sum(f"n_{s}").over(_all())) / width
    return hist.select("bin", F.round(V.centre(F.col("bin"), bins), 6).alias("centre"), F.round(rate("pos"), 6).alias("density_pos"), F.round(rate("neg"), 6).alias("density_neg"))


def means(hist: DataFrame, bins: int = V.BINS) -> DataFrame:
    mean = lambda s: F.round(F.try_divide(F.sum(V.centre(F.col("bin"), bins) * F.col(f"n_{s}")), F.sum(f"n_{s}")), 6).alias(f"mean_{s}")
    return hist.agg(mean("pos"), mean("neg"))


def quantiles(hist: DataFrame, qs: list[float], bins: int = V.BINS) -> DataFrame:
    """Left edges of the first bins that reach q of each side."""
    spark = hist.sparkSession
    up = hist.select("bin", F.sum("n_pos").over(_up()).alias("u_pos"), F.sum("n_neg").over(_up()).alias("u_neg"), F.sum("n_pos").over(_all()).alias("tp"), F.sum("n_neg").over(_all()).alias("tn"))
    q = F.broadcast(spark.createDataFrame([(x,) for x in qs], "q double"))
    first = lambda s, t: F.round(V.edge(F.min(F.when(F.col(f"u_{s}") >= F.col("q") * F.col(t), F.col("bin"))), bins), 6)
    return up.crossJoin(q).groupBy("q").agg(first("pos", "tp").alias("pos"), first("neg", "tn").alias("neg"))


def tails(hist: DataFrame, neg_from: int, pos_below: int) -> DataFrame:
    return hist.agg(F.sum(F.when(F.col("bin") >= neg_from, F.col("n_neg")).otherwise(0)).alias("neg_high"), F.sum(F.when(F.col("bin") < pos_below, F.col("n_pos")).otherwise(0)).alias("pos_low"))


def above(hist: DataFrame, thresholds: list[float], bins: int = V.BINS) -> DataFrame:
    """Counts above thresholds; the bin that a threshold divides counts in proportion."""
    t = F.broadcast(hist.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (V.edge(F.col("bin") + 1, bins) - F.col("threshold")) * (bins / 2)))
    return hist.crossJoin(t).groupBy("threshold").agg(*(F.round(F.sum(F.col(f"n_{s}") * part), 4).alias(f"{s}_above") for s in ("pos", "neg")))


def two_level(samples: DataFrame, coarse: int = 4096, fine: int = 65536, lo: float = 0.2) -> DataFrame:
    """grid, bin, n_pos, n_neg: coarse over [-1, 1] and fine over [lo, 1], both counted inside the tiles."""

    def each(state, a, b, same):
        sim, want = tiled.scores(a, b, same)
        pos = a.who[:, None] == b.who[None, :]
        want = np.ones_like(pos) if want is None else want
        high = sim >= lo
        grids = {
            "coarse": (tiled.binned(sim, coarse, "floor"), want, coarse),
            "fine": (np.minimum(fine - 1, np.floor((sim - lo) / ((1 - lo) / fine)).astype(np.int64)), want & high, fine),
        }
        for name, (at, mask, bins) in grids.items():
            for side, own in ((True, pos), (False, ~pos)):
                state[name, side] = state.get((name, side), 0) + np.bincount(at[mask & own], minlength=bins)
        return ()

    def finish(state):
        for name in ("coarse", "fine") if state else ():
            at = np.flatnonzero(state[name, True] + state[name, False])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), *(pa.array(state[name, side][at]) for side in (True, False))], names=["grid", "bin", "n_pos", "n_neg"])

    found = tiled.run_tiles(samples, each, "grid string, bin long, n_pos long, n_neg long", finish=finish)
    return found.groupBy("grid", "bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def curve(hist: DataFrame, bins: int = V.BINS) -> DataFrame:
    """Rates at the left edge of every bin that has pairs."""
    c = cumulated(hist)
    return c.select("bin", F.round(V.edge(F.col("bin"), bins), 6).alias("threshold"), F.round(F.try_divide("s_neg", "tn"), 9).alias("fpir"), F.round(F.try_divide("s_pos", "tp"), 9).alias("tpir"))


def displayed(hist: DataFrame, columns: int = 2000, bins: int = V.BINS) -> DataFrame:
    return rebinned(hist, bins // columns, bins)


def sampled_curve(hist: DataFrame, step: int = 1000, bins: int = V.BINS) -> DataFrame:
    return curve(hist, bins).where(F.col("bin") % step == 0)


def as_rate(count: Column, total: Column) -> Column:
    """NULL where there is nothing to divide by."""
    return F.try_divide(count, total)
