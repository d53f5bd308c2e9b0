"""Checks of histograms, metrics and pair sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions import vectors as V
from pairscope.operators.profile import pair_counts
from pairscope.plans import tiled


def conserved(hist: DataFrame, samples: DataFrame, bins: int = V.BINS, rel: float = 0.0, absolute: int = 0) -> DataFrame:
    """One row: sums against theory. ok allows the tolerance (none by default), strict_ok never does."""
    sums = hist.agg(*(F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"got_{s}") for s in ("pos", "neg")), F.count_if((F.col("n_pos") < 0) | (F.col("n_neg") < 0) | ~F.col("bin").between(0, bins - 1)).alias("bad_bins"))
    both = sums.crossJoin(F.broadcast(pair_counts(samples).select("n_pos", "n_neg")))  # one row each
    dp, dn = F.col("got_pos") - F.col("n_pos"), F.col("got_neg") - F.col("n_neg")
    near = lambda d, n: F.abs(d) <= F.greatest(F.lit(float(absolute)), F.col(n) * rel)
    return both.select("got_pos", "got_neg", "n_pos", "n_neg", dp.alias("delta_pos"), dn.alias("delta_neg"), "bad_bins", ((dp == 0) & (dn == 0) & (F.col("bad_bins") == 0)).alias("strict_ok"), (near(dp, "n_pos") & near(dn, "n_neg") & (F.col("bad_bins") == 0)).alias("ok"))


def histogram_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """L1 distance of both sides and the number of bins that differ."""
    both = a.alias("a").join(b.alias("b"), "bin", "full_outer")
    gap = lambda s: F.abs(F.coalesce(F.col(f"a.n_{s}"), F.lit(0)) - F.coalesce(F.col(f"b.n_{s}"), F.lit(0)))
    zero = F.lit(0)
    return both.agg(F.coalesce(F.sum(gap("pos")), zero).alias("l1_pos"), F.coalesce(F.sum(gap("neg")), zero).alias("l1_neg"), F.count_if(gap("pos") + gap("neg") > 0).alias("bins_differ"))


def metric_difference(reference: DataFrame, candidate: DataFrame, most_bins: int = 10, most_tpir: float = 1e-3, bins: int = V.BINS) -> DataFrame:
    a, b = (d.select("fpir_target", F.col("threshold").alias(f"t_{k}"), F.col("tpir").alias(f"p_{k}")) for d, k in ((reference, "a"), (candidate, "b")))
    off = F.round(F.abs(F.col("t_a") - F.col("t_b")) * (bins / 2)).cast("long")
    gap = F.abs(F.col("p_a") - F.col("p_b"))
    return a.join(b, "fpir_target").select("fpir_target", off.alias("bins_off"), F.round(gap, 9).alias("tpir_gap"), ((off <= most_bins) & (gap < most_tpir)).alias("ok"))


def pair_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs in both, in one only, and the greatest difference of scores in both."""
    both = a.select("i", "j", F.col("sim").alias("s_a")).join(b.select("i", "j", F.col("sim").alias("s_b")), ["i", "j"], "full_outer")
    return both.agg(
        F.count_if(F.col("s_a").isNotNull() & F.col("s_b").isNotNull()).alias("in_both"),
        F.count_if(F.col("s_b").isNull()).alias("only_a"),
        F.count_if(F.col("s_a").isNull()).alias("only_b"),
        F.round(F.max(F.abs(F.col("s_a") - F.col("s_b"))), 6).alias("score_gap"),
    )


def beyond_difference(samples: DataFrame, every: float, positive: float, size: int = tiled.SIZE) -> DataFrame:
    """``pair_set_difference`` of the pairs that score above ``every`` and the same-identity pairs above ``positive``, each set with
    scores of its own: products of whole blocks, and products of the samples of one identity. Both are made of the same two blocks and
    compared there, so no pair leaves a task."""

    def each(state, a, b, same):
        sim, want = tiled.scores(a, b, same)
        one = sim > every if want is None else (sim > every) & want
        state["only_a"] = state.get("only_a", 0) + int(np.count_nonzero(one))
        for who in np.intersect1d(a.who, b.who):
            x, y = np.flatnonzero(a.who == who), np.flatnonzero(b.who == who)
            own, at = tiled.scores(a.part(x), b.part(y), False)[0], np.ix_(x, y)
            two = own > positive if want is None else (own > positive) & want[at]
            both = two & one[at]
            n = int(np.count_nonzero(both))
            state["in_both"] = state.get("in_both", 0) + n
            state["only_a"] -= n
            state["only_b"] = state.get("only_b", 0) + int(np.count_nonzero(two)) - n
            if n:
                state["gap"] = max(state.get("gap", 0.0), float(np.abs(own - sim[at])[both].max()))
        return ()

    def finish(state):
        if state:
            counts = [pa.array([state.get(c, 0)], pa.int64()) for c in ("in_both", "only_a", "only_b")]
            yield pa.RecordBatch.from_arrays([*counts, pa.array([state.get("gap")], pa.float64())], names=["in_both", "only_a", "only_b", "gap"])

    found = tiled.run_tiles(samples, each, "in_both long, only_a long, only_b long, gap double", size, finish=finish)
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("in_both", "only_a", "only_b")), F.round(F.max("gap"), 6).alias("score_gap"))


def expected_range(metrics: DataFrame, expected: dict[float, float], slack: float = 0.05) -> DataFrame:
    rows = F.broadcast(metrics.sparkSession.createDataFrame(list(expected.items()), "fpir_target double, expected double"))
    return metrics.join(rows, "fpir_target").select("fpir_target", "tpir", "expected", (F.abs(F.col("tpir") - F.col("expected")) <= slack).alias("in_range"))
