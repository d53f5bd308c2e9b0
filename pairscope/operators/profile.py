"""Counts and statistics of sample sets and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.functions import vectors as V
from pairscope.operators.selection import ranked_scores
from pairscope.plans import tiled
from pairscope.sources.samples import numbered_in_order
from pairscope.sources.tables import kept


def pair_counts(samples: DataFrame) -> DataFrame:
    sizes = samples.groupBy("identity").agg(F.count("*").alias("c"))
    pos = F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0))
    n = F.coalesce(F.sum("c"), F.lit(0))
    return sizes.agg(n.alias("n_samples"), F.count("*").alias("n_identities"), pos.alias("n_pos"), n.alias("n")).select("n_samples", "n_identities", F.expr("n * (n - 1) div 2").alias("n_pairs"), "n_pos", (F.expr("n * (n - 1) div 2") - F.col("n_pos")).alias("n_neg"))


def norm_stats(samples: DataFrame) -> DataFrame:
    n = V.norm(F.col("v"))
    return samples.select(n.alias("n")).agg(*(F.round(f("n"), 6).alias(f"norm_{k}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))))


def identity_stats(samples: DataFrame) -> DataFrame:
    sizes = samples.groupBy("identity").agg(F.count("*").alias("c"))
    return sizes.agg(F.count("*").alias("n_identities"), F.min("c").alias("size_min"), F.max("c").alias("size_max"), F.round(F.avg("c"), 6).alias("size_mean"), F.round(F.median("c"), 6).alias("size_median"))


def _moments(samples: DataFrame) -> DataFrame:
    return tiled.summaries(samples).groupBy("is_pos").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")), F.min("least").alias("least"), F.max("most").alias("most"))


def score_summary(samples: DataFrame) -> DataFrame:
    """is_pos, n, mean, std, min, max and percentiles (linear between neighbours). Moments are added up inside the tiles;
    percentiles are order statistics, refined from the histogram of the same pass; passes over all pairs read the same blocks."""
    qs = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    layout = tiled.tiles(samples, tiled.large_size(samples))
    both = tiled.measured(samples, moments=True, chosen=layout)
    hist = kept(both.histogram())
    totals = dict(zip((True, False), hist.agg(F.sum("n_pos"), F.sum("n_neg")).first()))
    rows = []
    for side, n in totals.items():
        if n:
            spots = [(int(q * (n - 1)), q * (n - 1) % 1) for q in qs]  # from the least score on
            ranks = {n - k for k, _ in spots} | {max(1, n - k - 1) for k, _ in spots}
            at = ranked_scores(samples, hist, sorted(ranks), "pos" if side else "neg", chosen=None if side else layout)
            rows.append((side, *(round(at[n - k] + (at[max(1, n - k - 1)] - at[n - k]) * part, 6) for k, part in spots)))
    marks = samples.sparkSession.createDataFrame(rows, "is_pos boolean, " + ", ".join(f"p{int(q * 100):02d} double" for q in qs))
    mean = F.col("s") / F.col("n")
    shown = (("mean", mean), ("std", F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))), ("min", F.col("least")), ("max", F.col("most")))
    return both.moments().join(F.broadcast(marks), "is_pos").select("is_pos", "n", *(F.round(c, 6).alias(k) for k, c in shown), *marks.columns[1:])  # two rows


def separation(samples: DataFrame) -> DataFrame:
    mean = F.col("s") / F.col("n")
    m = _moments(samples).agg(F.max(F.when(F.col("is_pos"), mean)).alias("p"), F.max(F.when(~F.col("is_pos"), mean)).alias("n"))
    d = F.col("p") - F.col("n")
    return m.select(F.round(d, 6).alias("separation"), F.when(d > 0.3, "excellent").when(d > 0.2, "good").when(d > 0.1, "fair").otherwise("poor").alias("grade"))


def sampled_pairs(samples: DataFrame, n: int = 1000, seed: int = 7) -> DataFrame:
    """n random pairs with replacement, without pairs of a sample with itself: two draws of positions for each number, by
    md5 (the same in SQL)."""
    total = samples.count()
    spots = numbered_in_order(samples.select("sample_id", "identity", "v"), "sample_id", "at")
    spot = lambda k: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed + k)))), 1, 12), 16, 10).cast("long") % max(1, total)
    draw = lambda s, k: F.struct(F.lit(s).alias("side"), spot(k).alias("at"))
    draws = samples.sparkSession.range(n).select("id", F.explode(F.array(draw("a", 1), draw("b", 2))).alias("draw")).select("id", "draw.*")
    sample = F.struct("sample_id", "identity", "v")
    sides = draws.join(spots, "at").groupBy("id").agg(*(F.max(F.when(F.col("side") == s, sample)).alias(s) for s in "ab"))
    sim = V.clamped(V.dot(F.col("a.v"), F.col("b.v")))
    return sides.where("a.sample_id <> b.sample_id").select("id", F.col("a.sample_id").alias("i"), F.col("b.sample_id").alias("j"), (F.col("a.identity") == F.col("b.identity")).alias("is_pos"), sim.alias("sim"))
