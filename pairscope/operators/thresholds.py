"""True positive rate at false positive rates, by each named convention.

With S(k) the negatives in bins >= k of n, and f the wanted rate, the conventions differ in the bin and in what counts:

canonical   least k with S(k) <= max(1, ceil(f n)); positives in bins above k (strict), false accepts in bins >= k
plain       least k with S(k) / n <= f, none: NULL; positives in bins >= k
strict      least k with S(k) / n < f; exact positives above the edge
floor       least k (up to the end of the grid) with S(k) <= floor(f n); positives in bins >= k
rank        greatest k with S(k) >= f n; exact positives above the edge
rank_bins   the same k; positives in bins >= k
centre      greatest k with S(k) >= ceil(f n); threshold is the bin's centre; positives in bins >= k
inside      the bin of rank, divided in proportion; positives divided likewise
canonical_exact   the canonical threshold; exact positives above it
nearest     least k with S(k) <= f n on a grid of rounded scores; positives in bins >= k

and by order statistics of the negatives: see ``ORDER``. No negatives or no positives: NULL.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairscope.functions import vectors as V
from pairscope.operators.histograms import cumulated
from pairscope.operators.selection import counted_scores, listed_scores, ranked_scores
from pairscope.plans import tiled
from pairscope.sources.tables import kept, released

FPIRS = (1e-5, 1e-4, 1e-3, 1e-2)


def rates(spark, fpirs) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(f,) for f in V.checked_fpirs(fpirs)], "fpir_target double"))


def _above_last(test: Column, none: int, cap: int) -> Column:
    """One more than the last bin where the test still fails the wanted rate."""
    return F.least(F.lit(cap), F.coalesce(F.max(F.when(test, F.col("bin"))) + 1, F.lit(none)))


def bins_for(hist: DataFrame, fpirs, convention: str, bins: int = V.BINS) -> DataFrame:
    """fpir_target, k, tn, tp."""
    c = cumulated(hist).crossJoin(rates(hist.sparkSession, fpirs))
    s, f, n = F.col("s_neg"), F.col("fpir_target"), F.col("tn")
    k = {
        "canonical": _above_last(s > F.greatest(F.lit(1), F.ceil(f * n).cast("long")), 0, bins - 1),
        "plain": _above_last(F.try_divide(s, n) > f, 0, bins),
        "strict": _above_last(F.try_divide(s, n) >= f, 0, bins - 1),
        "floor": _above_last(s > F.floor(f * n).cast("long"), 0, bins),
        "nearest": _above_last(s > f * n, 0, bins),
        "rank": F.max(F.when(s >= f * n, F.col("bin"))),
        "centre": F.max(F.when(s >= F.ceil(f * n).cast("long"), F.col("bin"))),
    }[{"canonical_exact": "canonical", "rank_bins": "rank"}.get(convention, convention)]
    out = c.groupBy("fpir_target").agg(F.when(F.max("tn") > 0, k).alias("k"), F.max("tn").alias("tn"), F.max("tp").alias("tp"))
    if convention == "plain":
        return out.withColumn("k", F.when(F.col("k") < bins, F.col("k")))
    return out


def tpir(hist: DataFrame, convention: str = "canonical", fpirs=FPIRS, bins: int = V.BINS, samples: DataFrame | None = None) -> DataFrame:
    """fpir_target, k, threshold, false_accepts, fpir, pos_above, tpir. Exact conventions count positives of the ``samples``."""
    hist = kept(hist)  # at most as many rows as bins; made once
    if convention == "inside":
        return _inside(hist, fpirs, bins)
    found = F.broadcast(bins_for(hist, fpirs, convention, bins))  # a row for each wanted rate
    at = F.round(V.centre(F.col("k"), bins) if convention == "centre" else V.edge(F.col("k"), bins), 6).alias("threshold")
    strict = convention == "canonical"
    counted = hist.crossJoin(found).groupBy("fpir_target", "k", "tn", "tp").agg(
        F.sum(F.when(F.col("bin") >= F.col("k"), F.col("n_neg")).otherwise(0)).alias("false_accepts"),
        F.sum(F.when((F.col("bin") > F.col("k")) if strict else (F.col("bin") >= F.col("k")), F.col("n_pos")).otherwise(0)).alias("pos_above"),
    )
    if convention in ("strict", "rank", "canonical_exact"):
        levels = {r["fpir_target"]: r["t"] for r in found.where("k is not null").select("fpir_target", F.round(V.edge(F.col("k"), bins), 6).alias("t")).collect()}  # a row a rate
        counts = tiled.above(samples, list(levels.values())) if levels else {}
        exact = hist.sparkSession.createDataFrame([(f, counts[t]) for f, t in levels.items()], "fpir_target double, pos_above long")
        counted = counted.drop("pos_above").join(F.broadcast(exact), "fpir_target", "left").withColumn("pos_above", F.coalesce("pos_above", F.lit(0)))
    return counted.select("fpir_target", "k", at, "false_accepts", F.round(F.try_divide("false_accepts", "tn"), 9).alias("fpir"), "pos_above", F.round(F.try_divide("pos_above", "tp"), 9).alias("tpir"))


def _inside(hist: DataFrame, fpirs, bins: int) -> DataFrame:
    c = cumulated(hist).crossJoin(rates(hist.sparkSession, fpirs))
    want = F.col("fpir_target") * F.col("tn")
    one = c.where(F.col("s_neg") >= want).groupBy("fpir_target").agg(F.max_by(F.struct("bin", "n_pos", "n_neg", "s_pos", "s_neg", "tp", "tn"), "bin").alias("b")).select("fpir_target", "b.*")
    part = F.try_divide(F.col("fpir_target") * F.col("tn") - (F.col("s_neg") - F.col("n_neg")), F.col("n_neg"))
    return one.withColumn("part", part).select(
        "fpir_target",
        F.col("bin").alias("k"),
        F.round(V.edge(F.col("bin"), bins) + (1 - F.col("part")) * (2.0 / bins), 9).alias("threshold"),
        F.round(F.try_divide(F.col("s_pos") - F.col("n_pos") + F.col("part") * F.col("n_pos"), F.col("tp")), 9).alias("tpir"),
    )


# order statistics: rank (1 = greatest) among the negatives for a rate f, and how positives are compared with it
ORDER = {
    "order_ceil": (lambda f, n: n - max(0, min(n - 1, -int(-(1 - f) * n // 1) - 1)), ">"),
    "order_floor": (lambda f, n: max(1, int(f * n)), ">"),
    "order_round": (lambda f, n: max(1, round(f * n)), ">"),
    "order_next": (lambda f, n: min(n, int(f * n) + 1), ">="),
}


def tpir_ends(samples: DataFrame, hist: DataFrame, fpirs=(0.0, 0.01, 0.1, 1.0)) -> DataFrame:
    """``order_ceil`` with both ends: at 0 the greatest negative, at 1 what lies just below the least one."""
    hist = kept(hist)
    totals = hist.agg(F.sum("n_pos"), F.sum("n_neg")).first()
    rows = [(f, ORDER["order_ceil"][0](f, totals[1])) for f in V.checked_fpirs(fpirs, closed=True)]
    scores = ranked_scores(samples, hist, [r for _, r in rows])
    return _compared(samples, [(f, float(np.nextafter(scores[r], -np.inf)) if f == 1 else scores[r]) for f, r in rows], ">", totals[0])


def tpir_linear(hist: DataFrame, fpirs=FPIRS, bins: int = V.BINS) -> DataFrame:
    """fpir_target, threshold, tpir by the linear distribution function: the threshold is its inverse at 1 - f for negatives,
    kept inside the grid, and positives above it are counted in proportion. At f = 0 it is the grid's end."""
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a histogram's rows, bounded by its bins
    whole = Window.partitionBy()
    c = hist.select("bin", "n_pos", "n_neg", *(F.coalesce(F.sum(f"n_{s}").over(up), F.lit(0)).alias(f"u_{s}") for s in ("pos", "neg")), F.sum("n_pos").over(whole).alias("tp"), F.sum("n_neg").over(whole).alias("tn"))
    wanted = F.broadcast(hist.sparkSession.createDataFrame([(f,) for f in V.checked_fpirs(fpirs, closed=True)], "fpir_target double"))
    y = (1 - F.col("fpir_target")) * F.col("tn")
    spot = c.where("n_neg > 0").crossJoin(wanted).where((F.col("u_neg") <= y) & (y < F.col("u_neg") + F.col("n_neg")))
    part = (y - F.col("u_neg")) / F.col("n_neg")
    found = spot.select("fpir_target", (V.edge(F.col("bin"), bins) + part * (2.0 / bins)).alias("t"), F.try_divide(F.col("tp") - F.col("u_pos") - part * F.col("n_pos"), F.col("tp")).alias("r"))
    ends = F.when(F.col("fpir_target") == 0, F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("r")))
    return wanted.join(found, "fpir_target", "left").select("fpir_target", F.round(F.coalesce("t", ends["t"]), 9).alias("threshold"), F.round(F.coalesce("r", ends["r"]), 9).alias("tpir"))


def tpir_bisected(samples: DataFrame, hist: DataFrame, fpirs=FPIRS, bins: int = V.BINS, rounds: int = 60) -> DataFrame:
    """The threshold is found by halving [-1, 1] until the negatives above it, bins divided in proportion, are f of all;
    positives above it are counted exactly."""
    hist = kept(hist)
    rows = np.array([tuple(r) for r in hist.select("bin", "n_neg").orderBy("bin").collect()] or [(0, 0)])  # at most as many rows as bins
    at, below = rows[:, 0], np.concatenate([[0], np.cumsum(rows[:, 1])])
    found = []
    for f in V.checked_fpirs(fpirs):
        lo, hi = -1.0, 1.0
        for _ in range(rounds):
            t = (lo + hi) / 2
            place = (t + 1) * bins / 2
            k = int(np.searchsorted(at, int(place)))
            above = below[-1] - below[k] - (rows[k, 1] * (place - int(place)) if k < len(at) and at[k] == int(place) else 0)
            lo, hi = (t, hi) if above > f * below[-1] else (lo, t)
        found.append((f, (lo + hi) / 2))
    return _compared(samples, found, ">", hist.agg(F.sum("n_pos")).first()[0])


def tpir_bisected_exact(samples: DataFrame, fpirs=(1e-2,), within: float = 1e-6, bins: int = V.BINS) -> DataFrame:
    """Halving [-1, 1] by exact counts. The histogram tells all halvings but those at places in the bin that holds the wanted count
    (or beside it); a second pass counts above all such places of all rates at once."""
    from pairscope.operators import extraction

    fpirs = V.checked_fpirs(fpirs)
    hist = kept(tiled.histogram(samples, bins))
    rows = np.array([tuple(r) for r in hist.select("bin", "n_neg").orderBy("bin").collect()] or [(0, 0)])  # at most as many rows as bins
    at_least = rows[:, 1][::-1].cumsum()[::-1]  # negatives in this bin or above
    n, n_pos = int(at_least[0]), hist.agg(F.sum("n_pos")).first()[0]
    depth = 0
    while 2 / 2**depth > within:
        depth += 1
    step = 2 / 2**depth
    spans = {}
    for f in fpirs:
        above = np.flatnonzero(at_least > f * n)
        k = int(rows[above[-1], 0]) if len(above) else 0
        spans[f] = ((k - 1) * 2 / bins - 1, (k + 2) * 2 / bins - 1)
    places = sorted({-1 + m * step for lo, hi in spans.values() for m in range(max(0, math.floor((lo + 1) / step)), min(2**depth, math.ceil((hi + 1) / step)) + 1)})
    counts = {r["threshold"]: r["neg_above"] for r in extraction.counts_beyond(samples, places).collect()}  # a row a place
    found = []
    for f in fpirs:
        lo, hi = -1.0, 1.0
        while hi - lo > within:
            t = (lo + hi) / 2
            more = counts[t] > f * n if t in counts else t < spans[f][0]
            lo, hi = (t, hi) if more else (lo, t)
        found.append((f, hi))
    return _compared(samples, found, ">", n_pos)


def exact_curve(samples: DataFrame, points: int = 4096, bins: int = V.BINS) -> DataFrame:
    """threshold, fpir, tpir (shares of scores greater than it) at ``points`` places in equal steps among all different scores.

    Every different score is counted, so all of them meet once, packed and in rounds (``selection.counted_scores``); what comes back is
    a row a bin. A last pass over the tiles lists the bins that hold a place; all passes read the same blocks in the same parts, so a
    score has the same bits in each.
    """
    spark, layout = samples.sparkSession, tiled.tiles(samples, tiled.large_size(samples))
    with released(spark):
        hist = kept(tiled.histogram(samples, bins, chosen=layout))  # at most as many rows as bins
    pairs = hist.agg(F.coalesce(F.sum(F.col("n_pos") + F.col("n_neg")), F.lit(0))).first()[0]
    found = kept(counted_scores(layout, hist, pairs, bins).join(hist, "bin").select("bin", "c", F.col("n_pos").alias("cp"), F.col("n_neg").alias("cn")))
    before, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # a row a bin
    bases = found.select("bin", "c", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("c", "cp", "cn")), *(F.sum(c).over(whole).alias(f"t{c}") for c in ("c", "cp", "cn")))
    # place k of P is at floor(k (U - 1) / (P - 1)) of U scores; with fewer scores than places all are shown
    steps = F.broadcast(spark.range(points).select(F.col("id").alias("k")))
    at = F.floor(F.col("k") * (F.col("tc") - 1) / max(1, points - 1)).cast("long")
    held = bases.crossJoin(steps).withColumn("at", at).where((F.col("at") >= F.col("bc")) & (F.col("at") < F.col("bc") + F.col("c")))
    places = held.select("bin", (F.col("at") - F.col("bc")).alias("inside"), "bcp", "bcn", "tcp", "tcn").distinct().collect()  # a row a place
    inside = {b: np.array(sorted(r["inside"] for r in places if r["bin"] == b)) for b in {r["bin"] for r in places}}

    def picked(at, sim, p, n):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        for u, v in zip(first, [*first[1:], len(at)]):
            k = np.minimum(inside[int(at[u])], v - u - 1)
            columns = (at[u + k], inside[int(at[u])], sim[u + k], np.cumsum(p[u:v])[k], np.cumsum(n[u:v])[k])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bin", "inside", "sim", "up", "un"])

    rows = spark.createDataFrame(places, "bin long, inside long, bcp long, bcn long, tcp long, tcn long")
    own = "bin long, inside long, sim double, up long, un long"
    shown = listed_scores(layout, hist, picked, own, list(inside), bins) if places else spark.createDataFrame([], own)
    rate = lambda u, t: F.round(F.try_divide(F.col(f"tc{t}") - F.col(f"bc{t}") - F.col(u), F.col(f"tc{t}")), 9)
    return shown.join(F.broadcast(rows), ["bin", "inside"]).select(F.round("sim", 6).alias("threshold"), rate("un", "n").alias("fpir"), rate("up", "p").alias("tpir"))


def tpir_sampled(samples: DataFrame, one_of: int = 100, fpirs=FPIRS, bins: int = V.BINS) -> DataFrame:
    """``floor`` on a sample of the pairs (``tiled.drawn``): quick to see, and biased where f times the sample is small."""
    s = tiled.pairs(samples, lambda sim, pos: np.ones_like(pos), sample=one_of)
    b = s.select(V.bin_of(F.col("sim"), bins).alias("bin"), F.col("is_pos").cast("long").alias("p"))
    return tpir(b.groupBy("bin").agg(F.sum("p").alias("n_pos"), F.sum(1 - F.col("p")).alias("n_neg")), "floor", fpirs, bins)


def tpir_by_order(samples: DataFrame, hist: DataFrame, convention: str, fpirs=FPIRS) -> DataFrame:
    """fpir_target, threshold, pos_above, tpir by an order statistic of the negatives."""
    rank, op = ORDER[convention]
    hist = kept(hist)  # at most as many rows as bins, asked several times
    totals = hist.agg(F.sum("n_pos"), F.sum("n_neg")).first()
    rows = [(f, rank(f, totals[1])) for f in V.checked_fpirs(fpirs)]
    scores = ranked_scores(samples, hist, [r for _, r in rows])
    return _compared(samples, [(f, scores[r]) for f, r in rows], op, totals[0])


def _compared(samples: DataFrame, rows: list, op: str, n_pos: int) -> DataFrame:
    """The positives beyond each row's threshold are counted inside the tiles."""
    counts = tiled.above(samples, [t for _, t in rows], op == ">=")
    out = [(f, round(t, 6), counts[t], round(counts[t] / n_pos, 9) if n_pos else None) for f, t in rows]
    return samples.sparkSession.createDataFrame(out, "fpir_target double, threshold double, pos_above long, tpir double")


def tpir_by_percentile(samples: DataFrame, hist: DataFrame, fpirs=FPIRS) -> DataFrame:
    """The threshold is the linear percentile 1 - f of the negatives: between two order statistics."""
    hist = kept(hist)
    totals = hist.agg(F.sum("n_pos"), F.sum("n_neg")).first()
    n, rows, ranks = totals[1], [], set()
    for f in V.checked_fpirs(fpirs):
        spot = (1 - f) * (n - 1)
        low = int(spot)
        rows.append((f, n - low, max(1, n - low - 1), spot - low))
        ranks |= {n - low, max(1, n - low - 1)}
    s = ranked_scores(samples, hist, sorted(ranks))
    return _compared(samples, [(f, s[a] + (s[b] - s[a]) * part) for f, a, b, part in rows], ">", totals[0])


def threshold_at_tpir(samples: DataFrame, hist: DataFrame, tpirs) -> DataFrame:
    """Of m positives in order, that at index round((1 - p) m), halves to even, kept inside 1 .. m - 1."""
    hist = kept(hist)
    m = hist.agg(F.sum("n_pos")).first()[0]
    rows = [(p, m - min(max(round((1 - p) * m), 1), m - 1)) for p in tpirs]
    s = ranked_scores(samples, hist, [r for _, r in rows], "pos")
    return samples.sparkSession.createDataFrame([(p, round(s[r], 6)) for p, r in rows], "tpir_target double, threshold double")


def log_grid(hist: DataFrame, lo: float = 1e-6, hi: float = 1.0, points: int = 100, bins: int = V.BINS) -> DataFrame:
    """The plain curve at rates in equal steps of their logarithm, by number of the step."""
    step = math.log10(hi / lo) / (points - 1)
    grid = F.broadcast(hist.sparkSession.range(points).select("id", F.pow(F.lit(10.0), math.log10(lo) + F.col("id") * step).alias("f")))
    c = cumulated(hist).crossJoin(grid)
    k = c.groupBy("id").agg(_above_last(F.col("s_neg") > F.floor(F.col("f") * F.col("tn") + 1e-6).cast("long"), 0, bins).alias("k"))
    return hist.crossJoin(F.broadcast(k)).groupBy("id", "k").agg(F.sum(F.when(F.col("bin") >= F.col("k"), F.col("n_pos")).otherwise(0)).alias("pos_above"))
