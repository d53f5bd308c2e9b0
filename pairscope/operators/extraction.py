"""Extraction of pairs, always in a total order (score, i, j), so a limit is the same whatever the layout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairscope.functions import vectors as V
from pairscope.plans import strategies, tiled

ROUNDING = 1e-12  # more than two sums of one score can differ by


def beyond(samples: DataFrame, side: str, op: str, threshold: float) -> DataFrame:
    return strategies.pairs_beyond(samples, side, op, threshold)


def in_order(pairs: DataFrame, descending: bool) -> DataFrame:
    return pairs.orderBy(F.col("sim").desc() if descending else F.col("sim"), "i", "j")


def best_of(side: str, k: int, highest: bool = True, op: str | None = None, threshold: float | None = None) -> tiled.KEEP:
    """Marks a tile's own k pairs with the greatest (least) scores of a side, ties at the last one included."""
    test = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, None: None}[op]

    def keep(sim, pos):
        want = {"pos": pos, "neg": ~pos, "all": np.ones_like(pos)}[side]
        if test is not None:
            want = want & test(sim, threshold)
        scores = sim[want]
        # a diagonal tile holds each pair twice and each sample with itself: room for them
        room = 2 * k + len(sim) + 1
        if len(scores) > room:
            last = np.partition(scores, len(scores) - room)[len(scores) - room] if highest else np.partition(scores, room - 1)[room - 1]
            want = want & (sim >= last if highest else sim <= last)
        return want

    return keep


def top(samples: DataFrame, side: str, k: int, highest: bool = True, op: str | None = None, threshold: float | None = None) -> DataFrame:
    """The k pairs with the greatest (least) scores of a side."""
    return in_order(tiled.pairs(samples, best_of(side, k, highest, op, threshold), within=side == "pos"), highest).limit(k)


def four_classes(samples: DataFrame, threshold: float) -> DataFrame:
    """pair_type and its exact count."""
    c = lambda a, b: (a, b)

    def each(state, a, b, same):
        sim, want = tiled.scores(a, b, same)
        pos = a.who[:, None] == b.who[None, :]
        want = np.ones_like(pos) if want is None else want
        for name, mask in (("true_accept", pos & (sim > threshold)), ("false_accept", ~pos & (sim > threshold)), ("false_reject", pos & ~(sim > threshold)), ("true_reject", ~pos & ~(sim > threshold))):
            state[name] = state.get(name, 0) + int((mask & want).sum())
        return ()

    def finish(state):
        import pyarrow as pa

        if state:
            yield pa.RecordBatch.from_arrays([pa.array(list(state)), pa.array(list(state.values()), pa.int64())], names=["pair_type", "n"])

    return tiled.run_tiles(samples, each, "pair_type string, n long", finish=finish).groupBy("pair_type").agg(F.sum("n").alias("n"))


def nearest_of(side: str, k: int, above: bool, threshold: float) -> tiled.KEEP:
    """Marks a tile's own k pairs of a side that are nearest to the threshold above (not above) it, ties at the last one included, and
    those that only the rounding of a matrix product could keep apart from them."""

    def keep(sim, pos):
        want = (pos if side == "pos" else ~pos) & (sim > threshold - ROUNDING if above else sim <= threshold + ROUNDING)
        far = np.abs(sim - threshold)
        room = 2 * k + len(sim) + 1  # as in ``best_of``
        some = far[want]
        if len(some) > room:
            want = want & (far <= np.partition(some, room - 1)[room - 1] + ROUNDING)
        return want

    return keep


def class_examples(samples: DataFrame, threshold: float, k: int) -> DataFrame:
    """Of each of the four classes its k pairs nearest to the threshold, by (distance, i, j); one pass over the tiles."""
    sides = {f"{side} {op}": (side, k, op == ">", threshold) for side in ("pos", "neg") for op in (">", "<=")}
    found = tiled.measured(samples, None, keep={name: nearest_of(*how) for name, how in sides.items()}, ordered=True)
    far = F.abs(F.col("sim") - threshold)
    parts = [found.pairs(name).where((F.col("sim") > threshold) == F.lit(how[2])).orderBy(far, "i", "j").limit(k) for name, how in sides.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    place = F.row_number().over(Window.partitionBy("pair_type").orderBy(far, "i", "j"))
    return every.withColumn("pair_type", V.pair_type(F.col("is_pos"), F.col("sim"), threshold)).withColumn("at", place)


def nearest(samples: DataFrame, threshold: float, k: int) -> DataFrame:
    """False accepts just above and false rejects just below the threshold; one pass over the tiles."""
    found = tiled.measured(samples, None, keep={"above": best_of("neg", k, False, ">", threshold), "below": best_of("pos", k, True, "<=", threshold)})
    return in_order(found.pairs("above"), False).limit(k).unionByName(in_order(found.pairs("below"), True).limit(k))


def counts_beyond(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, n_pos, n_neg above it, exact."""
    import pyarrow as pa

    levels = np.array(sorted(thresholds))

    def each(state, a, b, same):
        sim, want = tiled.scores(a, b, same)
        pos = a.who[:, None] == b.who[None, :]
        want = np.ones_like(pos) if want is None else want
        for name, mask in (("pos", pos), ("neg", ~pos)):
            below = np.searchsorted(levels, sim[mask & want], "left")  # levels less than the score
            state[name] = state.get(name, 0) + np.bincount(below, minlength=len(levels) + 1)[::-1].cumsum()[::-1][1:]
        return ()

    def finish(state):
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(levels), pa.array(state["pos"]), pa.array(state["neg"])], names=["threshold", "pos_above", "neg_above"])

    got = tiled.run_tiles(samples, each, "threshold double, pos_above long, neg_above long", finish=finish)
    return got.groupBy("threshold").agg(F.sum("pos_above").alias("pos_above"), F.sum("neg_above").alias("neg_above"))


def with_paths(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Paths of both samples. The pairs are what was extracted, the samples any number: Spark picks the join."""
    out = pairs
    for k in "ij":
        out = out.join(samples.select(F.col("sample_id").alias(k), F.col("path").alias(f"path_{k}")), k)
    return out


def random_low(samples: DataFrame, threshold: float, one_of: int) -> DataFrame:
    """About one of ``one_of`` negatives below the threshold, drawn inside the tiles: the same pairs on every run."""
    return tiled.pairs(samples, lambda sim, pos: ~pos & (sim < threshold), sample=one_of)


def first_beyond(samples: DataFrame, side: str, op: str, threshold: float, limit: int) -> DataFrame:
    """The first ``limit`` pairs beyond the threshold in the order of (i, j)."""
    return beyond(samples, side, op, threshold).orderBy("i", "j").limit(limit)


def sampled_scores(samples: DataFrame, one_of: int = 1000) -> DataFrame:
    """About one of ``one_of`` pairs with their scores, drawn tile by tile."""
    return tiled.pairs(samples, lambda sim, pos: np.ones_like(pos), sample=one_of)
