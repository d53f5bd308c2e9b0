"""Order statistics of all pairs' scores, exact and without a list of pairs.

A rank's bin in the histogram is an interval of scores. Doubles in their order are whole numbers in their order, so an interval is
divided into up to ``PARTS`` equal ranges of such numbers, a pass over the tiles counts the pairs in each, and the range that holds
the rank is the next interval; all wanted ranks are refined by the same pass. An interval with few pairs is listed instead: its
different scores with their counts, counted inside the tiles. So ties cost nothing (a score that a third of all pairs have is one
count), no task sees a bin's pairs, and what leaves a task is bounded by the ranges. There are at most four refinements, as a double
has 64 bits; on scores without large ties it is one, and the list.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairscope.functions import vectors as V
from pairscope.operators.histograms import cumulated
from pairscope.plans import tiled
from pairscope.sources.tables import fresh, released

PARTS = 1 << 16
FEW = 50_000
_SIGN = np.int64((1 << 63) - 1)


def ordinals(sim: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores; both zeros are one."""
    k = (np.asarray(sim, np.float64) + 0.0).view(np.int64)
    return k ^ ((k >> 63) & _SIGN)


def scores_of(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return (k ^ ((k >> 63) & _SIGN)).view(np.float64)


def first_ordinals(ks, bins: int) -> np.ndarray:
    """The first ordinals of bins, by the rule that fills them (of ``bins`` itself: the one after the last)."""
    ks = np.asarray(ks, np.int64)
    lo, hi = np.full(ks.shape, ordinals(-1.0)), np.full(ks.shape, ordinals(1.0) + 1)
    while (lo < hi).any():
        mid = lo + (hi - lo) // 2
        there = tiled.binned(scores_of(mid), bins, "floor") >= ks
        lo, hi = np.where(there | (lo == hi), lo, mid + 1), np.where(there, mid, hi)
    return lo


def bin_interval(k: int, bins: int) -> tuple[int, int]:
    """The first and last ordinal of a bin."""
    first, after = first_ordinals([k, k + 1], bins).tolist()
    return first, after - 1


GRID = 1 << 18


def _inside(a, b, same, side: str, los: np.ndarray, his: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals of a tile's pairs that lie in one of the intervals, and in which. Only pairs in bins of a coarse grid that the intervals
    touch (``near``) are looked at."""
    keys = [np.zeros(0, np.int64)]
    for p, q, same in tiled.parts_of(a, b, same):
        sim, want = tiled.scores(p, q, same)
        hit = near[tiled.binned(sim, GRID, "floor")]
        at = np.flatnonzero(hit if want is None else hit & want)
        x, y = np.divmod(at, len(q.ids))
        keys.append(ordinals(sim.ravel()[at[(p.who[x] == q.who[y]) == (side == "pos")]]))
    key = np.concatenate(keys)
    at = np.searchsorted(los, key, "right") - 1
    good = (at >= 0) & (key <= his[at])
    return key[good], at[good]


def _touched(los: np.ndarray, his: np.ndarray) -> np.ndarray:
    near = np.zeros(GRID, bool)
    for u, v in zip(*(tiled.binned(scores_of(k), GRID, "floor") for k in (los, his))):
        near[u : v + 1] = True
    return near


def _counts(samples: DataFrame, side: str, intervals: list[tuple[int, int]], shifts: list[int], chosen: DataFrame | None = None) -> DataFrame:
    """k (interval), sub (range), n."""
    los, his = (np.array(c, np.int64) for c in zip(*intervals))
    by, near = np.array(shifts, np.int64), _touched(los, his)

    def each(state, a, b, same):
        key, at = _inside(a, b, same, side, los, his, near)
        for k in np.unique(at):
            state[k] = state.get(k, 0) + np.bincount((key[at == k] - los[k]) >> by[k], minlength=PARTS)
        return ()

    def finish(state):
        for k, n in state.items():
            sub = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sub), k)), pa.array(sub), pa.array(n[sub])], names=["k", "sub", "n"])

    return tiled.run_tiles(samples, each, "k long, sub long, n long", within=side == "pos", finish=finish, chosen=chosen)


def _listed(samples: DataFrame, side: str, intervals: list[tuple[int, int]], chosen: DataFrame | None = None) -> DataFrame:
    """k (interval), sub (ordinal of a score), n: the different scores of intervals with few pairs."""
    los, his = (np.array(c, np.int64) for c in zip(*intervals))
    near = _touched(los, his)

    def each(state, a, b, same):
        key, at = _inside(a, b, same, side, los, his, near)
        if len(key):
            key, where, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at[where]), pa.array(key), pa.array(n)], names=["k", "sub", "n"])

    return tiled.run_tiles(samples, each, "k long, sub long, n long", within=side == "pos", chosen=chosen)


def _holding(found: DataFrame, wanted: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """wanted: (rank, interval, rank inside it); of each rank the range that holds it, what lies above it there, and its pairs."""
    n = found.groupBy("k", "sub").agg(F.sum("n").alias("n"))
    down = n.withColumn("s", F.sum("n").over(Window.partitionBy("k").orderBy(F.col("sub").desc()).rowsBetween(Window.unboundedPreceding, 0)))  # at most PARTS or FEW rows
    asked = F.broadcast(found.sparkSession.createDataFrame(wanted, "rank long, k long, inside long"))
    rows = down.join(asked, "k").where((F.col("s") >= F.col("inside")) & (F.col("s") - F.col("n") < F.col("inside"))).select("rank", "sub", (F.col("s") - F.col("n")).alias("above"), "n").collect()  # a row a rank
    return {r["rank"]: (r["sub"], r["above"], r["n"]) for r in rows}


def ranked_scores(samples: DataFrame, hist: DataFrame, ranks: list[int], side: str = "neg", bins: int = V.BINS, chosen: DataFrame | None = None) -> dict[int, float]:
    """Exact scores at given ranks from the top (1: the greatest). ``chosen``: tiles laid out already."""
    n, s = F.col(f"n_{side}"), F.col(f"s_{side}")
    want = F.broadcast(hist.sparkSession.createDataFrame([(int(r),) for r in sorted(set(ranks))], "rank long"))
    spots = cumulated(hist).crossJoin(want).where((s >= F.col("rank")) & (s - n < F.col("rank"))).select("bin", "rank", (s - n).alias("above"), n.alias("n")).collect()  # a row a rank
    edges = {b: bin_interval(b, bins) for b in {r["bin"] for r in spots}}
    open_ = {r["rank"]: (*edges[r["bin"]], r["rank"] - r["above"], r["n"]) for r in spots}  # first and last ordinal, rank inside, pairs
    out: dict[int, float] = {}
    while True:
        out |= {r: float(scores_of(lo)) for r, (lo, hi, _, _) in open_.items() if lo == hi}
        open_ = {r: x for r, x in open_.items() if r not in out}
        large = {r: x for r, x in open_.items() if x[3] > FEW}
        if not open_:
            return out
        some = large or open_
        intervals = sorted({x[:2] for x in some.values()})
        wanted = [(r, intervals.index(x[:2]), x[2]) for r, x in some.items()]
        if not large:
            listed = _holding(_listed(samples, side, intervals, chosen), wanted)
            return out | {r: float(scores_of(sub)) for r, (sub, _, _) in listed.items()}
        shifts = [max(0, (hi - lo).bit_length() - 16) for lo, hi in intervals]
        for r, (sub, above, n) in _holding(_counts(samples, side, intervals, shifts, chosen), wanted).items():
            lo, hi, inside, _ = some[r]
            shift = shifts[intervals.index((lo, hi))]
            lo += sub << shift
            open_[r] = (lo, min(hi, lo + (1 << shift) - 1), inside - above, n)


# different scores of all pairs, counted without a row for every pair

RANGE = 2_000_000  # pairs of a range of bins, which is merged at a time
CHUNK = 4_000_000  # scores that a task sorts before it sends them
ROUND = 2000  # pairs that are sent in a round for each sample, so that their files grow as the samples do; a bin is sent in one round
LEAST_ROUND = 20_000_000


def _packed(keys: np.ndarray) -> bytes:
    """Sorted whole numbers: how many, the first one, and the steps byte by byte, as many bytes of each as the greatest one has."""
    steps = np.diff(keys)
    most = -(-int(steps.max(initial=0)).bit_length() // 8)
    return np.array([len(keys), keys[0]]).tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :most].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n, first = np.frombuffer(data, np.int64, 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n > 1:
        for k, part in enumerate(np.frombuffer(data, np.uint8, offset=16).reshape(-1, n - 1)):
            out[1:, k] = part
    out = out.view(np.int64).ravel()
    out[0] = first
    return out.cumsum()


def _once(keys: np.ndarray) -> np.ndarray:
    """The different ones, sorted."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def ranges_of(hist: DataFrame, most: int) -> list[tuple[int, int]]:
    """The first bins of ranges that hold about ``most`` pairs each (or a single bin), and their pairs."""
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    n = F.col("n_pos") + F.col("n_neg")
    number = F.floor(F.coalesce(F.sum(n).over(up), F.lit(0)) / most)
    ranges = hist.select("bin", n.alias("n"), number.alias("r")).groupBy("r").agg(F.min("bin").alias("bin"), F.sum("n").alias("n")).orderBy("bin")
    return [(r["bin"], r["n"]) for r in ranges.collect()]  # a row a range


def _rounds(ranges: list[tuple[int, int]], most: int) -> list[list[int]]:
    """The first bins of ranges, in groups that hold about ``most`` pairs each (or a single range)."""
    out, size = [], 0
    for first, n in ranges:
        if not out or size + n > most:
            out, size = [*out, []], 0
        out[-1].append(first)
        size += n
    return out


def _sent(layout: DataFrame, firsts: list[int], bins: int, only: list[int]) -> DataFrame:
    """r (range of bins), pos, keys, counts: the sorted different scores of a chunk of a task's pairs in a range, packed."""
    edges, asked = np.array(firsts, np.int64), np.zeros(bins, bool)
    asked[only] = True

    def each(state, *tile):
        for a, b, same in tiled.parts_of(*tile):
            sim, want = tiled.scores(a, b, same)
            hit = asked[tiled.binned(sim, bins, "floor")]
            x, y = np.nonzero(hit if want is None else hit & want)
            pos = a.who[x] == b.who[y]
            for side, some in ((True, pos), (False, ~pos)):
                state.setdefault(side, []).append(sim[x[some], y[some]])
            state["n"] = state.get("n", 0) + len(x)
            if state["n"] >= CHUNK:
                yield from finish(state)

    def finish(state):
        for side in (True, False):
            x = np.concatenate(state.pop(side, None) or [np.zeros(0)])
            if len(x):
                keys, counts = np.unique(ordinals(x), return_counts=True)
                r = np.searchsorted(edges, tiled.binned(scores_of(keys), bins, "floor"), "right") - 1
                cut = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
                parts = list(zip(cut, cut[1:]))
                rows = [pa.array(r[cut[:-1]]), pa.array([side] * len(parts)), pa.array([_packed(keys[u:v]) for u, v in parts], pa.binary())]
                rows.append(pa.array([counts[u:v].tobytes() if (counts[u:v] > 1).any() else None for u, v in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(rows, names=["r", "pos", "keys", "counts"])
        state["n"] = 0

    return tiled.run_tiles(layout, each, "r long, pos boolean, keys binary, counts binary", finish=finish, chosen=layout)


def _sent_once(layout: DataFrame, firsts: list[int], after: int, bins: int) -> DataFrame:
    """r (range of bins), keys: the same of all pairs from the first range's first bin up to the bin ``after``, without counts and sides."""
    edges = first_ordinals([*firsts, after], bins)
    lo, hi = scores_of(edges[[0, -1]] - [0, 1]).tolist()
    lo, hi = -math.inf if lo == -1 else lo, math.inf if hi == 1 else hi  # what is beyond is clamped

    def each(state, *tile):
        for a, b, same in tiled.parts_of(*tile):
            sim = a.v @ b.v.T
            inside = (sim >= lo) & (sim <= hi)
            x = np.clip(sim[np.triu(inside, 1) if same else inside], -1.0, 1.0)
            state.setdefault("scores", []).append(x)
            state["n"] = state.get("n", 0) + len(x)
            if state["n"] >= CHUNK:
                yield from finish(state)

    def finish(state):
        if state.get("n"):
            keys = _once(ordinals(np.concatenate(state["scores"])))
            cut = np.searchsorted(keys, edges).tolist()
            parts = [(r, u, v) for r, (u, v) in enumerate(zip(cut, cut[1:])) if u < v]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in parts]), pa.array([_packed(keys[u:v]) for _, u, v in parts], pa.binary())], names=["r", "keys"])
        state.clear()

    return tiled.run_tiles(layout, each, "r long, keys binary", finish=finish, chosen=layout)


def _merged(batches, columns: list[str], read, together):
    """``together`` of what ``read`` makes of the rows of each range, which come in the order of r. Parts begin with their keys."""
    now, parts, size, least = None, [], 0, 0
    for batch in batches:
        for r, *row in zip(*(batch.column(c) for c in ("r", *columns))):
            if r.as_py() != now and parts:
                yield together(parts)
                parts, size, least = [], 0, 0
            now = r.as_py()
            parts.append(read(*row))
            size += len(parts[-1][0])
            if size > max(RANGE, 2 * least):  # scores that many chunks share are kept once
                parts = [together(parts)]
                size = least = len(parts[0][0])
    if parts:
        yield together(parts)


def counted_scores(layout: DataFrame, hist: DataFrame, pairs: int, bins: int = V.BINS) -> DataFrame:
    """bin, c: the different scores in each bin of the tiles ``layout``. Equal scores must meet, so nearly every pair is sent, but in
    rounds of about ``ROUND`` pairs for each sample: a round is a pass over the tiles for its bins, and Spark removes its files before the
    next one begins."""

    def read(keys):
        return (_unpacked(keys.as_buffer()),)

    def together(parts):
        return (_once(np.concatenate([k for k, in parts])),)

    def run(batches):
        for (keys,) in _merged(batches, ["keys"], read, together):
            first, last = tiled.binned(scores_of(keys[[0, -1]]), bins, "floor").tolist()
            c = np.diff(np.searchsorted(keys, first_ordinals(np.arange(first, last + 2), bins)))
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(first + at), pa.array(c[at])], names=["bin", "c"])

    spark = layout.sparkSession
    rounds = _rounds(ranges_of(hist, RANGE), max(LEAST_ROUND, ROUND * math.isqrt(2 * pairs)))
    folder, parts = fresh(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for some, after in zip(rounds, [*(x[0] for x in rounds[1:]), bins]):
        sent = _sent_once(layout, some, after, bins).repartition(min(parts, len(some)), "r").sortWithinPartitions("r")
        with released(spark):
            sent.mapInArrow(run, "bin long, c long").write.mode("append").parquet(folder)
    own = "bin long, c long"
    return spark.read.schema(own).parquet(folder) if rounds else spark.createDataFrame([], own)


def listed_scores(layout: DataFrame, hist: DataFrame, each, schema: str, only: list[int], bins: int = V.BINS) -> DataFrame:
    """What each(bin, scores, n_pos, n_neg) yields (record batches) of ranges of whole bins, of the bins ``only`` of the tiles
    ``layout``: for every different score, in order, its bin and its pairs. A task holds a range of about ``RANGE`` pairs; partitions
    follow the pairs."""

    def read(pos, data, counts):
        keys = _unpacked(data.as_buffer())
        n, none = np.frombuffer(counts.as_buffer(), np.int64) if counts.is_valid else np.ones(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return (keys, n, none) if pos.as_py() else (keys, none, n)

    def together(parts):
        keys, at = np.unique(np.concatenate([k for k, _, _ in parts]), return_inverse=True)
        sums = []
        for side in (1, 2):
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, np.concatenate([x[side] for x in parts]))
            sums.append(n)
        return keys, *sums

    def run(batches):
        for keys, p, n in _merged(batches, ["pos", "keys", "counts"], read, together):
            sim = scores_of(keys)
            yield from each(tiled.binned(sim, bins, "floor"), sim, p, n)

    spark = layout.sparkSession
    asked = F.broadcast(spark.createDataFrame([(b,) for b in only], "bin long"))  # at most as many rows as bins
    ranges = ranges_of(hist.join(asked, "bin"), RANGE)
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n for _, n in ranges) // (8 * RANGE)))
    return _sent(layout, [b for b, _ in ranges], bins, only).repartition(most, "r").sortWithinPartitions("r").mapInArrow(run, schema)
