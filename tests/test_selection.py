"""Order statistics by refinement, and several results of one pass over the tiles."""

import numpy as np
import pytest

from pairscope.functions import vectors as V
from pairscope.operators import extraction, profile, selection, thresholds
from pairscope.plans import tiled
from pairscope.sources.samples import numbered_in_order

SCHEMA = "sample_id long, identity long, v array<double>, path string"


def tied(n=150, equal=50, dim=4):
    """A third of the vectors are equal, so many pairs have one score."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, dim))
    x[:equal] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, rng.integers(0, 3, n)


def frame(spark, x, who):
    return spark.createDataFrame([(k, int(w), v.tolist(), "p") for k, (v, w) in enumerate(zip(x, who))], SCHEMA).repartition(3)


def all_scores(x, who, side):
    a, b = np.triu_indices(len(x), 1)
    s = np.clip((x @ x.T)[a, b], -1, 1)
    return np.sort(s[(who[a] == who[b]) == (side == "pos")])[::-1]


def test_ordinals_keep_the_order_of_scores():
    x = np.array([-1.0, -0.5, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 0.3, np.nextafter(0.3, 1), 1.0])
    k = selection.ordinals(x)
    assert (np.diff(k)[[0, 1, 2, 4, 5, 6, 7, 8]] > 0).all() and k[3] == k[4] and (selection.scores_of(k) == x).all()
    for b in (0, 1, 99_999, 100_000, 100_001, 130_000, 199_999):
        lo, hi = selection.bin_interval(b, 200_000)
        at = tiled.binned(selection.scores_of([lo, hi]), 200_000, "floor")
        assert list(at) == [b, b]
        if b:
            assert tiled.binned(selection.scores_of([lo - 1]), 200_000, "floor")[0] == b - 1


@pytest.mark.parametrize("few, bins", [(50_000, 200_000), (3, 20)])
def test_ranks_equal_a_sort(spark, monkeypatch, few, bins):
    """The second refines large bins to the end, through ties."""
    monkeypatch.setattr(selection, "FEW", few)
    x, who = tied()
    s = frame(spark, x, who)
    hist = tiled.histogram(s, bins, size=64).persist()
    for side in ("neg", "pos"):
        want = all_scores(x, who, side)
        ranks = [1, 2, len(want) // 3, len(want) // 2, len(want) - 1, len(want)]
        got = selection.ranked_scores(s, hist, ranks, side, bins)
        assert set(got) == set(ranks)
        assert all(abs(got[r] - want[r - 1]) < 1e-12 for r in ranks)


def test_no_task_lists_a_bin(spark, monkeypatch):
    """With a third of the vectors equal, what leaves the tiles are counts: far fewer rows than pairs of the bin."""
    monkeypatch.setattr(selection, "FEW", 10)
    rows = []
    for name in ("_counts", "_listed"):
        made = getattr(selection, name)
        monkeypatch.setattr(selection, name, lambda *a, f=made: (lambda d: rows.append(d.count()) or d)(f(*a)))
    x, who = tied()
    who[:] = np.arange(len(who))  # all pairs are negative: the copies' score is that of 1,225 of them
    s = frame(spark, x, who)
    got = selection.ranked_scores(s, tiled.histogram(s), [600])
    assert abs(got[600] - 1) < 1e-12 and max(rows) < 200


def test_exact_metrics_at_all_rates(spark):
    """Both ends and between: accepts counted by the threshold equal those of all scores."""
    x, who = tied()
    s = frame(spark, x, who)
    pos, neg = all_scores(x, who, "pos"), all_scores(x, who, "neg")
    for r in thresholds.tpir_ends(s, tiled.histogram(s), (0.0, 0.01, 0.1, 1.0)).collect():
        f = r["fpir_target"]
        t = neg[0] if f == 0 else np.nextafter(neg[-1], -np.inf) if f == 1 else neg[::-1][max(0, int(np.ceil((1 - f) * len(neg))) - 1)]
        assert abs(r["threshold"] - t) < 1e-6 and abs(r["pos_above"] - (pos > t + 1e-12).sum()) <= (abs(pos - t) < 1e-12).sum()
        assert (neg > t + 1e-12).sum() / len(neg) <= f + 1e-12


def test_one_pass_gives_all_parts(spark, monkeypatch):
    x, who = tied()
    s = frame(spark, x, who)
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(tiled, "COUNTED", counted)
    both = tiled.measured(s, moments=True, keep={"high": lambda sim, pos: ~pos & (sim > 0.9), "low": lambda sim, pos: pos & (sim < -0.5)}, size=40)
    blocks = 4
    assert counted.value == blocks * (blocks + 1) // 2
    hist = {r["bin"]: (r["n_pos"], r["n_neg"]) for r in both.histogram().collect()}
    assert sum(p for p, _ in hist.values()) == len(all_scores(x, who, "pos")) and sum(n for _, n in hist.values()) == len(all_scores(x, who, "neg"))
    assert both.pairs("high").count() == (all_scores(x, who, "neg") > 0.9).sum() and both.pairs("low").count() == (all_scores(x, who, "pos") < -0.5).sum()
    m = {r["is_pos"]: r for r in both.moments().collect()}
    for side in ("pos", "neg"):
        want, r = all_scores(x, who, side), m[side == "pos"]
        assert r["n"] == len(want) and abs(r["s"] - want.sum()) < 1e-6 and abs(r["least"] - want[-1]) < 1e-12 and abs(r["most"] - want[0]) < 1e-12
    assert counted.value == blocks * (blocks + 1) // 2  # the parts are read, not made again
    with pytest.raises(ValueError):
        tiled.measured(s, keep={"histogram": lambda sim, pos: pos})


@pytest.mark.parametrize("query", [lambda s: extraction.class_examples(s, 0.1, 5), lambda s: extraction.nearest(s, 0.1, 5), lambda s: thresholds.tpir(tiled.histogram(s)), lambda s: thresholds.tpir(tiled.histogram(s), "inside")])
def test_passes(spark, monkeypatch, query):
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(tiled, "COUNTED", counted)
    query(frame(spark, *tied())).collect()
    assert counted.value == 1  # all samples are one block


def test_summary_of_nothing(spark):
    none = frame(spark, *tied()).where("false")
    assert profile.score_summary(none).count() == 0


def test_fitted_blocks(spark):
    """Less memory or longer vectors: lower blocks; few rows: several tiles a partition; the counts are the same."""
    x, who = tied()
    s = frame(spark, x, who)
    large = spark.range(1_000_000).selectExpr("id as sample_id", "id as identity", "array(1.0D, 0.0D) as v")
    wide = large.withColumn("v", selection.F.expr("array_repeat(0.5D, 2048)"))
    sizes = [tiled.fitted_size(large), tiled.fitted_size(large, 8 << 20), tiled.fitted_size(wide, 8 << 20)]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 3 and sizes[0] > 1500
    for n, size in zip((2, 2, 2048), sizes):
        assert 32 * n * size + 32 * size * size <= (128 << 20 if size == sizes[0] else 8 << 20)
    assert tiled.fitted_size(s) == 32 and tiled.fitted_size(s.where("false")) == 32
    got, want = ({r["bin"]: (r["n_pos"], r["n_neg"]) for r in tiled.histogram(s, size=k).collect()} for k in (tiled.fitted_size(s), 1024))
    assert got == want


def test_rates_are_checked():
    assert V.checked_fpirs([0.1, 0.01, 0.1]) == [0.01, 0.1] and V.checked_fpirs([0, 1], closed=True) == [0.0, 1.0]
    for bad in ([], [0.0], [1.0], [0.5, 2.0], [-0.1]):
        with pytest.raises(ValueError):
            V.checked_fpirs(bad)
    with pytest.raises(ValueError):
        V.checked_fpirs([1.5], closed=True)


def test_numbers_follow_the_order(spark):
    """Several ranges, in any layout; and draws of pairs with large ids are the same as in whole-number arithmetic."""
    ids = np.random.default_rng(1).choice(10**12, 5000, replace=False).tolist()
    rows = spark.createDataFrame([(k, f"r{k}") for k in ids], "id long, name string").repartition(7)
    got = {r["id"]: (r["at"], r["name"]) for r in numbered_in_order(rows, "id", "at", 300).collect()}
    assert got == {k: (n, f"r{k}") for n, k in enumerate(sorted(ids))}
    assert numbered_in_order(rows.where("false"), "id", "at").count() == 0
    i, j = np.array(ids[:2000]), np.array(ids[2000:4000])
    want = [tiled.drawn(a, b, 10) for a, b in zip(i.tolist(), j.tolist())]  # without a limit of size
    assert tiled.drawn(i, j, 10).tolist() == want and 100 < sum(want) < 300


@pytest.mark.parametrize("points", [7, 64, 100_000])
def test_exact_curve_equals_a_sort_and_sends_no_row_for_a_pair(spark, monkeypatch, points):
    """A third of the vectors are equal; scores are exact, so that equal ones are equal in any layout. Ranges and chunks are small."""
    monkeypatch.setattr(selection, "RANGE", 700)
    monkeypatch.setattr(selection, "CHUNK", 3000)
    rng = np.random.default_rng(4)
    x, who = rng.integers(-4, 5, (200, 6)) / 16, rng.integers(0, 3, 200)
    x[:60] = x[0]
    x[100:, 5] += rng.integers(0, 1000, 100) / 2.0**20
    sent = []
    run = tiled.run_tiles
    monkeypatch.setattr(tiled, "run_tiles", lambda *a, **k: (lambda d: sent.append(d.count()) or d)(run(*a, **k)))
    got = sorted(map(tuple, thresholds.exact_curve(frame(spark, x, who), points).collect()))
    a, b = np.triu_indices(len(x), 1)
    s, pos = np.clip((x @ x.T)[a, b], -1, 1), who[a] == who[b]
    u = np.unique(s)
    places = sorted({k * (len(u) - 1) // (points - 1) for k in range(points)})
    want = sorted((round(float(u[k]), 6), round(int((s[~pos] > u[k]).sum()) / int((~pos).sum()), 9), round(int((s[pos] > u[k]).sum()) / int(pos.sum()), 9)) for k in places)
    assert len(u) > 500 and len(got) == len(want) == min(points, len(u))
    by = lambda r: (-r[1], -r[2])  # noqa: E731, the order of the scores, which six places may not tell
    assert all(abs(p - q) < 2e-6 for g, w in zip(sorted(got, key=by), sorted(want, key=by)) for p, q in zip(g, w))
    assert len(sent) == 3 and max(sent[1:]) < len(s) / 20  # packed chunks; the first is the histogram


def test_exact_curve_without_pairs(spark):
    x, who = tied()
    assert thresholds.exact_curve(frame(spark, x[:1], who[:1]), 5).count() == 0
