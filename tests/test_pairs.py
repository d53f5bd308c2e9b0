import numpy as np
import pytest

from pairscope.operators import clustering, extraction, histograms, profile, thresholds, validation
from pairscope.plans import strategies, tiled
from pairscope.sources import samples as sources
from pairscope.sources import sinks

SCHEMA = "sample_id long, identity long, v array<double>, path string"


def planted(ids=12, per=6, dim=16, noise=0.2, shuffled=False, seed=3):
    rng = np.random.default_rng(seed)
    mid = rng.standard_normal((ids, dim))
    x = np.repeat(mid, per, 0) + noise * rng.standard_normal((ids * per, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who = np.repeat(np.arange(ids), per)
    order = rng.permutation(len(x)) if shuffled else np.arange(len(x))
    return [(int(k), int(who[k]), x[k].tolist(), f"p{k}") for k in order]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def numpy_histogram(rows, bins=200_000):
    x, who = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    a, b = np.triu_indices(len(rows), 1)
    k = np.minimum(bins - 1, np.floor((np.clip((x @ x.T)[a, b], -1, 1) + 1) * (bins / 2)).astype(int))
    pos = who[a] == who[b]
    return np.bincount(k[pos], minlength=bins), np.bincount(k[~pos], minlength=bins)


def collected(hist):
    return {r["bin"]: (r["n_pos"], r["n_neg"]) for r in hist.collect()}


def expected(rows):
    p, n = numpy_histogram(rows)
    return {int(k): (int(p[k]), int(n[k])) for k in np.flatnonzero(p + n)}


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("size", [1, 7, 71, 72, 73])
def test_histogram_for_block_sizes_and_orders(spark, size, shuffled):
    rows = planted(shuffled=shuffled)
    got = tiled.histogram(frame(spark, rows), size=size)
    assert collected(got) == expected(planted())
    assert validation.conserved(got, frame(spark, rows)).first()["strict_ok"]


def test_strategies_agree(spark):
    s = frame(spark, planted())
    hof = collected(strategies.pair_histogram(s, "hof"))
    assert hof == collected(strategies.pair_histogram(s, "tiled", size=10))
    only = {k: p for k, (p, _) in hof.items() if p}
    assert {k: p for k, (p, _) in collected(strategies.pair_histogram(s, "group", size=4)).items()} == only


def test_a_lost_tile_is_noticed(spark):
    s = frame(spark, planted())
    part = tiled.histogram(s.where("sample_id > 0"))
    row = validation.conserved(part, s).first()
    assert not row["strict_ok"] and not row["ok"]


def test_planted_signal_and_shuffled_labels(spark):
    rows = planted(noise=0.1)
    t = thresholds.tpir(tiled.histogram(frame(spark, rows)), fpirs=[0.01]).first()
    assert t["tpir"] > 0.9
    mixed = [(r[0], rows[(7 * k) % len(rows)][1], r[2], r[3]) for k, r in enumerate(rows)]
    assert thresholds.tpir(tiled.histogram(frame(spark, mixed)), fpirs=[0.01]).first()["tpir"] < 0.5


def test_edges_and_ties(spark):
    rows = [(0, 1, [1.0, 0.0], "a"), (1, 1, [1.0, 0.0], "b"), (2, 2, [-1.0, 0.0], "c"), (3, 3, [0.0, 1.0], "d")]
    s = frame(spark, rows)
    assert collected(tiled.histogram(s)) == {199_999: (1, 0), 0: (0, 2), 100_000: (0, 3)}
    assert [(r["i"], r["j"]) for r in extraction.top(s, "neg", 4).collect()] == [(0, 3), (1, 3), (2, 3), (0, 2)]


@pytest.mark.parametrize("rows", [[], planted(1, 1), planted(1, 2), planted(1, 5), planted(5, 1)])
def test_degenerate_sets(spark, rows):
    s = frame(spark, rows)
    hist = tiled.histogram(s)
    assert collected(hist) == (expected(rows) if len(rows) > 1 else {})
    for rule in ("canonical", "plain", "floor", "rank_bins", "centre", "inside"):
        for r in thresholds.tpir(hist, rule).collect():
            assert r["tpir"] is None or 0 <= r["tpir"] <= 1
    assert profile.pair_counts(s).first()["n_pairs"] == len(rows) * (len(rows) - 1) // 2


@pytest.mark.parametrize("bad", [(9, 1, [float("nan")] * 16, "x"), (9, 1, [float("inf")] * 16, "x"), (9, 1, [0.0] * 16, "x"), (9, 1, None, "x"), (900, 1, [1.0, 0.0], "x"), (0, 1, planted()[0][2], "x"), (None, 1, planted()[0][2], "x"), (900, None, planted()[0][2], "x")])
def test_invalid_samples_are_refused(spark, bad):
    rows = [r for r in planted() if r[0] != 9] + [bad]
    with pytest.raises(ValueError):
        sources.validated(frame(spark, rows))
    sources.validated(frame(spark, planted()))


def test_scaled_vectors_normalise(spark, tmp_path):
    rows = planted()
    scaled = spark.createDataFrame([(r[0], str(r[1]), [3 * x for x in r[2]]) for r in rows], "vec_id long, label string, embedding array<double>")
    scaled.write.parquet(str(tmp_path / "e"))
    got = tiled.histogram(sources.load(spark, str(tmp_path / "e")))
    assert sum(abs(a - b) for a, b in zip(*(np.array(sorted(collected(h).items()), object)[:, 0] for h in (got, tiled.histogram(frame(spark, rows)))))) <= 5


def test_rebin_and_subtraction(spark):
    s = frame(spark, planted())
    hist = tiled.histogram(s)
    small = histograms.rebinned(hist, 1000)
    assert sum(sum(v) for v in collected(small).values()) == 72 * 71 // 2
    with pytest.raises(ValueError):
        histograms.rebinned(hist, 7)
    full = hist.selectExpr("bin", "n_pos + n_neg as n")
    assert collected(histograms.negatives_by_subtraction(full, hist.select("bin", "n_pos"))) == collected(hist)
    with pytest.raises(Exception, match="more positives"):
        histograms.negatives_by_subtraction(full, hist.selectExpr("bin", "n_pos + n_neg + 1 as n_pos")).collect()


def test_extraction_equals_numpy(spark):
    rows = planted()
    x, who = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    sim = np.clip(x @ x.T, -1, 1)
    every = [(round(sim[a, b], 12), a, b, who[a] == who[b]) for a in range(len(x)) for b in range(a + 1, len(x))]
    neg = sorted((-s, a, b) for s, a, b, p in every if not p)
    got = [(r["i"], r["j"]) for r in extraction.top(frame(spark, rows), "neg", 17).collect()]
    assert got == [(a, b) for _, a, b in neg[:17]]
    pos = sorted((s, a, b) for s, a, b, p in every if p)
    got = [(r["i"], r["j"]) for r in extraction.top(frame(spark, rows), "pos", 17, highest=False).collect()]
    assert got == [(a, b) for _, a, b in pos[:17]]


def test_sinks(spark, tmp_path):
    s = frame(spark, planted())
    got = sinks.error_pairs(extraction.with_paths(extraction.top(s, "neg", 5), s))
    assert got.columns == ["side", "score", "i", "id_i", "path_i", "j", "id_j", "path_j"]
    none = sinks.error_pairs(extraction.with_paths(extraction.beyond(s, "neg", ">", 2.0), s))
    for k, df in enumerate((got, none)):
        sinks.write_parquet(df, str(tmp_path / f"p{k}"))
        assert spark.read.parquet(str(tmp_path / f"p{k}")).columns == got.columns
        sinks.write_csv(df, str(tmp_path / f"c{k}"))
        sinks.write_json(df, str(tmp_path / f"j{k}"))
        sinks.write_tsv(df, str(tmp_path / f"t{k}"), "neg")
        assert spark.read.text(str(tmp_path / f"t{k}" / "head")).first()[0] == f"# kind=neg count={(5, 0)[k]}"
    hist = tiled.histogram(s)
    sinks.write_histogram(hist, str(tmp_path / "h"))
    assert validation.histogram_difference(sinks.read_histogram(spark, str(tmp_path / "h")), hist).first()["bins_differ"] == 0


def test_clusters(spark):
    s = frame(spark, planted(noise=0.05))
    c = clustering.density_centre(s)
    assert c.where("is_centre").count() == 1 and c.where("cluster = 0").count() >= 6
    assert clustering.absorbed(s, c.select("sample_id", "cluster")).count() >= 6


def test_generated_samples_have_independent_streams(spark):
    made = sources.generate(spark, 20, 3, 64).collect()
    x = {r["vec_id"]: np.array(r["embedding"]) for r in made}
    assert len(x) == 60 and all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in x.values())
    assert max(abs(x[k] @ x[j]) for k in range(3) for j in range(3, 60)) < 0.6


def test_files_and_folders(spark, tmp_path):
    for p in ("a/x/1.jpg", "a/y/2.jpg", "b/x/3.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    assert sources.files(spark, str(tmp_path), ".jpg").count() == 2
    assert {(r["child"], r["parent"]) for r in sources.folder_parents(sources.files(spark, str(tmp_path))).collect()} == {("x", "b"), ("y", "a")}


@pytest.mark.parametrize("size", [3, 50_000])
def test_numbers_in_order_have_no_gaps(spark, size):
    ids = [7, -3, 100, 2**40, 5, 6, 8, 9, 10, 11, -(2**50)]
    rows = spark.createDataFrame([(i, f"x{i}") for i in ids], "k long, x string").repartition(5)
    got = sources.numbered_in_order(rows, "k", "at", size).collect()
    assert sorted((r["at"], r["k"], r["x"]) for r in got) == [(n, i, f"x{i}") for n, i in enumerate(sorted(ids))]


def test_set_normalised(spark):
    rows = lambda *v: spark.createDataFrame([(k, 1, [float(x) for x in w], "p") for k, w in enumerate(v)], "sample_id long, identity long, v array<double>, path string")
    see = lambda df: [r["v"] for r in df.orderBy("sample_id").collect()]
    assert see(sources.set_normalised(rows((1, 0), (0, 1.0005)))) == [[1, 0], [0, 1.0005]]  # all are near 1: none is touched
    assert see(sources.set_normalised(rows((1, 0), (0, 1.0005), (3, 4)))) == [[1, 0], [0, 1], [0.6, 0.8]]  # one is off: all are divided
    with pytest.raises(ValueError):
        sources.set_normalised(rows((1, 0), (0, 0)))
    assert see(sources.set_normalised(rows((3, 4), (0, 0)), 1e-5, 1e-10)) == [[0.6, 0.8], [0, 0]]
    assert see(sources.set_normalised(rows().limit(0))) == []


def test_sampled_pairs_drop_only_pairs_of_a_sample_with_itself(spark):
    rows = planted()
    x, n = {r[0]: (r[1], np.array(r[2])) for r in rows}, 3000
    got = profile.sampled_pairs(frame(spark, rows), n).collect()
    assert {r["id"] for r in got} <= set(range(n)) and len({r["id"] for r in got}) == len(got)
    assert abs(len(got) - n * (1 - 1 / len(rows))) < 6 * (n / len(rows)) ** 0.5
    assert {r["i"] for r in got} == {r["j"] for r in got} == set(x)
    for r in got:
        (a, u), (b, v) = x[r["i"]], x[r["j"]]
        assert r["i"] != r["j"] and r["is_pos"] == (a == b) and abs(r["sim"] - u @ v) < 1e-9
    assert profile.sampled_pairs(frame(spark, [])).count() == 0
