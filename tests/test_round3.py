"""What the findings of round 3 were about: how work is laid out, and results beyond the small tables."""

import numpy as np
from pyspark.sql import functions as F

from pairscope import catalog
from pairscope.operators import density_clusters, extraction, growing, tile_plans, validation
from pairscope.plans import pruned, strategies, tiled
from pairscope.sources import sinks

SCHEMA = "sample_id long, identity long, v array<double>, path string"


def made(spark, n=300, groups=3, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(k, int(rng.integers(groups)), x[k].tolist(), f"p{k}") for k in range(n)], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_task_that_writes_a_version_adds_nothing_up(spark):
    hist = spark.range(100).selectExpr("id % 7 as bin", "id as n_pos", "id as n_neg").groupBy("bin").sum("n_pos", "n_neg")
    one = growing.in_one_file(hist)
    assert one.rdd.getNumPartitions() == 1 and "Coalesce" not in plan(one)
    assert plan(one).index("REPARTITION_BY_NUM") < plan(one).index("HashAggregate")


def test_tiles_and_chosen_tiles_are_not_shuffled(spark):
    s = made(spark)
    assert "CartesianProduct" in plan(tiled.tiles(s, 40)) and "Exchange" not in plan(tiled.tiles(s, 40))
    near = pruned.near_blocks(s, 40, 5)
    chosen = near.tiles(near.meeting(0.5, True))
    assert "CartesianProduct" in plan(chosen) and "Exchange" not in plan(chosen)
    met = near.meeting(0.5, True)
    assert sorted(map(tuple, chosen.select("bi", "bj").collect())) == sorted(map(tuple, met.select("bi", "bj").collect()))


def test_copies_of_identities_follow_their_share_of_the_work(spark):
    """Eight identities together fill the partitions; each alone need not."""
    s = made(spark, 480, 8)
    assert tiled.cells(s, 4, True).count() < 5 * tiled.blocks(s, 4, True).count()


def test_tasks_and_not_tiles_send_distances_and_edges(spark, monkeypatch):
    """300 samples in 30 blocks: each would be sent by every block that it meets."""
    sent = []
    run = tiled.run_tiles
    monkeypatch.setattr(tiled, "run_tiles", lambda *a, **k: (lambda d: sent.append(d.count()) or d)(run(*a, **k)))
    s = made(spark)
    density_clusters.core_distances(s, size=10).count()
    density_clusters.spanning_tree(s, size=10).count()
    assert sent and max(sent) < 300 * 15


def test_joined_and_banded_histograms_equal_the_tiled_one(spark):
    s = made(spark)
    want, *others = (sorted(map(tuple, strategies.pair_histogram(s, how, size=37).collect())) for how in ("tiled", "joined", "banded"))
    assert others == [want, want] and sum(p + n for _, p, n in want) == 300 * 299 // 2


def test_no_pair_is_evaluated_row_by_row(spark):
    """The queries of F1 and F2 have no join of samples."""
    for name in ("pair_histogram_joined", "histogram_difference"):
        assert "zip_with" not in plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_examples_that_lie_nearer_to_each_other_than_nine_places(spark):
    """Scores 4e-10 apart around the threshold: the order is that of the scores, not that of their ids."""
    t = 0.5
    rows = [(0, 0, [1.0, 0.0], "p")] + [(k, k, [t + (20 - k) * 4e-10, 0.0], "p") for k in range(1, 16)]
    s = spark.createDataFrame(rows, SCHEMA)
    got = extraction.class_examples(s, t, 5).where("pair_type = 'false_accept'").orderBy("at").collect()
    assert [(r["i"], r["j"]) for r in got] == [(0, k) for k in range(15, 10, -1)]


def test_examples_of_copies_are_in_the_order_of_their_ids(spark):
    """Copies have one score in whichever tile they lie, so ids decide."""
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((2, 64)) / 8
    rows = [(0, 0, x.tolist(), "p")] + [(k, k, y.tolist(), "p") for k in range(1, 60)]
    s = spark.createDataFrame(rows, SCHEMA)
    score = float(np.cumsum(x * y)[-1])
    got = extraction.class_examples(s, score - 0.01, 9).where("pair_type = 'false_accept' and i = 0").orderBy("at").collect()
    assert [(r["i"], r["j"]) for r in got] == [(0, k) for k in range(1, 10)]


def test_tiles_with_positives_are_found_once(spark):
    for groups in (2, 60):
        s = made(spark, 900, groups)
        who = {r["sample_id"]: r["identity"] for r in s.collect()}
        want = sorted({(i // 16, j // 16) for i in who for j in who if i < j and who[i] == who[j]})
        df = tile_plans.positive_tiles(s, 16)
        assert sorted(map(tuple, df.collect())) == want
        assert "Aggregate" not in plan(df)


def test_text_forms_are_compressed_and_rows_made_once(spark, tmp_path, monkeypatch):
    s = made(spark, 60)
    counted = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(tiled, "COUNTED", counted)
    df = sinks.error_pairs(extraction.with_paths(extraction.beyond(s, "all", ">", 0.1), s))
    sinks.write_tsv(df, str(tmp_path / "t"), "all")
    assert counted.value == 1
    n = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t/rows")).count()
    assert n > 0 and spark.read.text(str(tmp_path / "t/head")).first()[0] == f"# kind=all count={n}"
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    for form in ("t/rows", "c", "j"):
        parts = [p.name for p in (tmp_path / form).iterdir() if p.name.startswith("part-")]
        assert parts and all(p.endswith(".gz") for p in parts)


def test_a_file_for_each_row_whatever_its_identity(spark, tmp_path):
    """Ids that repeat and identities that are null or negative keep their files; tasks write without a commit of each file."""
    rows = [(k % 40, None if k % 9 == 0 else k % 5 - 2, [1.0], "p") for k in range(90)]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, path string").drop("path").repartition(3)
    e.write.parquet(str(tmp_path / "sf/embeddings.parquet"))
    got = catalog.queries()["scanned_files"](spark, str(tmp_path / "sf"))
    assert sorted(map(str, got.collect())) == sorted(map(str, e.groupBy(F.col("label").cast("long").alias("identity")).agg(F.count("*").alias("n")).collect()))
    e.limit(0).write.parquet(str(tmp_path / "none/embeddings.parquet"))
    assert catalog.queries()["scanned_files"](spark, str(tmp_path / "none")).count() == 0


def test_what_a_histogram_makes_of_pairs_does_not_follow_the_blocks(monkeypatch):
    """A tile of large blocks is met in parts of bounded size, each pair once."""
    monkeypatch.setattr(tiled, "SIZE", 16)
    one, two = (tiled.Block(np.arange(n) + k, np.zeros(n, np.int64), np.ones((n, 2))) for n, k in ((70, 0), (50, 100)))
    for a, b, same, want in ((one, two, False, 70 * 50), (one, one, True, 70 * 69 // 2)):
        met = [(int(i), int(j)) for x, y, again in tiled.parts_of(a, b, same) for i in x.ids for j in y.ids if not again or i < j]
        assert len(met) == len(set(met)) == want
        assert max(len(x.ids) * len(y.ids) for x, y, _ in tiled.parts_of(a, b, same)) <= 16 * 16


def test_sets_of_pairs_are_compared_in_the_tasks(spark):
    """The same row as a join of both sets gives, and only counts are shuffled; either set may be the larger one."""
    s = made(spark)
    for every, positive in ((0.3, 0.32), (0.5, 0.1), (2.0, 0.2), (0.2, 2.0), (2.0, 2.0)):
        want = validation.pair_set_difference(extraction.beyond(s, "all", ">", every), extraction.beyond(s, "pos", ">", positive)).first()
        assert validation.beyond_difference(s, every, positive, 37).first() == want
    assert "Join" not in plan(catalog.queries()["pair_set_difference"](spark, "/root/testdata/sf0.001"))
    assert validation.beyond_difference(s.limit(0), 0.3, 0.32).first() == (0, 0, 0, None)
