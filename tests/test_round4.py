"""What the findings of round 4 were about."""

import duckdb
import numpy as np
import oracle
from pyspark.sql import functions as F

from pairscope import catalog
from pairscope.operators import density_clusters as D
from pairscope.operators import profile, selection, thresholds
from pairscope.plans import tiled
from test_density_clusters import plain_tree

SCHEMA = "sample_id long, identity long, v array<double>, path string"


def frame(spark, x, who, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(k), int(w), v.tolist(), "p") for k, v, w in zip(ids, x, who)], SCHEMA).repartition(3)


def shuffled_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(k).getName() for k in range(files.size()))


def test_different_scores_are_sent_in_rounds(spark, monkeypatch):
    """Each round sends its part of the pairs, its files go before the next one, and the curve stays that of a sort."""
    rng = np.random.default_rng(4)
    x, who = rng.integers(-4, 5, (200, 6)) / 16, rng.integers(0, 3, 200)  # exact scores
    x[100:, 5] += rng.integers(0, 1000, 100) / 2.0**20
    whole = sorted(map(tuple, thresholds.exact_curve(frame(spark, x, who), 64).collect()))
    monkeypatch.setattr(selection, "RANGE", 500)
    monkeypatch.setattr(selection, "LEAST_ROUND", 2000)
    monkeypatch.setattr(selection, "ROUND", 1)
    sent, left, run = [], [], selection._sent_once

    def watched(*args):
        left.append(shuffled_files(spark))
        found = run(*args)
        sent.extend(found.select("keys").collect())
        sent.append(None)
        return found

    monkeypatch.setattr(selection, "_sent_once", watched)
    assert sorted(map(tuple, thresholds.exact_curve(frame(spark, x, who), 64).collect())) == whole
    rounds, n = [0], 0
    for row in sent:
        rounds, n = (rounds, n + len(selection._unpacked(row["keys"]))) if row else ([*rounds, n], 0)
    most = max(r for _, r in selection.ranges_of(tiled.histogram(frame(spark, x, who)), 500))
    assert len(rounds) > 5 and max(rounds) <= max(2000, most)
    assert max(left) == left[0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_steps_are_packed_in_as_many_bytes_as_they_need():
    for keys in ([5], [-7, -7], [-(2**62), 0, 2**62], range(300), [1, 1, 2, 2**40]):
        keys = np.array(keys, np.int64)
        assert (selection._unpacked(selection._packed(keys)) == keys).all()
    assert len(selection._packed(np.arange(1000))) == 16 + 999
    at = selection.first_ordinals([0, 7, 20], 20)
    assert [selection.bin_interval(k, 20) for k in (7, 19)] == [(at[1], selection.first_ordinals([8], 20)[0] - 1), (selection.first_ordinals([19], 20)[0], at[2] - 1)]


def test_tile_plan_equals_its_sql_whatever_the_ids(spark, tmp_path):
    """Ids with gaps, negative ones and repeated ones: blocks are of samples, not of numbers; no table, no tiles."""
    for name, ids in (("gaps", [7 * k - 300 for k in range(500)]), ("again", [k // 3 for k in range(333)]), ("few", [10**12]), ("none", [])):
        rows = [(k, 0, [1.0]) for k in ids]
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path / name}/embeddings.parquet/*.parquet'")
        assert oracle.differences(spark, con, catalog.queries()["tile_plan"], catalog.oracle_sql()["tile_plan"], str(tmp_path / name)) == []


def test_tile_plan_has_the_tiles_beyond_the_numbers_of_its_sql(spark):
    """The SQL numbers 1,000 blocks of 64; a larger table has more, and all of them are planned."""
    from pairscope.operators.tile_plans import tile_plan

    got = tile_plan(spark.range(64_130).withColumnRenamed("id", "sample_id"), 64)
    assert got.count() == 1003 * 1004 // 2 and got.agg(F.sum("n_pairs")).first()[0] == 64_130 * 64_129 // 2


def test_few_pairs_of_a_tile_are_looked_at_again(monkeypatch):
    """Near squares tell which pairs can matter; least edges and k least distances are those of all pairs, copies included."""
    rng = np.random.default_rng(6)
    x, n, k = rng.standard_normal((1200, 16)), 300, 5
    x[900:930] = x[3]
    looked = []
    run = D._squares
    monkeypatch.setattr(D, "_squares", lambda a, i, b, j: looked.append(len(i)) or run(a, i, b, j))
    ids, who, core = rng.permutation(1200), rng.integers(0, 40, 1200), rng.uniform(1, 3, 1200)
    core[:400], who[600:] = 0.5, 7
    blocks = [tiled.Block(*(c[u : u + n].copy() for c in (ids, who, np.concatenate([x, core[:, None]], 1)))) for u in range(0, 1200, n)]
    state: dict = {}
    for a in range(4):
        for b in range(a, 4):
            D._least_edges(state, blocks[a], blocks[b], a == b)
    assert sum(looked) < 1200 * 1200 / 2 / 20
    w = np.maximum(np.maximum(D.distances(x, x), core[:, None]), core[None, :])
    i, j = np.nonzero(who[:, None] != who[None, :])
    for c, got in zip(state["comp"], zip(*(state[e] for e in D.EDGE))):
        own = who[i] == c
        want = min(zip(w[i[own], j[own]].round(9), np.minimum(ids[i[own]], ids[j[own]]), np.maximum(ids[i[own]], ids[j[own]]), who[j[own]]))
        assert (round(got[0], 9), *got[1:]) == want

    made: dict = {}

    def caught(samples, each, schema, size, within, finish):
        made.update(each=each, finish=finish)
        raise InterruptedError

    monkeypatch.setattr(tiled, "run_tiles", caught)
    try:
        D.core_distances(None, k)
    except InterruptedError:
        pass
    looked.clear()
    state, plain = {}, [tiled.Block(b.ids, b.who, b.v[:, :-1]) for b in blocks]
    for a in range(4):
        for b in range(a, 4):
            made["each"](state, plain[a], plain[b], a == b)
    assert sum(looked) < 1200 * 1200 / 2 / 5
    d = D.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = dict(zip(ids.tolist(), np.sort(d, 1)[:, k - 1]))
    got = {i: near[-1] for batch in made["finish"](state) for i, near in zip(*(batch.column(c).to_pylist() for c in ("sample_id", "near")))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_a_component_of_most_samples_does_not_meet_itself(spark, monkeypatch):
    """The tree is that of all pairs though later rounds leave out the greatest component's own tiles."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((150, 4)) * 0.1, rng.standard_normal((40, 4)) * 3 + 4])
    ids = rng.permutation(190).tolist()
    met, run = [], tiled.cross_cells
    monkeypatch.setattr(tiled, "cross_cells", lambda one, two, size: met.append((one.count(), two.count())) or run(one, two, size))
    got = sorted((round(r["w"], 9), r["i"], r["j"]) for r in D.spanning_tree(frame(spark, x, np.zeros(190), ids), size=16).collect())
    assert got == sorted((round(w, 9), i, j) for w, i, j in plain_tree(ids, x, 5))
    assert met and all(one < two and one + two == 190 for one, two in met)


def test_moments_of_the_rest_and_ends_of_both_sides():
    """Sides are told apart without a copy of the greater one; also where all pairs or none are of one identity."""
    rng = np.random.default_rng(3)
    state, xs, ps = {}, [], []
    for share in (0.0, 0.2, 1.0, 0.9, 0.5):
        x = rng.uniform(-1, 1, 500)
        pos = rng.random(500) < share
        tiled._moments(state, x, np.flatnonzero(pos))
        xs, ps = [*xs, x], [*ps, pos]
        every, own = np.concatenate(xs), np.concatenate(ps)
        for side in set(own.tolist()):
            y = every[own == side]
            n, s, ss, least, most = state[side]
            assert (n, least, most) == (len(y), y.min(), y.max()) and abs(s - y.sum()) < 1e-9 and abs(ss - (y * y).sum()) < 1e-9


def test_only_pairs_near_an_interval_become_ordinals(monkeypatch):
    """The same ordinals and intervals as of all pairs; of all others none is made."""
    rng = np.random.default_rng(9)
    x, who = rng.standard_normal((500, 8)), rng.integers(0, 4, 500)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = (tiled.Block(np.arange(250) + k, who[k : k + 250], x[k : k + 250].copy()) for k in (0, 250))
    los, his = (np.array(c) for c in zip(*(selection.bin_interval(k, 200) for k in (0, 60, 100, 101, 199))))
    made, run = [], selection.ordinals
    near = selection._touched(los, his)
    for p, q, same in ((a, b, False), (a, a, True)):
        for side in ("pos", "neg"):
            s = np.clip(p.v @ q.v.T, -1, 1)[np.triu_indices(250, 1) if same else (slice(None), slice(None))]
            own = (p.who[:, None] == q.who[None, :])[np.triu_indices(250, 1) if same else (slice(None), slice(None))]
            s = s[own == (side == "pos")].ravel()
            k = tiled.binned(s, 200, "floor")
            want = np.sort(s[np.isin(k, (0, 60, 100, 101, 199))])
            made.clear()
            monkeypatch.setattr(selection, "ordinals", lambda v: made.append(len(v)) or run(v))
            key, at = selection._inside(p, q, same, side, los, his, near)
            monkeypatch.setattr(selection, "ordinals", run)
            assert len(key) == len(want) and np.abs(np.sort(selection.scores_of(key)) - want).max(initial=0) < 1e-12
            assert (key >= los[at]).all() and (key <= his[at]).all() and sum(made) <= len(want) * 1.2 + 5 < len(s) / 4


def test_summary_packs_its_blocks_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, who = rng.standard_normal((120, 5)), rng.integers(0, 5, 120)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    laid, run = [], tiled.tiles
    monkeypatch.setattr(tiled, "tiles", lambda *a: laid.append(1) or run(*a))
    got = {r["is_pos"]: r for r in profile.score_summary(frame(spark, x, who)).collect()}
    i, j = np.triu_indices(120, 1)
    s, pos = (x @ x.T)[i, j], who[i] == who[j]
    for side in (True, False):
        y, r = s[pos == side], got[side]
        want = [y.mean(), y.std(), y.min(), y.max(), *np.quantile(y, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))]
        assert r["n"] == len(y) and all(abs(u - v) < 2e-6 for u, v in zip(tuple(r)[2:], want))
    assert len(laid) == 1
