"""Density clusters against a literal transcription of the published rule: tree, condensed tree from the top, excess of mass."""

import numpy as np

from pairscope import catalog
from pairscope.operators import density_clusters as D

SCHEMA = "sample_id long, identity long, v array<double>, path string"


def plain_tree(ids, x, k):
    d = D.distances(x, x)
    core = np.array([np.sort(np.delete(r, i))[min(k, len(x) - 1) - 1] for i, r in enumerate(d)])
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    edges = sorted((w[a, b], min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(x)) for b in range(a))
    own = {i: {i} for i in ids}
    tree = []
    for e in edges:
        a, b = own[e[1]], own[e[2]]
        if a is not b:
            tree.append(e)
            a |= b
            for i in b:
                own[i] = a
    return tree


def plain_clusters(ids, x, least, k):
    """From the top: a cluster's component is divided at its greatest edge, again and again; parts below ``least`` fall out."""
    tree = plain_tree(ids, x, k)
    stability, children, members = {}, {}, {}

    def component(edges, start):
        seen, todo = {start}, [start]
        near = {}
        for _, a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        while todo:
            for y in near.get(todo.pop(), []):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    def grow(name, points, edges, born):
        """Divides until two parts are large enough or none is."""
        members[name], children[name], stability[name] = set(points), [], 0.0
        while True:
            if not edges:
                return
            w, a, b = edges[-1]
            leave = 1 / max(w, D.SHORTEST)
            rest = edges[:-1]
            one, two = component(rest, a), component(rest, b)
            parts = [p for p in (one, two) if len(p) >= least]
            if len(parts) == 1:
                stability[name] += (len(one) + len(two) - len(parts[0])) * (leave - born)
                edges = [e for e in rest if e[1] in parts[0]]
                continue
            stability[name] += (len(one) + len(two)) * (leave - born)
            if len(parts) == 2:
                for p in parts:
                    child = (w, a, b, min(p))
                    children[name].append(child)
                    grow(child, p, [e for e in rest if e[1] in p], leave)
            return

    grow("top", ids, tree, 0.0)
    chosen = {}

    def best(name):
        below = sum(best(c) for c in children[name])
        chosen[name] = name != "top" and stability[name] >= below - 1e-9 * abs(below)
        return stability[name] if chosen[name] else below

    best("top")
    label = dict.fromkeys(ids, -1)

    def mark(name):
        if chosen[name]:
            label.update(dict.fromkeys(members[name], min(members[name])))
        else:
            for c in children[name]:
                mark(c)

    mark("top")
    return label


def planted(seed, groups=5, per=14, noise=12, dim=6, copies=4):
    rng = np.random.default_rng(seed)
    mid = rng.standard_normal((groups, dim)) * 3
    x = [m + rng.standard_normal(dim) * s for m, s in zip(mid, rng.uniform(0.1, 0.9, groups)) for _ in range(per)]
    x += list(rng.standard_normal((noise, dim)) * 4)
    x += [x[0]] * copies + [x[20]] * copies  # copies, also as many as make a cluster of their own
    x = np.array(x)
    return rng.permutation(len(x)).tolist(), x


def test_labels_equal_the_rule(spark):
    """Several blocks and several ranges of edges."""
    ids, x = planted(1)
    samples = spark.createDataFrame([(i, 0, v.tolist(), "p") for i, v in zip(ids, x)], SCHEMA).repartition(3)
    want = plain_clusters(ids, x, 5, 5)
    assert {r["sample_id"]: r["cluster"] for r in D.density_clusters(samples, size=16, chunk=30).collect()} == want
    assert len(set(want.values())) > 3 and -1 in want.values()


def test_tree_equals_a_plain_one(spark):
    ids, x = planted(7)
    samples = spark.createDataFrame([(i, 0, v.tolist(), "p") for i, v in zip(ids, x)], SCHEMA)
    got = sorted((round(r["w"], 9), r["i"], r["j"]) for r in D.spanning_tree(samples, size=16).collect())
    assert got == sorted((round(w, 9), i, j) for w, i, j in plain_tree(ids, x, 5))


def test_groups_never_meet(spark):
    """Two planted groups, one without any structure, copies of one vector, and five samples, which have no rows."""
    rng = np.random.default_rng(0)
    parts = [planted(4, groups=3, per=9), planted(5, groups=2, per=8), (list(range(40)), rng.standard_normal((40, 6)) * 0.01), (list(range(30)), np.full((30, 6), 0.5)), (list(range(5)), np.eye(5, 6))]
    rows, want = [], {}
    for g, (ids, x) in enumerate(parts):
        ids = [1000 * g + i for i in ids]
        rows += [(i, g, v.tolist(), "p") for i, v in zip(ids, x)]
        if g < 4:
            want |= plain_clusters(ids, x, 5, 5)
    samples = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r["sample_id"]: r["cluster"] for r in D.density_clusters(samples, within=True, size=16, chunk=100).collect()} == want
    assert D.density_clusters(samples.where("false")).count() == 0


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = plain_clusters([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), 5, 5)
    assert {r["sample_id"]: r["cluster"] for r in catalog.queries()["density_clusters"](spark, sf).collect()} == want
