"""Density clusters against a brute-force condensed tree, through rounds, slices and several trees at once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.operators import density


def brute_edges(x, k, m):
    d = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T))), 9)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    core = [d[i, order[i, m - 1]] for i in range(len(x))]
    return sorted({(max(d[i, j], core[i], core[j]), min(i, j), max(i, j)) for i in range(len(x)) for j in order[i, :k].tolist()})


def brute_labels(n, edges, least):
    """Top-down over a hierarchy kept as nested sets; independent of the bottom-up states of the operator."""
    group, tops = {i: frozenset([i]) for i in range(n)}, {}
    split = {}
    for w, u, v in edges:
        a, b = group[u], group[v]
        if a != b:
            whole = a | b
            split[whole] = (1 / max(w, 1e-9), a, b)
            for i in whole:
                group[i] = whole
    tops = set(group.values())

    def weigh(start, birth):
        """(excess, chosen sets inside or the cluster itself) of the cluster that begins as ``start``."""
        at, excess, members = start, 0.0, set(start)
        while True:
            density, a, b = split[at]
            big = [x for x in (a, b) if len(x) >= least]
            if len(big) == 2:
                excess += len(at) * (density - birth)
                inner = [weigh(x, density) for x in big]
                total = sum(i[0] for i in inner)
                return (excess, [members]) if excess >= total else (total, [s for i in inner for s in i[1]])
            if not big:
                excess += len(at) * (density - birth)
                return excess, [members]
            small = a if big[0] is b else b
            excess += len(small) * (density - birth)
            at = big[0]

    def inside(start):
        """Clusters chosen below the whole pool, which is none itself."""
        at = start
        while True:
            density, a, b = split[at]
            big = [x for x in (a, b) if len(x) >= least]
            if len(big) == 2:
                return [s for x in big for s in weigh(x, density)[1]]
            if not big:
                return []
            at = big[0]

    roots = [t for t in tops if len(t) >= least]
    found = inside(roots[0]) if len(roots) == 1 else [s for t in roots for s in weigh(t, 0.0)[1]]
    label = {i: None for i in range(n)}
    for s in found:
        for i in s:
            label[i] = min(s)
    return label


def clouds(seed, n=160, dims=6, centres=7):
    rnd = np.random.default_rng(seed)
    c = rnd.standard_normal((centres, dims)) * 2
    x = np.concatenate([c[rnd.integers(0, centres, n - 40)] + rnd.standard_normal((n - 40, dims)) * rnd.choice((0.05, 0.2, 0.4), (n - 40, 1)), rnd.standard_normal((40, dims))])
    x[3] = x[4]  # a repeated point
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def cloud(spark):
    x = clouds(1)
    return x, spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "node long, v array<double>, cluster string")


@pytest.mark.parametrize("few", [10**6, 30])
def test_grid_labels_equal_brute_force(cloud, few):
    x, df = cloud
    trees, sizes = [(0, 10, 1), (1, 15, 3), (2, 4, 2)], [10, 5, 3]
    near = density.neighbours(density.unit_vectors(df, "node", "v"), 15, block=60)
    edges = density.reachability(near, trees)
    got = {}
    for r in density.density_labels(df, edges, sizes, [0, 1, 2], few=few).collect():
        got[r.tree, r.size, r.node] = r.cluster
    assert len(got) == len(x) * 9
    kinds = set()
    for t, k, m in trees:
        e = brute_edges(x, k, m)
        for s in sizes:
            expected = brute_labels(len(x), e, s)
            assert {i: got[t, s, i] for i in range(len(x))} == expected, (t, s)
            kinds.add((len(set(expected.values()) - {None}) > 1, None in expected.values()))
    assert (True, True) in kinds


def test_neighbours_equal_brute_force_over_blocks(cloud):
    x, df = cloud
    d = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T))), 9)
    for block in (25, 10_000):
        got = sorted((r.u, r.rank, r.v) for r in density.neighbours(df.select("node", "v"), 4, block).collect())
        expected = []
        for i in range(len(x)):
            order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:4]
            expected += [(i, n + 1, j) for n, j in enumerate(order)]
        assert got == sorted(expected)


def test_spanning_forest_weighs_as_little_as_kruskals(spark):
    rnd = random.Random(3)
    rows = [(t, u, v, float(rnd.randint(1, 9))) for t in (0, 1) for u, v in {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(150)}]
    df = spark.createDataFrame(rows, "tree int, u long, v long, w double")
    one = {tuple(r) for r in density.spanning_trees(df).collect()}
    assert {tuple(r) for r in density.spanning_trees(df, few=5).collect()} == one
    assert len({(t, u, v) for t, u, v, _ in one}) == len(one)
    for t in (0, 1):
        up = {}

        def root(i, up=up):
            while i in up:
                i = up[i]
            return i

        total = 0
        for w, u, v in sorted((w, u, v) for tree, u, v, w in rows if tree == t):
            if root(u) != root(v):
                up[root(u)] = root(v)
                total += w
        assert total == sum(w for tree, _, _, w in one if tree == t)


def test_grid_and_seeds(spark):
    x = clouds(2, n=120, dims=20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    grid = density.cluster_grid(df, "vec_id", "embedding", k=(6, 9), sizes=(8, 5), samples=(1, 2), dims=None).collect()
    assert len({(r.n_neighbors, r.min_cluster_size, r.min_samples) for r in grid}) == 8
    for r in grid:
        label = brute_labels(len(x), brute_edges(x, r.n_neighbors, r.min_samples), r.min_cluster_size)
        own = [v for v in label.values() if v is not None]
        sizes = sorted((own.count(c) for c in set(own)), reverse=True)
        assert (r.n_clusters, r.noise, r.sizes) == (len(sizes), len(x) - len(own), sizes[:12])
        assert r.good == (6 <= len(sizes) <= 16 and (sizes[0] if sizes else 0) <= len(x) * 0.45)
    pairs = density.seed_stability(df, "vec_id", "embedding", min_cluster_size=5, min_samples=2, k=6, dims=8).collect()
    assert [(r.seed_a, r.seed_b) for r in pairs] == [(42, 43), (42, 44), (43, 44)] and all(-1 <= r.ari <= 1 for r in pairs)
    again = density.seed_stability(df, "vec_id", "embedding", seeds=(42, 42), min_cluster_size=5, min_samples=2, k=6, dims=8).first()
    assert again.ari == pytest.approx(1) and again.clusters_a == again.clusters_b > 0


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in density.density_clusters(df, "vec_id", "embedding").collect()) == [1, 7]
    assert density.density_clusters(df.limit(0), "vec_id", "embedding").count() == 0
    assert density.density_clusters(df, "vec_id", "embedding").where(F.col("cluster").isNotNull()).count() == 0


@pytest.mark.parametrize("copies", [1, 9])
def test_points_that_come_in_any_batches_are_measured_in_double(copies):
    rnd = np.random.default_rng(copies)
    x = np.repeat(clouds(5, n=1400 // copies, dims=5), copies, axis=0)
    x = np.concatenate([x, x[:40] + rnd.standard_normal((40, 5)) * 1e-6])  # nearer than single precision tells
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    node = rnd.permutation(len(x)) * 3
    near = density.Nearest(node[:900], x[:900], 6)
    for s, e in ((0, 700), (700, 703), (703, len(x))):
        near.add(node[s:e], x[s:e])
    got = {u: (v, d) for batch in near.found() for u, v, d in zip(*(batch[c].to_pylist() for c in ("u", "v", "d")), strict=True)}
    for i in range(900):
        d = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", np.broadcast_to(x[i], x.shape), x))), 9)
        order = [j for j in np.lexsort((node, d)).tolist() if j != i][:6]
        assert got[node[i]] == (node[order].tolist(), d[order].tolist())


def test_a_task_thins_edges_to_forests_of_each_tree():
    rnd = np.random.default_rng(8)
    batches, left = [], {0: [], 1: []}
    for _ in range(12):
        tree, ends, w = rnd.integers(0, 2, 40), rnd.integers(0, 50, (2, 40)), rnd.integers(1, 5, 40).astype(float)
        u, v = ends.min(axis=0), ends.max(axis=0) + 1
        batches.append(pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(u), pa.array(v), pa.array(w)], names=["tree", "u", "v", "w"]))
        for row in zip(tree.tolist(), w.tolist(), u.tolist(), v.tolist(), strict=True):
            left[row[0]].append(row[1:])

    def kruskal(edges):
        join, out = density.Union(), []
        for w, u, v in sorted(edges):
            if join.find(u) != join.find(v):
                join.put(u, v)
                out.append((w, u, v))
        return out

    for few in (10**6, 60):
        rows = [r for b in density.thinned(few)(iter(batches)) for r in zip(*(b[c].to_pylist() for c in ("tree", "w", "u", "v")), strict=True)]
        for tree, edges in left.items():
            own = [r[1:] for r in rows if r[0] == tree]
            assert len(own) < len(edges) and kruskal(own) == kruskal(edges)
            assert few < 100 or sorted(own) == kruskal(edges)


def test_outermost_clusters_in_one_task_and_in_rounds(spark):
    rnd = random.Random(2)
    rows = [(0, s, c, rnd.choice([*range(c + 1, 40, 3), None]), rnd.random() < 0.4) for s in (5, 8) for c in range(0, 40, 3)]
    rows = [(t, s, c, None if up is None else up - up % 3 if up - up % 3 > c else None, own) for t, s, c, up, own in rows]
    df = spark.createDataFrame(rows, "tree int, size int, cluster long, parent long, own boolean")
    one, many = (sorted(map(tuple, density.chosen(df, few).collect()), key=str) for few in (100, 3))
    above, own = {r[1:3]: r[3] for r in rows}, {r[1:3]: r[4] for r in rows}
    for t, s, c, top in one:
        line, at = [], c
        while at is not None:
            line.append(at)
            at = above[s, at]
        assert top == next((x for x in reversed(line) if own[s, x]), None)
    assert one == many and any(r[3] is None for r in one) and any(r[3] not in (None, r[2]) for r in one)
