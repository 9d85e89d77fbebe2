"""Tree search and MaxScore against brute force."""

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm import ann, maxscore

NAN, INF = float("nan"), float("inf")


def table(spark, n=600, dims=12, seed=0, hot=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * rng.uniform(0.2, 2.0, size=(n, 1))
    x[: int(hot * n)] = x[0] + rng.normal(size=(int(hot * n), dims)) * 0.01
    if n > 7:
        x[5] = x[6] = x[7]
    x = x.astype(np.float32)
    rows = [(int(i), [float(c) for c in v], "clash") for i, v in enumerate(x)]
    bad = [(n, None, "c"), (n + 20, [NAN] * dims, "c"), (n + 40, [INF, *[0.0] * (dims - 1)], "c"), (n + 60, [None, *[1.0] * (dims - 1)], "c"), (None, [1.0] * dims, "c"), (n + 80, [], "c")]
    return x.astype(float), spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, vector string"), rows


def brute(x, q, k):
    s = x[q] @ x.T
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[: min(k, len(x) - 1)], s


def test_tree_search(spark):
    x, df, _ = table(spark)
    zero = spark.createDataFrame([(10_000, [0.0] * 12, "z")], "vec_id long, embedding array<float>, vector string")
    found, info = ann.search_tree(df.unionByName(zero), F.col("vec_id") % 20 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 600, 20)) and info["recall"] >= 0.9
    hit = total = 0
    for q, own in got.items():
        want, s = brute(x, q, 20)
        assert sorted(own) == list(range(1, 21))
        for rank in own:
            v, score = own[rank]
            assert abs(score - s[v]) < 1e-9
        assert [own[i][0] for i in range(1, 21)] == sorted((v for v, _ in own.values()), key=lambda v: (-s[v], v))
        hit += len({v for v, _ in own.values()} & set(want.tolist()))
        total += len(want)
    assert hit / total >= 0.9


def test_tree_search_of_few(spark):
    x, df, rows = table(spark, n=7, hot=0)
    found, _ = ann.search_tree(df.where("vec_id < 7"), F.col("vec_id") % 20 == 0)
    assert [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]
    assert ann.search_tree(df.limit(0), F.col("vec_id") % 20 == 0)[0].count() == 0


def test_tree_search_opens_leaves_until_the_answer_is_full(spark, monkeypatch):
    monkeypatch.setattr(ann, "_calibrate", lambda *a: (1, 1.0))
    rng = np.random.default_rng(9)
    x = np.eye(8)[np.arange(600) % 6] * 5 + rng.normal(size=(600, 8)) * 0.01
    x[[0, 1, 2, 40]] = np.eye(8)[7] * 5 + rng.normal(size=(4, 8)) * 0.01  # a leaf of its own
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[40].tolist())]
    found, info = ann.search_tree(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert info["leaves"] > 1
    got = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert got == {q: 20 for q in range(0, 600, 20)}


def test_vectors_of_other_lengths_take_part(spark):
    x, df, rows = table(spark, n=60, hot=0)
    wide = np.concatenate((x, np.zeros((60, 3))), axis=1)
    more = np.stack((np.ones(15), np.concatenate(([2.0], np.zeros(14)))))
    whole = np.concatenate((wide, more))
    both = df.where("vec_id < 60").select("vec_id", "embedding").unionByName(spark.createDataFrame([(60, [1.0] * 15), (61, [2.0])], "vec_id long, embedding array<float>"))
    for exact in (False, True):
        k, data = (10, np.floor(1024 * whole)) if exact else (20, whole)
        asks = F.col("vec_id") % 20 == 0
        found = maxscore.search_exact(both, asks) if exact else ann.search_tree(both, asks, recall=1.0)[0]
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == {q: brute(data, q, k)[0].tolist() for q in (0, 20, 40, 60)}


def test_maxscore_is_exact(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 150)
    monkeypatch.setattr(maxscore, "SEED", 20)
    x, df, _ = table(spark, seed=3)
    q = np.floor(1024 * x)
    got = {}
    for r in maxscore.search_exact(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 10))
    for i, own in got.items():
        want, s = brute(q, i, 10)
        assert sorted(own) == [(n + 1, int(v), int(s[v])) for n, v in enumerate(want)]


def test_maxscore_of_few_and_zero(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.5, -0.5]), (100, [-0.0004, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    rows = maxscore.search_exact(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == 0] == [(0, 1, 1, 0), (0, 2, 100, 0), (0, 3, 100, 0)]
    assert maxscore.search_exact(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_equal_vectors_tie_whatever_their_place():
    rnd = np.random.default_rng(3)
    for trial in range(40):
        x = rnd.standard_normal((200, 37))
        x[rnd.choice(200, 60, replace=False)] = x[0]  # copies side by side and apart
        ids = rnd.permutation(200) + 7
        q = rnd.standard_normal((5, 37)) if trial % 2 else np.repeat(x[:1], 5, axis=0)
        asking = np.array([1, 2, 3, int(ids[0]), int(ids[5])])
        row, col, score = ann.finalists(ids, x, asking, q, 30)
        for i in range(5):
            exact = []
            for j in range(200):
                total = 0.0
                for a, b in zip(q[i].tolist(), x[j].tolist()):
                    total += a * b
                if ids[j] != asking[i]:
                    exact.append((-total, int(ids[j])))
            assert [(-s, int(ids[c])) for c, s in zip(col[row == i], score[row == i])] == sorted(exact)[:30]


def test_products_that_overflow_are_candidates(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1.0, 1.0]), (3, [-1e200, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search_tree(df, F.col("vec_id") == 0, k=5)[0].orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, float("inf")), (2, 1e200), (3, float("-inf"))]


def test_large_components_are_summed_exactly(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rnd.uniform(-1, 1, 4) * 10.0 ** rnd.integers(0, 10, 4)]) for i in range(60)] + [(100, [100000.3, 100000.3, 0.0, 1.0]), (101, [1e9, -1e9, 1e9, 1.0]), (102, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in maxscore.search_exact(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    import math

    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in got:
        scores = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(ints[q], ints[i])))), i) for i in ints if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
