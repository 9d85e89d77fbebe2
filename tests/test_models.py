"""Uniformity, least squares, ranks by weight, depths, file order, gates and matching by rare words."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions import stats
from assaykit.operators import bootstrap, gates, matching, records
from assaykit.sources import files


def test_kolmogorov_against_known_values(spark):
    # the limiting distribution's upper tail at x, from published tables
    known = [(0.5, 0.963945), (0.8, 0.544142), (1.0, 0.270000), (1.1, 0.177718), (1.2, 0.112250), (1.3581, 0.049999), (1.62762, 0.010000), (2.0, 0.000671)]
    got = spark.createDataFrame([(x, 1) for x, _ in known], "d double, n long").select(stats.kolmogorov("d", "n").alias("p")).collect()
    for r, (x, p) in zip(got, known):
        assert r.p == pytest.approx(p, abs=1.5e-6), x
    ends = spark.createDataFrame([(0.0, 9), (0.001, 4), (1.0, 10_000)], "d double, n long").select(stats.kolmogorov("d", "n").alias("p")).collect()
    assert [r.p for r in ends] == [1.0, 1.0, 0.0]


def test_values_against_the_uniform_distribution(spark):
    rnd = random.Random(1)
    rows = [("even", i / 50 + 0.01) for i in range(50)] + [("early", rnd.choice((0.0, 0.1, 0.2, 0.95))) for _ in range(60)] + [("late", 1.0)] * 3 + [("late", None)]
    got = {r.g: r for r in stats.against_uniform(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    for g, r in got.items():
        x = sorted(v for k, v in rows if k == g and v is not None)
        n = len(x)
        d = max(max((i + 1) / n - v, v - i / n) for i, v in enumerate(x))
        assert (r.n, r.d, r.mean) == (n, pytest.approx(d), pytest.approx(sum(x) / n))
        assert r.deciles == [sum(min(9, int(v * 10)) == i for v in x) for i in range(10)]
        assert r["first"] == pytest.approx(sum(v < 0.3 for v in x) / n) and r["last"] == pytest.approx(sum(v >= 0.7 for v in x) / n)
    assert (got["even"].skew, got["early"].skew, got["late"].skew) == ("roughly uniform", "early", "late") and got["even"].p > 0.9 > 0.05 > got["early"].p


def test_least_squares(spark):
    rnd = np.random.default_rng(2)
    x = rnd.uniform(1, 9, (60, 3))
    y = x @ [2.0, -0.5, 7.0] + rnd.normal(0, 0.1, 60)

    def solved(x, y):
        cols = {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}
        sums = {f"{p}_{q}": float(cols[p] @ cols[q]) for i, p in enumerate(cols) for q in list(cols)[i:]}
        return stats.least_squares(spark.createDataFrame([tuple(sums.values())], ", ".join(f"{k} double" for k in sums)), ["a", "b", "c"], "y").first()

    r = solved(x, y)
    assert [r.c_a, r.c_b, r.c_c] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0].tolist(), rel=1e-8)
    x[:, 2] = x[:, 0] + 2 * x[:, 1]  # no single answer
    assert [solved(x, y)[c] for c in ("c_a", "c_b", "c_c")] == [None] * 3
    assert solved(x[:0], y[:0])["c_a"] is None


def test_weighted_ranks_are_those_of_repeated_rows(spark):
    rnd = random.Random(3)
    cells = [(g, x, y, rnd.randint(1, 4)) for g in (1, 2) for x in range(3) for y in range(4) if rnd.random() < 0.8] + [(3, 1, 1, 5), (4, 1, 2, 1), (4, 2, 1, 1)]
    got = {r.g: r for r in bootstrap.weighted_spearman(spark.createDataFrame([(g, x, y, float(w)) for g, x, y, w in cells], "g int, x int, y int, w double"), ["g"], "x", "y", "w").collect()}
    for g in (1, 2):
        rows = [(x, y) for k, x, y, w in cells if k == g for _ in range(w)]

        def ranks(values):
            order = sorted(values)
            return [order.index(v) + (order.count(v) + 1) / 2 for v in values]

        a, b = np.array(ranks([x for x, _ in rows])), np.array(ranks([y for _, y in rows]))
        assert got[g].rho == pytest.approx(np.corrcoef(a, b)[0, 1]) and got[g].n == len(rows)
    assert got[3].rho is None and got[4].rho is None


def test_depths(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 5), (6, 5), (7, 99), (8, 7), (10, 11), (11, 10), (12, 10), (3, 2)]
    got = {r.k: (r.root, r.depth) for r in records.depths(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (5, 1), 7: (7, 0), 8: (7, 1)}
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 300)] + [(0, None)], "k long, p long")
    assert records.depths(chain, "k", "p").agg(F.max("depth"), F.count_if(F.col("depth") == F.col("k"))).first()[:] == (299, 300)


def test_the_last_line_of_a_key_wins_over_split_files(spark, tmp_path):
    rnd, last = random.Random(4), {}
    for n in range(3):
        lines = []
        for _ in range(400):
            row = {"key": f"k{rnd.randrange(50)}", "v": rnd.randrange(10**6), "w": "x" * rnd.randrange(200)}
            lines.append(json.dumps(row))
            last[row["key"]] = row["v"]
        lines.insert(5, "")
        (tmp_path / f"part-{n}.json").write_text("\n".join(lines) + ("\n{\"key\": \"k1\", \"v\": 1" if n == 2 else "\n"))  # a torn end
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        schema = T.StructType.fromDDL("key string, v long, w string")
        assert files.lines_in_order(spark, str(tmp_path)).select("file", "block").distinct().count() > 6
        got = {r.key: r.v for r in files.last_lines(spark, str(tmp_path), schema, ["key"]).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == last


def test_gates_publish_all_or_nothing(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), F.when(F.col("id") > 7, F.col("id")).alias("late"))
    causes = {"odd": F.col("id") % 2 == 1, "late": F.col("late") > 7}
    with pytest.raises(gates.GateError) as e:
        gates.release(df, causes, {"many": lambda n: n["kept"] > 5, "read": lambda n: n["read"] == 10}, f"{tmp_path}/out")
    assert e.value.failed == ["many"] and e.value.counts == {"read": 10, "kept": 4, "odd": 5, "late": 1}
    assert list(tmp_path.iterdir()) == []
    assert gates.release(df, causes, {"some": lambda n: n["kept"] == 4}, f"{tmp_path}/out") == {"read": 10, "kept": 4, "odd": 5, "late": 1}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6] and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(FileExistsError):
        gates.release(df, causes, {}, f"{tmp_path}/out")
    report = {(r.version, r.cause): (r.n, r.all_failing) for r in gates.cause_report(df, {"one": causes, "two": {"none": F.lit(None).cast("boolean")}}).collect()}
    assert report == {("one", "odd"): (5, 5), ("one", "late"): (1, 2), ("one", "kept"): (4, 0), ("two", "none"): (0, 0), ("two", "kept"): (10, 0)}


def test_matches_are_those_of_all_pairs(spark):
    rnd = random.Random(7)
    vocabulary = ["the", "of", "and"] * 12 + [f"w{i}" for i in range(60)]
    refs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 25)))) for i in range(40)] + [(40, ""), (41, None)]
    notes = [(i, " ".join(rnd.choices([*vocabulary, "unseen"], k=rnd.randint(1, 12)))) for i in range(40)] + [(40, refs[3][1]), (41, None)]
    docs = {i: Counter(t.split()) for i, t in refs if t}
    n, df = 41, Counter(w for c in docs.values() for w in c)
    idf = lambda w: math.log(n / (1 + df[w])) + 1 if w in df else math.log(n) + 1

    def vector(c):
        v = {w: k * idf(w) for w, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    a, b = {i: vector(Counter(t.split())) for i, t in notes if t}, {i: vector(c) for i, c in docs.items()}
    frames = [spark.createDataFrame(x, f"{k} long, t string") for x, k in ((notes, "n"), (refs, "r"))]
    for least in (0.15, 0.5, 0.9):
        expected = {(i, j): sum(x * b[j].get(w, 0) for w, x in a[i].items()) for i in a for j in b}
        expected = {p: x for p, x in expected.items() if x >= least}
        got = {(r.n, r.r): r.cosine for r in matching.cosine_matches(*frames, "n", "r", "t", least).collect()}
        assert got == {p: pytest.approx(x) for p, x in expected.items()} and expected
    items = {i: set(t.split()) for i, t in refs if t}
    for least in (0.1, 0.28, 0.7):
        expected = {}
        for i, words in items.items():
            for j, t in notes:
                share = sum(idf(w) for w in words if t and w in t.split()) / sum(map(idf, words))
                if share >= least:
                    expected[i, j] = pytest.approx(share)
        got = {(r.r, r.n): r.share for r in matching.contained(frames[1], frames[0], "r", "n", "t", least).collect()}
        assert got == expected and expected


def test_cosines_of_blocks_are_those_of_all_pairs(spark):
    rnd = np.random.default_rng(4)
    a, b = (np.where(rnd.random((n, 50)) < rnd.choice((0.02, 0.9), 50), rnd.random((n, 50)), 0) for n in (23, 31))
    sides = [(len(x), *np.nonzero(x), x[np.nonzero(x)]) for x in (a, b)]
    got = {(i, j): x for part in matching.products(*sides, 0.7, tile=7) for i, j, x in zip(*(c.tolist() for c in part), strict=True)}
    assert got == {(i, j): pytest.approx((a @ b.T)[i, j]) for i, j in zip(*np.nonzero(a @ b.T >= 0.7), strict=True)}
    assert 0 < len(got) < 23 * 31
    texts = [(i, " ".join(["all", "some" if i % 3 else "other", *(f"w{rnd.integers(0, 9)}" for _ in range(4))])) for i in range(60)]
    df = spark.createDataFrame([*texts, (None, "all some")], "n long, t string")
    one, many = (matching.cosine_matches(df, df.withColumnRenamed("n", "r"), "n", "r", "t", 0.2, block=block, tile=tile) for block, tile in ((10**6, 10**6), (13, 5)))
    rows = {(x.n, x.r): pytest.approx(x.cosine) for x in one.collect()}
    assert rows == {(x.n, x.r): x.cosine for x in many.collect()} and len(rows) > 1000
    # nearly all pairs reach the gate: no row of a pair and a word is made to find them
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    # nor to find what holds an item
    items = df.where("n < 7").withColumnRenamed("n", "r")
    one, many = (matching.contained(items, df, "r", "n", "t", 0.3, block=block, tile=tile) for block, tile in ((10**6, 10**6), (13, 5)))
    rows = {(x.n, x.r): pytest.approx(x.share) for x in one.collect()}
    assert rows == {(x.n, x.r): x.share for x in many.collect()} and len(rows) > 100
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
