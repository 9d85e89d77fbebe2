"""Statistics, samples and metrics on literal tables: golden values, properties, and guards for odd input."""

import hashlib
import math
import random
from math import comb

import pytest
from pyspark.sql import functions as F

from assaykit.functions import replies, stats, text
from assaykit.operators import aggregate, bootstrap, decisions, metrics, notes, provenance, records, sampling
from assaykit.operators.numbering import numbered, ranked, running


def one(spark, row, **columns):
    return spark.createDataFrame([row]).select(*(c.alias(n) for n, c in columns.items())).first()


def test_wilson(spark):
    low, high = stats.wilson("k", "n")
    r = spark.createDataFrame([(177, 565), (0, 10), (10, 10), (0, 0)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert r[0]["l"] == pytest.approx(0.276, abs=5e-4) and r[0]["h"] == pytest.approx(0.353, abs=5e-4)
    assert r[1]["l"] == 0 and r[2]["h"] == pytest.approx(1) and r[2]["h"] <= 1 and r[3]["l"] is None


def test_binomial_and_holm(spark):
    cases = [(b, c) for b in range(8) for c in range(8)] + [(40, 60)]
    df = spark.createDataFrame(cases, "b long, c long").withColumn("p", stats.binomial_two_sided("b", "c"))
    for r in df.collect():
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
        assert r["p"] == pytest.approx(want)
    h = stats.holm(spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.9)], "fam string, name string, p double"), "p", "fam", "name")
    assert {(r["fam"], r["name"]): round(r["p_holm"], 6) for r in h.collect()} == {("f", "a"): 0.03, ("f", "c"): 0.06, ("f", "b"): 0.06, ("g", "a"): 0.9}


def test_fisher(spark):
    def exact(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        p = {x: comb(row, x) * comb(n - row, col - x) / comb(n, col) for x in range(max(0, row + col - n), min(row, col) + 1)}
        return min(1, sum(v for v in p.values() if v <= p[a] * (1 + 1e-9))), sum(v for x, v in p.items() if x >= a)

    tables = [(1, 9, 11, 3), (0, 0, 0, 0), (5, 0, 0, 5), (3, 3, 3, 3), (0, 4, 2, 7)]
    two, right = stats.fisher("a", "b", "c", "d")
    for r in spark.createDataFrame(tables, "a long, b long, c long, d long").select("*", two.alias("t"), right.alias("r")).collect():
        t, g = exact(r["a"], r["b"], r["c"], r["d"])
        assert r["t"] == pytest.approx(t) and r["r"] == pytest.approx(g)


def test_kappa(spark):
    def kappa(rows):
        return stats.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"]

    assert kappa([("x", "x"), ("y", "y")]) == pytest.approx(1)
    assert kappa([("x", "y"), ("y", "x")]) == pytest.approx(-1)
    assert kappa([("x", "x"), ("x", "x")]) is None
    rnd = random.Random(1)
    assert abs(kappa([(rnd.choice("pqr"), rnd.choice("pqr")) for _ in range(3000)])) < 0.05


def test_two_proportions_and_rand(spark):
    df = spark.createDataFrame([(5, 10, 5, 10), (0, 10, 0, 10), (9, 10, 1, 10)], "a long, b long, c long, d long").select(stats.two_proportion_z("a", "b", "c", "d").alias("z"))
    z = [r["z"] for r in df.collect()]
    assert z[0] == 0 and z[1] is None and z[2] == pytest.approx(0.8 / math.sqrt(0.5 * 0.5 * 0.2))
    same = spark.createDataFrame([(i % 3, i % 3 + 7) for i in range(30)], "a int, b int")
    assert stats.adjusted_rand(same, "a", "b").first()["ari"] == pytest.approx(1)


def test_winsorized(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randint(0, 10) for _ in range(8)]) for i in range(50)] + [(50, [1, 5, 9]), (51, [4])]
    df = spark.createDataFrame(rows, "i int, s array<int>")
    for r in df.select("s", aggregate.winsorized(F.col("s")).alias("m")).collect():
        s = sorted(r["s"])
        want = sum([s[1], *s[1:-1], s[-2]]) / len(s) if len(s) >= 4 else sum(s) / len(s)
        assert r["m"] == pytest.approx(want)
    with pytest.raises(Exception, match="samples wanted"):
        df.select(aggregate.winsorized(F.col("s"), exact=8)).collect()


def test_cell_rules(spark):
    rows = [([7], "score", 1, True), ([8], "score", 1, False), ([8] * 8, "score", 8, False), ([7] * 8, "score", 8, True), ([10, 0], "bin", 2, True), ([10, 10, 0], "bin", 3, False), ([None], "score", 1, None)]
    df = spark.createDataFrame(rows, "s array<int>, f string, k int, want boolean")
    value, flag = aggregate.cell(F.col("s"), F.col("f"), F.col("k"))
    assert all(r["got"] == r["want"] for r in df.select("want", flag.alias("got")).collect())


def test_panels(spark):
    votes = [("a", "1", True), ("a", "2", True), ("b", "1", True), ("b", "2", False), ("b", "3", False), ("c", "1", True), ("c", "2", False), ("d", "1", True)]
    got = {r["i"]: (r["is_real"], r["decided_by"]) for r in aggregate.panel(spark.createDataFrame(votes, "i string, role string, v boolean"), ["i"], "role", "v", ("1", "2"), "3").collect()}
    assert got == {"a": (True, "skeptics"), "b": (False, "tiebreak"), "c": (None, "incomplete"), "d": (None, "incomplete")}
    fields = spark.createDataFrame([("x", True, None), ("x", False, None), ("x", True, None)], "i string, f boolean, g boolean")
    assert aggregate.field_majority(fields, ["i"], ["f", "g"], True).first()["passes"] is True
    assert aggregate.field_majority(fields, ["i"], ["f", "g"], False).first()["passes"] is False
    grade, disputed = aggregate.consensus(F.col("a"), F.col("b"), ("low", "mid", "high"))
    rows = spark.createDataFrame([("high", "low"), ("mid", "mid"), (None, "low")], "a string, b string").select(grade.alias("g"), disputed.alias("d")).collect()
    assert [(r["g"], r["d"]) for r in rows] == [("low", True), ("mid", False), (None, None)]
    low = spark.createDataFrame([(3, 5), (None, 1)], "a int, b int").select(aggregate.lowest(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r["l"] for r in low] == [3, None]


def scores(spark, n=400, seed=2, shift=0, factor=1):
    rnd = random.Random(seed)
    return [(i % 2 == 0, factor * (rnd.randint(0, 10) - (i % 2 == 0)) + shift) for i in range(n)]


def test_auc_and_sweeps_by_brute_force(spark):
    rows = scores(spark)
    counts = metrics.score_counts(spark.createDataFrame([("g", *r) for r in rows], "g string, p boolean, s int"), ["g"], "s", F.col("p"))
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    want = sum((a < b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.auc(counts, ["g"]).first()["auc"] == pytest.approx(want)
    for r in metrics.sweep(counts, ["g"], "both").collect():
        rule = (lambda s, t=r["threshold"]: s < t) if r["side"] == "at" else (lambda s, t=r["threshold"]: s <= t)
        assert r["det"] == pytest.approx(sum(map(rule, pos)) / len(pos)) and r["fa"] == pytest.approx(sum(map(rule, neg)) / len(neg))
    strict = metrics.sweep(counts, ["g"]).count()
    assert strict == len(set(pos + neg)) + 1


def test_best_point_ignores_shift_and_scale(spark):
    out = []
    for shift, factor in ((0, 1), (5, 1), (0, 3)):
        rows = scores(spark, seed=9, shift=shift, factor=factor)
        counts = metrics.score_counts(spark.createDataFrame([("g", *r) for r in rows], "g string, p boolean, s int"), ["g"], "s", F.col("p"))
        best = metrics.best_at(metrics.sweep(counts, ["g"], "inclusive"), ["g"], 0.2).first()
        out.append((best["det"], best["fa"]))
    assert out[0] == out[1] == out[2] and out[0][1] <= 0.2
    none = metrics.score_counts(spark.createDataFrame([("g", True, None)], "g string, p boolean, s int"), ["g"], "s", F.col("p"))
    assert metrics.sweep(none, ["g"]).count() == 0


def test_paired_swap(spark):
    rnd = random.Random(4)
    rows = [("g", rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(60)]
    a = metrics.paired(spark.createDataFrame(rows, "g string, score int, clean_score int"), ["g"]).first()["paired"]
    b = metrics.paired(spark.createDataFrame([(g, y, x) for g, x, y in rows], "g string, score int, clean_score int"), ["g"]).first()["paired"]
    assert a + b == pytest.approx(1)
    ties = metrics.paired(spark.createDataFrame([("g", 3, 3)] * 4, "g string, score int, clean_score int"), ["g"]).first()
    assert ties["paired"] == 0.5 and ties["ties"] == 4


def test_bootstrap(spark):
    few = spark.createDataFrame([(1, 1, 2)], "c int, num int, den int")
    r = bootstrap.bootstrap(few, "c", "num", "den", draws=30).first()
    assert r["low"] is None and r["estimate"] == 0.5
    many = spark.createDataFrame([(i, i % 3, 3) for i in range(90)], "c int, num int, den int")
    r = bootstrap.bootstrap(many, "c", "num", "den", draws=150).first()
    assert r["low"] < r["estimate"] < r["high"] and r["valid"] == 150
    again = bootstrap.bootstrap(many.repartition(7), "c", "num", "den", draws=150).first()
    assert (again["low"], again["high"]) == (r["low"], r["high"])


def test_records(spark):
    log = spark.createDataFrame([("k", 1, 1), ("k", 2, 2), ("k", 2, 3), ("m", 5, 4)], "key string, t int, seq int")
    newest = records.newest(log, ["key"], [F.desc("t"), F.desc("seq")])
    assert sorted(r["seq"] for r in newest.collect()) == [3, 4]
    assert records.newest(log.unionByName(log).distinct(), ["key"], [F.desc("t"), F.desc("seq")]).count() == 2
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 2)], "k string, v int")
    assert {(r["k"], r["v"]) for r in records.first_source([a, b], ["k"]).collect()} == {("x", 1), ("y", 2)}
    left = spark.createDataFrame([("p", 1, "h1"), ("q", 2, "h9"), ("r", 3, "h9")], "g string, i int, h string")
    right = spark.createDataFrame([("p", "h1", "sure"), ("q", "h2", "lone"), ("r", "h3", "a"), ("r", "h4", "b")], "g string, h string, val string")
    joined = {r["g"]: (r["val"], r["via"]) for r in records.hashed_then_unique(left, right, ["g", "h"], ["g"], "val").collect()}
    assert joined == {"p": ("sure", "key"), "q": ("lone", "count"), "r": (None, None)}
    names = spark.createDataFrame([("x",), ("z",)], "k string")
    assert records.allowed(b, names, "k").count() == 1 and records.missing(names, b, "k").first()["k"] == "z"


def test_numbering(spark):
    rnd = random.Random(5)
    keys = rnd.sample(range(10**6), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for part in (7, 60, 10_000):
        assert [r["k"] for r in numbered(df, "k", "i", part).orderBy("i").collect()] == sorted(keys)
        assert numbered(df, "k", "i", part).agg(F.max("i")).first()[0] == 499
    assert numbered(df.limit(0), "k", "i").count() == 0


def test_ranks_in_hot_groups(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(40)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x int, i long")
    want = {}
    for g in ("a", "b", None):
        of = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (n, len(of)) for n, r in enumerate(of, 1)}
    for part in (5, 90, 10_000):
        got = ranked(df, ["g"], [F.col("x"), F.col("i")], F.col("x"), "r", "n", part).collect()
        assert {r["i"]: (r["r"], r["n"]) for r in got} == want and len(got) == 600
    assert ranked(df.limit(0), ["g"], [F.col("x")], F.col("x"), "r").count() == 0
    sums = {}
    for g in ("a", "b", None):
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            sums[r[2]] = total = total + r[2]
    for part in (5, 90, 10_000):
        got = running(df, ["g"], [F.col("x"), F.col("i")], F.col("x"), "i", "s", part).collect()
        assert {r["i"]: r["s"] for r in got} == sums and len(got) == 600


def test_apportion(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 50), ("c", 49)], "s string, n long")
    seats = {r["s"]: r["seats"] for r in sampling.apportion(rows, "s", "n", 10).collect()}
    assert sum(seats.values()) == 10 and all(seats[r["s"]] <= r["n"] for r in rows.collect())
    capped = {r["s"]: r["seats"] for r in sampling.apportion(rows, "s", "n", 100).collect()}
    assert capped == {"a": 1, "b": 50, "c": 49}
    tie = spark.createDataFrame([("a", 5), ("b", 5)], "s string, n long")
    assert {r["s"]: r["seats"] for r in sampling.apportion(tie, "s", "n", 1).collect()} == {"a": 1, "b": 0}
    assert {r["s"]: r["seats"] for r in sampling.apportion(tie, "s", "n", 1, "desc").collect()} == {"a": 0, "b": 1}
    parts = [r["part"] for r in sampling.terciles(spark.createDataFrame([(i,) for i in range(7)], "i int"), [F.col("i")], [], F.col("i")).orderBy("i").collect()]
    assert parts == [i * 3 // 7 + 1 for i in range(7)]


def test_text_functions(spark):
    rows = [("Score: 4 then score: 9. Verdict: pass Verdict: FAIL", 9, "FAIL"), ("Score: 77", None, None), (None, None, None), ("", None, None)]
    got = spark.createDataFrame([(t,) for t, _, _ in rows], "t string").select(text.score(F.col("t")).alias("s"), text.verdict(F.col("t")).alias("v")).collect()
    assert [(r["s"], r["v"]) for r in got] == [(s, v) for _, s, v in rows]
    js = [('x {"score": 3} y', 3), ('{"score": 99} Score: 5', None), ("{broken Score: 5", 5), ('{"score": "7"}', 7)]
    assert [r["s"] for r in spark.createDataFrame([(t,) for t, _ in js], "t string").select(text.json_score(F.col("t")).alias("s")).collect()] == [s for _, s in js]
    sh = spark.createDataFrame([("a b c d",), ("a b",), ("",), (None,), ("a a a a a",)], "t string").select(text.shingles(F.col("t"), 3).alias("s")).collect()
    assert [r["s"] for r in sh] == [["a b c", "b c d"], ["a b"], [], None, ["a a a"]]
    leak = spark.createDataFrame([("x" * 130, "y" + "x" * 200), ("short", "short"), ("a" * 60 + "b" * 80, "a" * 60 + "b" * 20)], "t string, o string").select(text.leaks(F.col("t"), F.col("o")).alias("l")).collect()
    assert [r["l"] for r in leak] == [True, False, False]


def test_places_of_quotes(spark):
    long = "the patient was walking " * 5
    cases = [("The Quick fox", "quick  FOX", "exact"), ("alpha1 beta", "gamma unique alpha1", "unique_word"), ("alpha1 alpha1", "alpha1 x", "word"), ("x", None, "no_quote"), ("x", "N/A", "no_quote"), ("alpha", "other words", "not_found")]
    cases += [(long, long[:90] + "q", "prefix80"), (long, long[:60] + "q", "prefix50"), (long, long[:35] + "q", "prefix30"), (None, "x", "no_quote")]
    where = spark.createDataFrame([c[:2] for c in cases], "t string, q string").select(notes.locate(F.col("t"), F.col("q")).alias("l")).collect()
    assert [r["l"]["how"] for r in where] == [c[2] for c in cases]
    assert where[0]["l"]["position"] == 4 / 13 and where[3]["l"]["position"] is None


def test_units(spark):
    t = ["Head:\nOne  two. Three (x). 4 y? no", "e\u0301. A", "", None, "Plan: go home. Now"]
    got = [r["u"] for r in spark.createDataFrame([(x,) for x in t], "t string").select(text.units(text.composed(F.col("t"))).alias("u")).collect()]
    assert got == [["Head:", "One two.", "Three (x).", "4 y? no"], ["\u00e9.", "A"], [], None, ["Plan: go home.", "Now"]]


def test_groups_of_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [2.0, 0.01]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 1.0]), (2, 4, None)]
    df = spark.createDataFrame(rows, "note int, id int, v array<double>")
    got = {(r["note"], r["level"]): (r["items"], r["groups"]) for r in notes.cosine_groups(df, ["note"], "id", "v").collect()}
    assert got[1, 0.9] == (3, 2) and got[2, 0.8] == (1, 1)
    medoid = {r["note"]: r["id"] for r in notes.medoids(df, "note", "id", "v").collect()}
    assert medoid == {1: 1, 2: 3}
    items = spark.createDataFrame([("n", 1, "a b c"), ("n", 2, "a b d"), ("n", 3, "z y x"), ("n", 4, None)], "g string, k int, t string")
    assert {r["k"]: r["cluster"] for r in notes.greedy_clusters(items, "g", "k", "t").collect()} == {1: 0, 2: 0, 3: 1}
    best = spark.createDataFrame([("n", 1, "a b c d"), ("n", 2, "e f g h"), ("n", 3, "a b e f g")], "g string, k int, t string")
    assert {r["k"]: r["cluster"] for r in notes.greedy_clusters(best, "g", "k", "t", 0.25).collect()} == {1: 0, 2: 1, 3: 1}
    two = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "y")], "i int, s string, r string")
    assert [r["i"] for r in notes.spread(two, ["s", "r"], "i", 3).orderBy("place").collect()] == [1, 4, 2]
    pool = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "i int, s string")
    assert [r["i"] for r in notes.spread(pool, ["s"], "i", 4).orderBy("place").collect()] == [0, 8, 1, 9]


def test_boschloo(spark):
    df = spark.createDataFrame([(7, 3, 1, 9), (5, 5, 5, 5), (0, 0, 1, 1)], "a long, b long, c long, d long").select(notes.boschloo(*map(F.col, "abcd")).alias("p")).collect()
    assert df[0]["p"] < 0.02 and df[1]["p"] > 0.9 and df[2]["p"] is None


def test_provenance(spark):
    m = spark.createDataFrame([("r1", 5, "done"), ("r2", 0, None)], "run string, calls int, status string")
    found = {(r["run"], r["problem"]) for r in provenance.problems(m, ["run"], {"no calls": F.col("calls") > 0, "status": F.col("status") == "done"}).collect()}
    assert found == {("r2", "no calls"), ("r2", "status")}
    arms = spark.createDataFrame([("x", r, i) for r in (1, 2, 3) for i in (1, 2)] + [("y", 1, 1), ("y", 1, 1)], "arm string, rep int, item int")
    got = {r["arm"]: (r["replicates"], r["complete"]) for r in provenance.complete_arms(arms, ["arm"], "rep", "item", 2).collect()}
    assert got == {"x": (3, True), "y": (0, False)}


def test_turns_and_edits(spark):
    script = spark.createDataFrame([(1, "lost\nDoctor: Hello there. How are you?\nPatient: fine\nthanks"), (2, None)], "k int, t string")
    rows = [(r["turn"], r["speaker"], r["part"], r["said"]) for r in notes.speaker_turns(script, "k", "t", longest=16).orderBy("turn", "part").collect()]
    assert rows == [(0, "Doctor", 0, "Hello there."), (0, "Doctor", 1, "How are you?"), (1, "Patient", 0, "fine thanks")]
    edit = spark.createDataFrame([("a b c", "a c", ["b"], ["c"]), ("a b c", "a x b", ["b"], ["c"]), ("a", "a", [], [])], "x string, y string, r array<string>, k array<string>")
    assert [r["p"] for r in edit.select(notes.edit_checks(*map(F.col, "xyrk")).alias("p")).collect()] == [[], ["new words", "removed span still there", "kept span gone"], ["nothing changed"]]


def test_allocation(spark):
    rnd = random.Random(9)
    for trial in range(4):
        rows = []
        for n in range(90):
            grade, own = rnd.choice("xyz"), f"f{n}"
            rows += [(level, grade, own, rnd.randrange(3) if trial == 0 else n % 25, rnd.random() < 0.2) for level in rnd.sample("abc", rnd.randint(1, 3))]
        rows = [(level, g, f, {r[2]: r[3] for r in rows}[f], b) for level, g, f, _, b in rows]  # a fact is one consultation's
        seats, caps, relaxed = 4, (2, 3), (4, 6)
        jitter = {f: hashlib.md5(f"s|{f}".encode()).hexdigest() for _, _, f, _, _ in rows}
        cells = {(level, g): [] for level, g, *_ in rows}
        levels, facts, pairs, want = {}, {}, {}, []
        for by, (most_facts, most_pairs) in (("within", caps), ("beyond", relaxed)):
            stuck = set()
            while short := [(seats - len(v), c) for c, v in cells.items() if len(v) < seats and c not in stuck]:
                level, grade = cell = max(short)[1]
                may = [r for r in rows if r[:2] == cell and level not in levels.get(r[2], ()) and pairs.get(r[3], 0) < most_pairs and (levels.get(r[2]) or facts.get(r[3], 0) < most_facts)]
                if not may:
                    stuck.add(cell)
                    continue
                r = min(may, key=lambda r: (not r[4], not levels.get(r[2]), pairs.get(r[3], 0), jitter[r[2]]))
                facts[r[3]] = facts.get(r[3], 0) + (not levels.get(r[2]))
                pairs[r[3]] = pairs.get(r[3], 0) + 1
                levels.setdefault(r[2], set()).add(level)
                cells[cell].append(r[2])
                want.append((*cell, r[2], len(want) + 1, by))
        df = spark.createDataFrame(rows, "l string, g string, f string, k int, b boolean")
        got = sorted(map(tuple, notes.allocate(df, "l", "g", "f", "k", "b", seats, caps, relaxed, "s").collect()), key=lambda r: r[3])
        assert got == want and (trial or "beyond" in {r[4] for r in want})


def test_lists_in_replies(spark):
    sheet = 'x {"facts": [{"id": "F1", "fact": " a "}, "plain", {"id": "f1", "fact": "b", "evidence": "e"}, {"fact": ""}, {"fact": "c"}, 7]} y'
    rows = spark.createDataFrame([(sheet,), ("none",), ('{"facts": []}',), ('{"facts": "no list"}',), (None,)], "r string").select(replies.facts(F.col("r")).alias("f")).collect()
    assert [tuple(f) for f in rows[0]["f"]][:4] == [("f1", "a", ""), ("f2", "plain", ""), ("f1_3", "b", "e"), ("f4", "c", "")]
    assert [r["f"] for r in rows[1:]] == [None] * 4
    wanted = F.array(*map(F.lit, ("a", "B", "c")))
    audit = '{"facts": [{"id": "A", "fact": "x", "severity": "Critical"}, {"id": "a", "fact": "y"}, {"id": "b", "fact": "z", "severity": "huge"}, {"id": "q", "fact": "z"}], "dropped": [{"id": "C"}, {"id": "zz"}]}'
    r = one(spark, {"r": audit}, k=replies.audited(F.col("r"), wanted), d=replies.dropped(F.col("r"), wanted))
    assert [tuple(k) for k in r["k"]] == [("a", "x", "critical", False), ("b", "z", "supporting", True)] and r["d"] == ["c"]
    claims = spark.createDataFrame([('{"verdicts": {"A": {"found": "yes", "quote": "q q"}, "b": "absent", "c": "huh", "z": "full"}}',), ('{"a": "partial"}',), ('{"z": "full"}',)], "r string")
    got = [r["c"] and [tuple(c) for c in r["c"]] for r in claims.select(replies.refuted(F.col("r"), wanted).alias("c")).collect()]
    assert got == [[("a", "full", "q q"), ("b", "no", "")], [("a", "partial", "")], None]


def test_diff_runs(spark):
    got = one(spark, {"d": "@@ one\n-a\n-\n+c\n@@ two\n+d\n-- e"}, r=replies.hunk_runs(F.col("d")))["r"]
    assert [(x["sign"], x["lines"]) for x in got] == [("-", ["a", ""]), ("+", ["c"]), ("+", ["d"]), ("-", ["- e"])]
    for bad in ("-a\n\n+b", "plain"):
        with pytest.raises(Exception, match="a diff line without"):
            one(spark, {"d": bad}, r=replies.hunk_runs(F.col("d")))


def test_decided_notes(spark):
    facts = spark.createDataFrame([(n, f, w) for n in "abc" for f, w in ((1, 3.0), (2, 1.0))], "note string, fact int, weight double")
    checked = spark.createDataFrame([("a", 1, "absent"), ("a", 2, "full"), ("b", 1, "partial"), ("c", 1, "absent"), ("c", 2, "absent")], "note string, fact int, verdict string")
    retried = spark.createDataFrame([("a", 1, "full"), ("c", 2, "full")], "note string, fact int, verdict string")
    claims = spark.createDataFrame([("a", 1, "full", "The  whole quote"), ("c", 1, "partial", "never said so"), ("c", 2, "full", "short"), ("b", 1, "full", "The whole quote")], "note string, fact int, found string, quote string")
    texts = spark.createDataFrame([(n, "... the whole\nquote, short") for n in "abc"], "note string, text string")
    got = {r["note"]: r for r in decisions.decide(facts, checked, retried, claims, texts, {"full": 1.0, "partial": 0.5, "absent": 0.0}).collect()}
    assert (got["a"]["aggregate"], got["a"]["flips"], got["a"]["unproved"], got["a"]["retried"]) == (1.0, 1, 0, False)
    assert (got["b"]["aggregate"], got["b"]["n_open"], got["b"]["flips"], got["b"]["retried"]) == (None, 1, None, True)
    assert (got["c"]["aggregate"], got["c"]["absent"], got["c"]["flips"], got["c"]["unproved"]) == (0.0, 2, 0, 2)


def test_sweeps_must_be_reviewed(spark):
    df = spark.createDataFrame([(1, "she and she"), (2, "nobody"), (3, "she"), (4, None)], "id int, text string")
    hits = decisions.reviewed_hits(df, "id", "text", r"\bshe\b", df.where("id = 1"))
    assert sorted(map(tuple, hits.collect())) == [(1, 2, True), (3, 1, False)]
    with pytest.raises(ValueError, match="3"):
        decisions.must_be_reviewed(hits, "id")
    assert decisions.must_be_reviewed(hits.where("id = 1"), "id").count() == 1
