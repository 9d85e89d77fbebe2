"""Spans, unit differences, accepted edits, excerpts and orders; sections of notes."""

import random

import pytest
from pyspark.sql import functions as F

from assaykit.operators import edits, sections


def column(spark, rows, schema, *made):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*made).collect()]


def test_spans_whatever_their_white_space(spark):
    rows = [("one two  three", "two\nthree"), ("aa bb aa", "aa"), (None, "x"), ("t", None), ("t", " "), ("a (b) c? é", "(B)   c? É"), ("a.b", "a.b"), ("axb", "a.b"), ("😀 x y", "x y")]
    got = column(spark, rows, "t string, s string", edits.find_span(F.col("t"), F.col("s")).alias("f"))
    assert [tuple(r[0]) for r in got] == [(4, 14, 1), (None, None, 2), (None, None, 0), (None, None, 0), (None, None, 0), (2, 10, 1), (0, 3, 1), (None, None, 0), (2, 5, 1)]


def test_units_that_a_place_covers(spark):
    note = "Plan:\nGo home. Rest  now.\nReturn if worse."
    rows = [(note, note.index("Go"), note.index("Go") + 8), (note, note.index("Go"), note.index("now") + 4), (note, note.index("Go"), note.index("now")), (note, 0, 4), (note, note.index("Rest"), len(note)), (note, None, None)]
    got = column(spark, rows, "t string, a int, z int", edits.unit_alignment(F.col("t"), F.col("a"), F.col("z")).alias("u"))
    assert [(r[0][0], r[0][1]) for r in got] == [(True, [1]), (True, [1, 2]), (False, [1]), (False, []), (True, [2, 3]), (False, [])]


def test_texts_without_places(spark):
    def without(text, *parts):
        places = [{"start": text.index(p), "stop": text.index(p) + len(p)} for p in parts]
        return column(spark, [(text, places)], "t string, p array<struct<start:int,stop:int>>", edits.without_spans(F.col("t"), F.col("p")))[0][0]

    assert without("1. one\n2. two\n3. three", "2. two") == "1. one\n2. three"
    assert without("1. one\n2. two\n3. three", "1. one", "3. three") == "1. two"
    assert without("2. one\n3. two\n4. three", "3. two") == "2. one\n4. three"
    assert without("He is well , and sad today.", "and sad") == "He is well , today."
    assert without("one gone. two", "gone") == "one. two"
    assert without("a\n  gone \n b ", "gone") == "a\n b"
    assert without("all of it", "all of it") == ""
    assert without("keep this. Cut this. Cut that. Stay.", " Cut this.", " Cut that.") == "keep this. Stay."
    assert without("abcdef", "bcd", "cde") == "af"
    assert without("nothing goes") == "nothing goes"


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_blocks_leave_a_longest_common_subsequence(spark):
    rnd = random.Random(6)
    rows = [([rnd.choice("abcde") for _ in range(rnd.randint(0, 12))], [rnd.choice("abcde") for _ in range(rnd.randint(0, 12))]) for _ in range(200)] + [([], []), (["a"], []), ([], ["a"])]
    for r in spark.createDataFrame(rows, "a array<string>, b array<string>").withColumn("blocks", edits.blocks("a", "b")).collect():
        rest_a, rest_b, made, at = list(r.a), list(r.b), [], 0
        for k in r.blocks:
            assert k.tag == ("insert" if k.i1 == k.i2 else "delete" if k.j1 == k.j2 else "replace") and (k.i2 > k.i1 or k.j2 > k.j1)
            made += r.a[at : k.i1] + r.b[k.j1 : k.j2]
            at = k.i2
        assert made + r.a[at:] == r.b  # the blocks turn one into the other
        gone, new = sum(k.i2 - k.i1 for k in r.blocks), sum(k.j2 - k.j1 for k in r.blocks)
        assert len(rest_a) - gone == len(rest_b) - new == common(r.a, r.b)


def test_word_changes(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), (None, "q"), ("", "")], "a string, b string")
    assert [(r.same, r.inserted, r.deleted, r.blocks) for r in edits.word_changes(df, "a", "b").collect()] == [(2, 2, 1, 2), (0, 1, 0, 1), (0, 0, 0, 0)]


def test_accepted_edits(spark):
    clean = "Complaint:\nChest pain since Monday. No cough.\n\nPlan:\nStart drug 5mg daily for 5 days. Return if fever persists. See again in 2 weeks."
    plan = "Start drug 5mg daily for 5 days. Return if fever persists. See again in 2 weeks."
    cases = [
        ("add", clean + " Scan showed nothing.", True, True),
        ("omit", clean.replace(" Return if fever persists.", ""), True, True),
        ("change", clean.replace("5mg daily", "9mg hourly"), True, True),
        ("change", clean.replace("5mg daily", "9mg hourly").replace("No cough", "Has cough"), False, False),
        ("change", clean.replace("Monday. No", "Monday.\nNo"), False, False),  # other line breaks are no difference
        ("omit", clean.replace(plan, "").strip(), False, True),  # three units: the first rule took two
        ("add", clean.replace("No cough.", "Lungs clear, no wheeze, saturation normal."), False, True),
        ("add", clean.replace("No cough.", "No cough at all."), False, True),
        ("add", clean.replace("No cough.", "No dry cough."), True, True),
        ("omit", clean.replace("Chest pain since Monday.", "Chest pain Monday."), True, True),
        ("omit", clean + " Scan showed nothing.", False, False),
        ("add", clean + "".join(f" Line {i} is new." for i in range(7)), False, False),
        ("change", clean.replace("No cough.", " ".join(f"w{i}" for i in range(40)) + "."), False, False),
    ]
    rows = [(clean, e, k) for k, e, _, _ in cases]
    got = edits.edit_acceptance(spark.createDataFrame(rows, "c string, e string, k string"), "c", "e", "k").collect()
    assert [(r.accepted_first, r.accepted_second) for r in got] == [(a, b) for _, _, a, b in cases]
    assert [r.n_blocks for r in got[:6]] == [1, 1, 1, 2, 0, 1] and (got[2].tag, got[2].regions, got[2].changed_words) == ("replace", 1, 4)


def grown(lines, shares, size):
    """The window of an excerpt, one line after the other."""
    inside = [shares.index(max(shares))]
    while sum(len(lines[i]) for i in inside) < size and len(inside) < len(lines):
        beside = {min(inside) - 1, max(inside) + 1} & set(range(len(lines)))
        inside.append(max(beside, key=lambda i: (shares[i], -i)))
    return min(inside), max(inside)


def test_excerpts(spark):
    rows = [(0, "one two\nalpha beta\nbeta\nfour", "The Alpha beta!"), (1, "", "x"), (2, None, None), (3, "aaa\nbbb", "bbb")]
    got = [tuple(r) for r in edits.excerpts(spark.createDataFrame(rows, "k int, t string, q string"), "k", "t", "q", 12).orderBy("k").collect()]
    assert got == [(0, 1, 2, "[...]\nalpha beta\nbeta\n[...]"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 1, "aaa\nbbb")]
    rnd, words = random.Random(2), [f"word{c}" for c in "abcdefgh"]
    made = []
    for k in range(60):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(0, 5))) for _ in range(rnd.randint(1, 12))]
        made.append((k, "\n".join(lines), " ".join(rnd.sample(words, 3))))
    for r in edits.excerpts(spark.createDataFrame(made, "k int, t string, q string"), "k", "t", "q", 60).collect():
        lines, wanted = made[r.k][1].split("\n"), set(made[r.k][2].split())
        assert (r["first"], r["last"]) == grown(lines, [len(wanted & set(x.split())) for x in lines], 60)


def test_near_duplicates_stand_apart(spark):
    rows = [("n", 1, "a b c"), ("n", 2, "a b c"), ("n", 3, "x"), ("n", 4, "x y"), ("n", 5, None), ("m", 7, "same"), ("m", 8, "same")]
    got = edits.apart(spark.createDataFrame(rows, "g string, k int, t string"), "g", "k", "t").orderBy("g", "place").collect()
    assert [(r.g, r.k, r.moved) for r in got] == [("m", 7, False), ("m", 8, False), ("n", 1, False), ("n", 3, True), ("n", 2, False), ("n", 4, False), ("n", 5, False)]


def test_sections_roles_and_forms(spark):
    labels = [("Plan:",), ("PLAN ",), ("Assessment and Plan - 3. x",), ("Allergies/adverse  reactions;",), (None,), ("",), ("(none)",), ("O/E (remote)",), ("Odd - part",)]
    got = column(spark, labels, "l string", sections.canonical(F.col("l")), sections.role(sections.canonical(F.col("l"))))
    assert got == [("plan", "assessment_plan"), ("plan", "assessment_plan"), ("assessment and plan", "assessment_plan"), ("allergies/adverse reactions", "registry_list"), *[("(none)", "no_header")] * 3, ("o/e (remote)", "exam_objective"), ("odd", "unclassified")]
    note = "intro\nHistory: pain. It is bad today and goes on for longer than twelve words in all.\n  plan\n- rest\n1. drink\n\nDose: one, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve"
    places = [0, note.index("pain"), note.index("plan"), note.index("rest"), note.index("drink"), note.index("\n\n") + 1, note.index("Dose")]
    rows = [(note, ["Plan", "History:", "PLAN;", "Absent", None], p) for p in places]
    at = F.col("p")
    got = column(spark, rows, "n string, l array<string>, p int", sections.section_at(sections.anchors(sections.placed_lines(F.col("n")), F.col("l")), at), sections.form_at(F.col("n"), at))
    assert got == [("(none)", "list"), ("history", "prose"), ("plan", "list"), ("plan", "list"), ("plan", "list"), ("plan", "blank"), ("plan", "list")]


def test_residuals_of_removed_sites(spark):
    note = "Plan:\nrest\nHistory:\nsmokes ten a day and drinks nothing at all since the last visit here."
    edited = note.replace("rest", "")

    def site(i, removed, at, quote, label, strength):
        return {"site": i, "removed": removed, "at": at, "quote": quote, "label": label, "strength": strength}

    sites = [site(1, True, note.index("rest"), None, "Plan:", "explicit"), site(2, False, None, "smokes ten", "History:", "explicit"), site(3, False, None, "not there", "PLAN -", "explicit"), site(4, False, None, "smokes", "History", "partial")]
    schema = "k int, note string, edited string, sites array<struct<site:int,removed:boolean,at:int,quote:string,label:string,strength:string>>"
    df = spark.createDataFrame([(1, note, edited, sites), (2, note, edited, sites[:1]), (3, note, edited, [sites[0], sites[3]])], schema)
    got = {r.k: r for r in sections.residual_locations(sections.labelled_sites(df, "k"), "k").collect()}
    assert (got[1].location, got[1].residual_sections, got[1].n_residual, got[1].n_fallback, got[1].residual_form) == ("same_section", ["history", "plan"], 2, 1, "prose")
    assert (got[2].location, got[2].residual_in_plan, got[2].residual_form) == (None, None, None)
    assert (got[3].location, got[3].removed_role, got[3].residual_in_plan, got[3].residual_in_list) == ("different_section", "assessment_plan", False, False)


def test_cell_statistics_count_unread_pairs_as_lost(spark):
    rows = [("s", 1, 1, 1, 3, 5, False, False, True), ("s", 1, 1, 2, 5, 5, False, False, False), ("s", 2, 2, 1, 1, 9, True, False, True), ("s", 2, 2, 2, 9, 1, False, False, True)]
    df = spark.createDataFrame(rows, "split string, pair int, cluster int, replicate int, score int, clean_score int, parse_failure boolean, clean_failure boolean, flagged boolean")
    r = sections.cell_statistics(df, "split", ["pair"], "cluster").first()
    assert (r.n_pairs, r.n_consultations, r.paired_mean, r.per_run, r.majority_k) == (2, 2, pytest.approx(0.375), "0.5000 0.2500", 1)
    assert r.paired_sd == pytest.approx(0.1767767) and r.flag_mean == pytest.approx(0.75)
