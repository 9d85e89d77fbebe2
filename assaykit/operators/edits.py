"""Spans, units and edits of notes as column expressions over arrays of one row; rows of a note are never joined with each other.

Offsets count characters from 0, and units and words from 0.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.text import flat, units

#: Words that an excerpt's overlap leaves out.
LITTLE = "a an and are as at be been but by did do does for from had has have he her his i in is it its me my no not of on or our she so that the their them they this to was we were with you your".split()
#: Largest blocks of an accepted edit, of the first rule (units, regions, words) and of the second (units of one side, of either side, words).
FIRST, SECOND = (2, 2, 30), (6, 3, 30)


def upto(n: Column) -> Column:
    """0 .. n-1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


# spans


def span_pattern(span: Column) -> Column:
    """A regular expression for a span whose white space may be any, whatever its case; null for a blank span."""
    words = F.filter(F.split(span, r"\s+"), lambda w: w != "")
    escaped = F.transform(words, lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1"))
    return F.when(F.size(words) > 0, F.concat(F.lit("(?iu)"), F.array_join(escaped, r"\s+")))


def find_span(text: Column, span: Column) -> Column:
    """(start, stop, matches): where a span stands in a text; start and stop only if it stands there once."""
    pattern = span_pattern(span)
    n = F.coalesce(F.regexp_count(text, pattern), F.lit(0))
    start = F.length(F.element_at(F.split(text, pattern, 2), 1))
    stop = start + F.length(F.regexp_substr(text, pattern))
    return F.struct(F.when(n == 1, start).alias("start"), F.when(n == 1, stop).alias("stop"), n.alias("matches"))


def unit_alignment(text: Column, start: Column, stop: Column) -> Column:
    """(aligned, units): the numbers of units that stand within a place of a text, and whether they are all of it and follow on each other."""
    own = units(text)
    target = flat(F.substr(text, start + 1, stop - start))
    held = F.filter(upto(F.size(own)), lambda i: F.contains(target, flat(F.get(own, i))))
    first, last = F.element_at(held, 1), F.element_at(held, -1)
    whole = flat(F.array_join(F.slice(own, first + 1, last - first + 1), " "))
    aligned = F.when(F.size(held) > 0, (last - first + 1 == F.size(held)) & (whole == target)).otherwise(False)
    return F.when(start.isNotNull(), F.struct(aligned.alias("aligned"), held.alias("units"))).otherwise(F.struct(F.lit(False).alias("aligned"), F.array().cast("array<int>").alias("units")))


def without_spans(text: Column, spans: Column) -> Column:
    """A text without places (start, stop), which may touch or overlap. Where all of a line goes, its end goes too; a blank left
    before a blank or a mark closes; where the text's numbered lines ran from 1 without a gap, they do so again."""

    def line_too(s: Column) -> Column:
        before, after = F.substring_index(F.substr(text, F.lit(1), s["start"]), "\n", -1), F.substring_index(F.substr(text, s["stop"] + 1), "\n", 1)
        alone = F.trim(F.concat(before, after)) == ""
        start = F.when(alone, s["start"] - F.length(before)).otherwise(s["start"])
        stop = F.when(alone, F.least(s["stop"] + F.length(after) + 1, F.length(text))).otherwise(s["stop"])
        return F.struct(start.alias("start"), stop.alias("stop"))

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"))))
    wide = F.array_sort(F.transform(order, line_too))
    # a place that begins where one before it has not ended begins at that one's end
    reach = F.transform(upto(F.size(wide)), lambda i: F.struct(F.greatest(F.get(wide, i)["start"], F.coalesce(F.array_max(F.transform(F.slice(wide, 1, i), lambda s: s["stop"])), F.lit(0))).alias("start"), F.get(wide, i)["stop"].alias("stop")))
    clear = F.filter(reach, lambda s: s["start"] < s["stop"])
    # what stays lies between the places; touching places count as one, so an empty piece between them is none
    ends = F.concat(F.transform(clear, lambda s: s["start"]), F.array(F.length(text)))
    starts = F.concat(F.array(F.lit(0)), F.transform(clear, lambda s: s["stop"]))
    pieces = F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("a"), F.substr(text, a + 1, z - a).alias("p")))
    kept = F.filter(pieces, lambda x: (x["p"] != "") | (x["a"] == 0))
    rest = F.aggregate(kept, F.lit(None).cast("string"), lambda left, x: F.when(left.isNull(), x["p"]).otherwise(F.concat(F.when(left.endswith(" ") & x["p"].rlike("^[ .,;]"), F.rtrim(left)).otherwise(left), x["p"])))
    return renumbered(text, F.regexp_replace(rest, r"^\s+|\s+$", ""))


NUMBERED = r"^(\s*)(\d{1,9})([.)]\s)"


def renumbered(before: Column, after: Column) -> Column:
    """``after`` with its numbered lines counted from 1, if those of ``before`` were."""

    def numbers(text: Column) -> Column:
        return F.transform(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NUMBERED)), lambda x: F.regexp_extract(x, NUMBERED, 2).cast("int"))

    found = numbers(before)
    in_order = (F.size(found) > 0) & (found == F.transform(upto(F.size(found)), lambda i: i + 1))
    lines = F.split(after, "\n", -1)
    place = F.transform(lines, lambda x, i: F.size(F.filter(F.slice(lines, 1, i + 1), lambda y: y.rlike(NUMBERED))))
    made = F.zip_with(lines, place, lambda x, n: F.when(x.rlike(NUMBERED), F.concat(F.regexp_extract(x, NUMBERED, 1), n.cast("string"), F.regexp_extract(x, NUMBERED, 3), F.regexp_replace(x, NUMBERED, ""))).otherwise(x))
    return F.when(in_order, F.array_join(made, "\n")).otherwise(after)


# differences


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most pairs that rise in both numbers, of pairs in order of the first and falling second."""
    lows, ends, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(lows, j)
        back.append(ends[at - 1] if at else -1)
        lows[at : at + 1], ends[at : at + 1] = [j], [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2"))])))
def blocks(before: pd.Series, after: pd.Series) -> pd.Series:
    """The blocks in which two arrays differ, as (tag, i1, i2, j1, j2) with tag insert, delete or replace; null counts as empty.

    Equal beginnings and ends are set aside; in between a longest common subsequence stays, found as the longest rising chain of
    places with equal elements.
    """
    out = []
    for a, b in zip(before, after, strict=True):
        a, b = ([] if x is None else list(x) for x in (a, b))
        head, short = 0, min(len(a), len(b))
        while head < short and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < short - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        places: dict[str, list[int]] = {}
        for j in range(len(b) - tail - 1, head - 1, -1):
            places.setdefault(b[j], []).append(j)
        same = [(i, j) for i in range(head, len(a) - tail) for j in places.get(a[i], ())]
        marks = [(head - 1, head - 1), *rising(same), (len(a) - tail, len(b) - tail)]
        gaps = [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(marks, marks[1:], strict=False)]
        out.append([{"tag": "insert" if i == k else "delete" if j == m else "replace", "i1": i, "i2": k, "j1": j, "j2": m} for i, k, j, m in gaps if k > i or m > j])
    return pd.Series(out)


def word_changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """df with same, inserted, deleted and blocks of the words of two texts. Null counts as empty."""
    words = [F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "") for c in (before, after)]
    made = df.withColumns({"_n": F.size(words[0]), "_blocks": blocks(*words)})
    gone = F.aggregate("_blocks", F.lit(0), lambda s, k: s + k["i2"] - k["i1"])
    new = F.aggregate("_blocks", F.lit(0), lambda s, k: s + k["j2"] - k["j1"])
    numbers = {"same": F.col("_n") - gone, "inserted": new, "deleted": gone, "blocks": F.size("_blocks")}
    return made.withColumns({k: v.cast("long") for k, v in numbers.items()}).drop("_n", "_blocks")


def edit_acceptance(df: DataFrame, clean: str, errored: str, kind: str, first: tuple[int, int, int] = FIRST, second: tuple[int, int, int] = SECOND) -> DataFrame:
    """df with n_blocks, tag, units_out, units_in, regions, changed_words, accepted_first and accepted_second.

    An accepted edit is one block of units. By the second rule it is an insertion (of kind add) or a deletion (of kind omit) of a few units, or a
    replacement (of any kind) of few units on either side with few changed words; the first rule took smaller blocks, and of a unit that replaces
    another only words that were all added (add) or all taken (omit), or few regions of them (change). tag and what follows
    it are null unless there is one block; words are counted in replacements.
    """
    df = df.withColumns({"_u": units(F.col(clean)), "_v": units(F.col(errored))}).withColumn("_blocks", blocks(F.col("_u"), F.col("_v")))
    df = df.withColumn("_one", F.when(F.size("_blocks") == 1, F.get("_blocks", F.lit(0))))
    tag, out, in_ = F.col("_one.tag"), F.col("_one.i2") - F.col("_one.i1"), F.col("_one.j2") - F.col("_one.j1")
    replaced = tag == "replace"
    sides = [F.when(replaced, F.split(F.array_join(F.slice(u, F.col(f"_one.{lo}") + 1, n), " "), " ")) for u, lo, n in (("_u", "i1", out), ("_v", "j1", in_))]
    df = df.withColumn("_words", blocks(*sides))
    changed = F.when(replaced, F.aggregate("_words", F.lit(0), lambda s, k: s + k["i2"] - k["i1"] + k["j2"] - k["j1"]))
    df = df.withColumns({"n_blocks": F.size("_blocks"), "tag": tag, "units_out": out, "units_in": in_, "regions": F.when(replaced, F.size("_words")), "changed_words": changed})
    is_add, is_omit, is_change = (F.col(kind) == k for k in ("add", "omit", "change"))
    unit = (F.col("tag") == "replace") & (F.col("units_out") == 1) & (F.col("units_in") == 1)

    def pure(most: int) -> Column:
        return (F.col("tag") == "insert") & is_add & (F.col("units_in") <= most) | (F.col("tag") == "delete") & is_omit & (F.col("units_out") <= most)

    def small(sides: int, words: int) -> Column:
        return (F.col("tag") == "replace") & (F.col("units_out") <= sides) & (F.col("units_in") <= sides) & (F.col("changed_words") <= words)

    only = F.forall("_words", lambda k: k["tag"] == F.when(is_add, "insert").when(is_omit, "delete"))
    by_first = pure(first[0]) | unit & (is_add | is_omit) & only | is_change & small(first[0], first[2]) & (F.col("regions") <= first[1])
    by_second = pure(second[0]) | small(second[1], second[2])
    made = df.withColumns({"accepted_first": F.coalesce(by_first, F.lit(False)), "accepted_second": F.coalesce(by_second, F.lit(False))})
    return made.drop("_u", "_v", "_blocks", "_one", "_words")


# excerpts and orders


def excerpts(df: DataFrame, key: str, text: str, wanted: str, size: int) -> DataFrame:
    """(key, first, last, excerpt): the lines around the one that shares most words with another text, until they have ``size`` characters; cuts are marked.

    The excerpt grows to the side whose next line shares more, above of equals. So lines are taken in the order of the least share on the way to
    them from the middle, those above first: a running minimum and a running sum say which are in.
    """

    def told(x: Column) -> Column:
        return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z']+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(LITTLE)))

    lines = df.select(key, told(F.coalesce(wanted, F.lit(""))).alias("_w"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1)).alias("_i", "_line"))
    lines = lines.select(key, "_i", "_line", F.size(F.array_intersect("_w", told(F.col("_line")))).alias("_share"))
    own = Window.partitionBy(key)
    lines = lines.withColumn("_mid", F.min(F.struct(-F.col("_share"), "_i")).over(own)["_i"])
    lines = lines.withColumn("_side", F.signum(F.col("_i") - F.col("_mid"))).withColumn("_far", F.abs(F.col("_i") - F.col("_mid")))
    way = Window.partitionBy(key, "_side").orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_least", F.min("_share").over(way))
    taken = own.orderBy((F.col("_side") != 0).cast("int"), F.desc("_least"), "_side", "_far").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_before", F.coalesce(F.sum(F.length("_line")).over(taken), F.lit(-1)))
    lines = lines.withColumn("_in", F.col("_before") < F.lit(size))
    held = F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("_i", "_line"))))
    out = lines.groupBy(key).agg(F.min(F.when(F.col("_in"), F.col("_i"))).alias("first"), F.max(F.when(F.col("_in"), F.col("_i"))).alias("last"), F.max("_i").alias("_end"), held.alias("_h"))
    body = F.regexp_replace(F.array_join(F.transform("_h", lambda s: s["_line"]), "\n"), r"^\s+|\s+$", "")
    marked = F.concat(F.when(F.col("first") > 0, "[...]\n").otherwise(""), body, F.when(F.col("last") < F.col("_end"), "\n[...]").otherwise(""))
    return out.select(key, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), marked.alias("excerpt"))


def apart(df: DataFrame, group: str, key: str, text: str, least: float = 0.5) -> DataFrame:
    """(group, key, place, moved): items in key order, but none next to one that shares words by Jaccard ``least`` while another
    can stand there; then the next such one is moved up.

    Near items come from a join on words; the order is a fold over each group's items, which are one pick's and few by nature.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0))
    items = df.select(F.col(group).alias("g"), F.col(key).alias("k"), words.alias("w"))
    each = items.select("g", "k", F.size("w").alias("n"), F.explode("w").alias("word"))
    met = each.join(each.toDF("g", "k2", "n2", "word"), ["g", "word"]).where("k <> k2").groupBy("g", "k", "k2", "n", "n2").agg(F.count(F.lit(1)).alias("c"))
    near = met.where(F.col("c") >= least * (F.col("n") + F.col("n2") - F.col("c"))).groupBy("g", "k").agg(F.collect_list("k2").alias("near"))
    rows = items.join(near, ["g", "k"], "left").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("near", F.array().cast(f"array<{dict(df.dtypes)[key]}>")).alias("near")))).alias("rest"))
    kind = dict(df.dtypes)[key]
    start = F.struct(F.col("rest"), F.array().cast(f"array<{kind}>").alias("near"), F.array().cast(f"array<struct<k:{kind},moved:boolean>>").alias("out"))

    def step(so_far: Column, _: Column) -> Column:
        rest = so_far["rest"]
        pick = F.coalesce(F.get(F.filter(rest, lambda x: ~F.array_contains(so_far["near"], x["k"])), F.lit(0)), F.get(rest, F.lit(0)))
        left = F.filter(rest, lambda x: x["k"] != pick["k"])
        return F.struct(left.alias("rest"), pick["near"].alias("near"), F.concat(so_far["out"], F.array(F.struct(pick["k"].alias("k"), (pick["k"] != F.get(rest, F.lit(0))["k"]).alias("moved")))).alias("out"))

    order = F.aggregate(F.col("rest"), start, step, lambda x: x["out"])
    return rows.select("g", F.posexplode(order).alias("place", "o")).select(F.col("g").alias(group), F.col("o.k").alias(key), (F.col("place") + 1).cast("long").alias("place"), F.col("o.moved").alias("moved"))
