"""Order-dependent operators over notes: bounded groups or single rows in Python, dealt by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.text import flat


def _struct(**fields: T.DataType) -> T.StructType:
    """A struct type, built without a session (so that importing this module needs none)."""
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def locate(text: Column, quote: Column) -> Column:
    """(how, position from 0 to 1): a quote found whole, by its first 80, 50 or 30 characters, by one of its six longest words of
    six letters or more that occurs once, or by one that occurs at all; ``no_quote`` and ``not_found`` have no position.

    Texts are compared in lower case with single blanks. Words of equal length come in alphabetical order.
    """
    t, q = (flat(F.coalesce(x, F.lit(""))) for x in (text, quote))

    def at(part: Column) -> Column:
        return (F.position(part, t) - 1) / F.length(t)

    def found(how: str, part: Column, holds: Column) -> Column:
        return F.when(holds, F.struct(F.lit(how).alias("how"), at(part).alias("position")))

    long = F.array_distinct(F.filter(F.split(q, " "), lambda w: F.length(w) >= 6))
    words = F.transform(F.slice(F.array_sort(F.transform(long, lambda w: F.struct(-F.length(w), w.alias("w")))), 1, 6), lambda s: s["w"])
    once = F.filter(words, lambda w: F.length(t) - F.length(F.replace(t, w, F.lit(""))) == F.length(w))
    some = F.filter(words, lambda w: F.contains(t, w))
    none = F.lit(None).cast("double").alias("position")
    heads = [found(f"prefix{n}", F.substring(q, 1, n), (F.length(q) > n) & F.contains(t, F.substring(q, 1, n))) for n in (80, 50, 30)]
    return F.coalesce(
        F.when(q.isin("", "-", "n/a", "none") | (t == ""), F.struct(F.lit("no_quote").alias("how"), none)),
        found("exact", q, F.contains(t, q)),
        *heads,
        found("unique_word", F.try_element_at(once, F.lit(1)), F.size(once) > 0),
        found("word", F.try_element_at(some, F.lit(1)), F.size(some) > 0),
        F.struct(F.lit("not_found").alias("how"), none),
    )


def greedy_clusters(df: DataFrame, group: str, key: str, text: str, least: float = 0.5) -> DataFrame:
    """(group, key, cluster): items in key order join the cluster whose words they overlap most, if by Jaccard ``least``.

    Of equal clusters the first counts; items without a word are in none. A cluster's words grow with its members, so the order
    matters; a group is one note's items and stays small by nature.
    """

    def run(items: pd.DataFrame) -> pd.DataFrame:
        found: list[set[str]] = []
        out = []
        for k, t in sorted(zip(items[key], items[text].fillna(""), strict=True)):
            words = set(re.findall(r"[a-z0-9]+", t.lower()))
            if not words:
                continue
            overlap = [len(words & have) / len(words | have) for have in found]
            n = int(np.argmax(overlap)) if found else 0
            if found and overlap[n] >= least:
                found[n] |= words
            else:
                n = len(found)
                found.append(words)
            out.append((items[group].iloc[0], k, n))
        return pd.DataFrame(out, columns=[group, key, "cluster"])

    kinds = dict(df.dtypes)
    return df.select(group, key, text).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster long")


def cosine_groups(df: DataFrame, note: list[str], key: str, vector: str, levels: tuple[float, ...] = (0.8, 0.85, 0.9)) -> DataFrame:
    """(note, level, items, groups, pairs): near-duplicate groups of each note's vectors at several cosines, linked transitively.

    A note holds one document's findings. Pairs are compared inside a note's own matrix; nothing of them is handed on.
    """

    def run(items: pd.DataFrame) -> pd.DataFrame:
        x = np.array(items.sort_values(key)[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        near, out = x @ x.T, []
        for level in levels:
            label = np.arange(len(x))
            while True:
                low = np.where(near >= level, label[None, :], len(x)).min(axis=1)
                low = np.minimum(low, label)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            pairs = int((np.triu(near, 1) >= level).sum())
            out.append((*(items[c].iloc[0] for c in note), level, len(x), len(set(label.tolist())), pairs))
        return pd.DataFrame(out, columns=[*note, "level", "items", "groups", "pairs"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in note), "level double", "items long", "groups long", "pairs long"])
    return df.where(F.col(vector).isNotNull()).groupBy(*note).applyInPandas(run, schema)


def medoids(df: DataFrame, cluster: str, key: str, vector: str) -> DataFrame:
    """(cluster, key, mean_cosine): the member nearest to all members of its cluster on average, first of equals.

    The mean cosine to all members is the product with the mean of the unit vectors, so no pairs are needed.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = df.where(F.col(vector).isNotNull()).select(cluster, key, v.alias("_v"), norm.alias("_n")).where("_n > 0").select(cluster, key, F.transform("_v", lambda x: x / F.col("_n")).alias("_u"))
    parts = unit.select(cluster, F.posexplode("_u").alias("_d", "_x")).groupBy(cluster, "_d").agg(F.avg("_x").alias("_m"))
    centre = parts.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_c"))
    scored = unit.join(centre, cluster).select(cluster, key, F.aggregate(F.zip_with("_u", "_c", lambda x, c: x * c["_m"]), F.lit(0.0), lambda a, x: a + x).alias("_s"))
    best = scored.groupBy(cluster).agg(F.max_by(F.struct(key, "_s"), F.struct(F.round("_s", 9), -F.col(key))).alias("_b"))
    return best.select(cluster, F.col(f"_b.{key}").alias(key), F.col("_b._s").alias("mean_cosine"))


def spread(df: DataFrame, keys: list[str], item: str, n: int) -> DataFrame:
    """n items chosen one by one so that the values of the keys stay balanced, the first key before the others; ties by item.

    Of items with the same values the smallest is taken first, so the first n of each combination are all that can be chosen;
    only these meet in one task.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        counts: list[dict] = [{} for _ in keys]
        left = pool.sort_values(item).to_dict("records")
        chosen = []
        while left and len(chosen) < n:
            best = min(left, key=lambda r: (*(c.get(r[k], 0) for c, k in zip(counts, keys, strict=True)), r[item]))
            left.remove(best)
            chosen.append((best[item], len(chosen) + 1))
            for c, k in zip(counts, keys, strict=True):
                c[best[k]] = c.get(best[k], 0) + 1
        return pd.DataFrame(chosen, columns=[item, "place"])

    kind = dict(df.dtypes)[item]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(item))
    pool = df.select(item, *keys).withColumn("_r", first).where(F.col("_r") <= n).withColumn("_all", F.lit("all"))
    return pool.groupBy("_all").applyInPandas(run, f"{item} {kind}, place long")


def boschloo(a: Column, b: Column, c: Column, d: Column, points: int = 200) -> Column:
    """Boschloo's exact test (two-sided by doubling the smaller tail's p, at most 1) of two shares a/(a+b) and c/(c+d)."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from math import comb

        for batch in batches:
            out = []
            for a1, b1, c1, d1 in zip(*batch, strict=True):
                n, m = int(a1 + b1), int(c1 + d1)
                if not n or not m:
                    out.append(None)
                    continue
                x, y = np.meshgrid(np.arange(n + 1), np.arange(m + 1), indexing="ij")
                tails = []
                for sign in (1, -1):
                    p = np.array([[sum(comb(n, k) * comb(m, i + j - k) for k in (range(i, min(n, i + j) + 1) if sign > 0 else range(max(0, i + j - m), i + 1)) if 0 <= i + j - k <= m) / comb(n + m, i + j) for j in range(m + 1)] for i in range(n + 1)])
                    extreme = p <= p[int(a1), int(c1)] * (1 + 1e-9)
                    weight = np.array([[comb(n, int(i)) * comb(m, int(j)) for j in range(m + 1)] for i in range(n + 1)], float)
                    grid = np.linspace(1e-6, 1 - 1e-6, points)
                    tails.append(max((weight * q ** (x + y) * (1 - q) ** (n + m - x - y))[extreme].sum() for q in grid))
                out.append(min(1.0, 2 * min(tails)))
            yield pd.Series(out, dtype=float)

    return run(a, b, c, d)


def speaker_turns(df: DataFrame, key: str, text: str, longest: int = 400) -> DataFrame:
    """(key, turn, speaker, part, said): lines ``Name: words``; turns longer than ``longest`` characters are cut after the
    last sentence that fits, or hard where none does.

    A line without a name goes on with the turn before; lines before the first name are dropped.
    """

    @F.pandas_udf(T.ArrayType(_struct(turn=T.LongType(), speaker=T.StringType(), part=T.LongType(), said=T.StringType())))
    def parse(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            turns: list[list[str]] = []
            for line in (t or "").split("\n"):
                m = re.match(r"\s*([A-Za-z][\w ]{0,30}):\s*(.*)", line)
                if m:
                    turns.append([m[1].strip(), m[2].strip()])
                elif turns and line.strip():
                    turns[-1][1] = f"{turns[-1][1]} {line.strip()}".strip()
            rows = []
            for n, (who, said) in enumerate(turns):
                parts = []
                while len(said) > longest:
                    stop = said.rfind(". ", 0, longest) + 1
                    parts.append(said[: stop or longest].strip())
                    said = said[stop or longest :].strip()
                parts.append(said)
                rows += [{"turn": n, "speaker": who, "part": i, "said": p.strip()} for i, p in enumerate(parts)]
            out.append(rows)
        return pd.Series(out)

    return df.select(key, F.explode(parse(text)).alias("_t")).select(key, "_t.*")


def edit_checks(before: Column, after: Column, removed: Column, kept: Column) -> Column:
    """Problems of an edit: new words, a removed span still there, a kept span gone, or nothing changed."""

    def words(c: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")

    new = F.size(F.array_except(words(after), words(before))) > 0
    still = F.exists(removed, lambda s: F.contains(after, s))
    gone = F.exists(kept, lambda s: ~F.contains(after, s))
    flags = F.array(F.when(new, "new words"), F.when(still, "removed span still there"), F.when(gone, "kept span gone"), F.when(before == after, "nothing changed"))
    return F.array_compact(flags)


def allocate(supply: DataFrame, row: str, column: str, fact: str, consultation: str, built: str, seats: int, caps: tuple[int, int] = (2, 3), relaxed: tuple[int, int] = (5, 7), salt: str = "") -> DataFrame:
    """(row, column, fact, place, by): facts for the cells of a grid of row and column, ``seats`` for each cell.

    The cell that lacks most comes next (of equal ones the last). It takes what is built already, then a fact that another row has, then one of the
    consultation with the fewest pairs so far, then by stable order. ``caps``: facts and pairs of a consultation at most; cells that are
    short then go on with ``relaxed`` caps (by ``beyond``). supply has one row for each fact and row.

    One choice bears on the next, so choices are made in one task, but over a bounded pool: with P seats in all, P choices touch at most P
    consultations, so a cell's first P + 1 by best row, with as many rows of each as caps allow, hold every row that can win, beside all rows of their facts.
    """
    order = [F.desc("_b"), "_j", "_f"]
    rows = supply.select(F.col(row).alias("_r"), F.col(column).alias("_c"), F.col(fact).alias("_f"), F.col(consultation).alias("_k"), F.coalesce(built, F.lit(False)).alias("_b"))
    rows = rows.dropDuplicates(["_r", "_c", "_f"]).withColumn("_j", F.md5(F.concat_ws("|", F.lit(salt), F.col("_f").cast("string"))))
    cells = rows.select("_r", "_c").distinct().count()
    near = F.row_number().over(Window.partitionBy("_r", "_c", "_k").orderBy(*order))
    first = rows.withColumn("_near", near).where(F.col("_near") <= sum(relaxed))
    best = first.where("_near = 1").withColumn("_n", F.row_number().over(Window.partitionBy("_r", "_c").orderBy(*order))).where(F.col("_n") <= cells * seats + 1).select("_r", "_c", "_k")
    facts = first.join(F.broadcast(best), ["_r", "_c", "_k"], "left_semi").select("_f").distinct()
    pool = rows.join(F.broadcast(facts), "_f", "left_semi").withColumn("_all", F.lit(1))

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["_j", "_f"], ignore_index=True)
        cell, names = pd.factorize(pd.MultiIndex.from_frame(x[["_r", "_c"]]), sort=True)
        f, k = pd.factorize(x["_f"])[0], pd.factorize(x["_k"])[0]
        fresh, used = np.ones(len(x), bool), np.zeros(f.max() + 1, bool)
        facts_of, pairs_of, lacks = np.zeros(k.max() + 1, int), np.zeros(k.max() + 1, int), np.full(len(names), seats)
        out = []
        for by, (most_facts, most_pairs) in (("within", caps), ("beyond", relaxed)):
            open_ = np.ones(len(names), bool)
            while (lacks[open_] > 0).any():
                at = max(np.flatnonzero(open_), key=lambda i: (lacks[i], i))
                may = np.flatnonzero((cell == at) & fresh & (pairs_of[k] < most_pairs) & (used[f] | (facts_of[k] < most_facts)))
                if not len(may):
                    open_[at] = False
                    continue
                i = may[np.lexsort((may, pairs_of[k[may]], ~used[f[may]], ~x["_b"].to_numpy(bool)[may]))[0]]
                facts_of[k[i]] += not used[f[i]]
                pairs_of[k[i]] += 1
                used[f[i]], fresh[i] = True, False
                lacks[at] -= 1
                out.append((*x.loc[i, ["_r", "_c", "_f"]], len(out) + 1, by))
        return pd.DataFrame(out, columns=[row, column, fact, "place", "by"])

    kinds = dict(supply.dtypes)
    return pool.groupBy("_all").applyInPandas(choose, f"{row} {kinds[row]}, {column} {kinds[column]}, {fact} {kinds[fact]}, place long, by string")
