"""Samples, votes and panels: winsorised means, cell rules, majorities, consensus and weighted coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winsorized(samples: Column, exact: int | None = None) -> Column:
    """Mean with the smallest sample replaced by the second smallest and the largest by the second largest.

    Fewer than four samples give the plain mean; ``exact`` raises an error for any other number of samples.
    """
    s, n = F.array_sort(samples), F.size(samples)
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x)
    pulled = total - F.element_at(s, 1) + F.element_at(s, 2) - F.element_at(s, -1) + F.element_at(s, -2)
    out = F.when(n >= 4, pulled / n).when(n > 0, total / n)
    if exact is None:
        return out
    return F.when(n == exact, out).otherwise(F.raise_error(F.concat(F.lit(f"{exact} samples wanted, not "), n.cast("string"))))


def cell(samples: Column, form: Column, k: Column) -> tuple[Column, Column]:
    """(aggregate, flagged) of a cell. Scores: one sample is flagged at 7 or less, eight winsorised ones below 8.

    Verdicts: passes count 10 and fails 0, and a mean of 5 or less is flagged. A missing sample gives null for both.
    """
    broken = F.exists(samples, lambda x: x.isNull()) | (F.size(samples) == 0)
    value = F.when(form == "score", F.when(k == 8, winsorized(samples)).otherwise(F.element_at(samples, 1).cast("double"))).otherwise(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.size(samples))
    flag = F.when(form == "score", F.when(k == 8, value < 8.0).otherwise(value <= 7)).otherwise(value <= 5.0)
    return F.when(~broken, value), F.when(~broken, flag)


def majority(yes: Column, n: Column) -> Column:
    """More than half; ties are no majority."""
    return 2 * yes > n


def field_majority(df: DataFrame, item: list[str], fields: list[str], empty_passes: bool) -> DataFrame:
    """Majority of each field over runs, ignoring nulls, and whether all fields pass.

    A field that no run filled is null; whether the item then still passes is a parameter, since both rules are in use.
    """
    per = df.groupBy(*item).agg(*(F.when(F.count(f) > 0, 2 * F.count_if(F.col(f)) > F.count(f)).alias(f) for f in fields))
    passes = F.lit(True)
    for f in fields:
        passes = passes & F.coalesce(F.col(f), F.lit(empty_passes))
    return per.withColumn("passes", passes)


def panel(df: DataFrame, item: list[str], role: str, vote: str, skeptics: tuple[str, str], tiebreak: str) -> DataFrame:
    """Two sceptics decide where they agree, the tiebreak where they differ; a missing vote is no decision."""
    per = df.groupBy(*item).agg(*(F.max(F.when(F.col(role) == r, F.col(vote).cast("int"))).alias(n) for r, n in ((skeptics[0], "_a"), (skeptics[1], "_b"), (tiebreak, "_t"))), F.count(vote).alias("n_votes"), F.count_if(~F.col(vote)).alias("n_refuted"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    split = both & (F.col("_a") != F.col("_b"))
    real = F.when(both & ~split, F.col("_a") == 1).when(split & F.col("_t").isNotNull(), F.col("_t") == 1)
    by = F.when(both & ~split, "skeptics").when(split & F.col("_t").isNotNull(), "tiebreak").otherwise("incomplete")
    return per.select(*item, "n_votes", "n_refuted", split.alias("split"), real.alias("is_real"), by.alias("decided_by"))


def consensus(a: Column, b: Column, scale: tuple[str, ...]) -> tuple[Column, Column]:
    """(grade, disputed): agreement stands, else the lower grade; scale runs from lowest to highest."""
    order = F.array(*map(F.lit, scale))
    low = F.least(F.array_position(order, a), F.array_position(order, b))
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok & (low > 0), F.element_at(order, F.when(low > 0, low).otherwise(1).cast("int"))), F.when(ok, a != b)


def coverage(df: DataFrame, groups: list[str], weight: Column, credit: Column) -> DataFrame:
    """Weighted share of facts covered."""
    return df.groupBy(*groups).agg(F.sum(weight).alias("weight"), F.sum(weight * credit).alias("credit")).withColumn("coverage", F.col("credit") / F.nullif(F.col("weight"), F.lit(0)))


def lowest(*dimensions: Column) -> Column:
    """The lowest dimension; null if any is missing."""
    gap = dimensions[0].isNull()
    for d in dimensions[1:]:
        gap = gap | d.isNull()
    return F.when(~gap, F.least(*dimensions) if len(dimensions) > 1 else dimensions[0])


def modal(df: DataFrame, item: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each item; of equal ones the first seen."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*item, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*item).orderBy(F.desc("_n"), "_first", value)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*item, value, F.col("_n").alias("n"))


def placed(df: DataFrame, cluster: str, category: str, share: float = 0.6) -> DataFrame:
    """Each cluster's category, if that many of its members vote for it."""
    votes = df.groupBy(cluster, category).agg(F.count(F.lit(1)).alias("votes"))
    size = F.sum("votes").over(Window.partitionBy(cluster))
    best = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("votes"), category))
    top = votes.withColumn("size", size).withColumn("_r", best).where("_r = 1")
    return top.select(cluster, F.when(F.col("votes") >= share * F.col("size"), F.col(category)).alias(category), "votes", "size")
