"""Consecutive numbers and ranks without one task that sorts a whole table or a whole group."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.streaming.latest import work_folder

#: Rows that one task may number by itself.
PART = 100_000


def _cuts(df: DataFrame, key: Column, part: int) -> list:
    """Quantiles that cut the key into parts of about ``part`` rows."""
    parts = max(1, -(-df.count() // part))
    if parts == 1:
        return []
    at = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    return sorted(set(df.agg(F.percentile_approx(key, at, max(10_000, 20 * parts))).first()[0] or []))


def _part(cuts: list, key: Column) -> Column:
    """How many cuts are below the key, found among every so many cuts first; 0 for null."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts)) + 1
    runs = F.array(*(F.array(*map(F.lit, cuts[i : i + step])) for i in range(0, len(cuts), step)))
    whole = F.size(F.filter(runs, lambda r: F.element_at(r, -1) < key))
    within = F.filter(F.get(runs, whole), lambda c: c < key)
    return whole * step + F.when(whole < -(-len(cuts) // step), F.size(within)).otherwise(0)


def numbered(df: DataFrame, key: str, name: str, part: int = PART) -> DataFrame:
    """df with 0, 1, .. in the order of a numeric key without nulls or repeats.

    Quantiles of the key cut the table into parts of about ``part`` rows. A part's first number is the rows of the parts before
    it, and its rows are numbered by themselves. The driver holds one cut and one count for each part.
    """
    cuts = _cuts(df, F.col(key), part)
    cut = df.withColumn("_part", _part(cuts, F.col(key)))
    sizes = {r["_part"]: r["count"] for r in cut.groupBy("_part").count().collect()}
    firsts, before = [], 0
    for i in range(max(sizes, default=0) + 1):
        firsts.append(before)
        before += sizes.get(i, 0)
    first = F.element_at(F.array(*(F.lit(x).cast("long") for x in firsts)), F.col("_part") + 1)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return cut.withColumn(name, first + own).drop("_part")


def ranked(df: DataFrame, groups: list[str], order: list[Column], cut: Column, rank: str, total: str | None = None, part: int = PART) -> DataFrame:
    """df with 1, 2, .. in each group by ``order``, and the group's rows as ``total``; a null group is a group.

    ``cut`` is a number that never falls along the order, nulls first, and that few rows share. Its quantiles cut every group, so that a
    task sorts about ``part`` rows even if one group holds most of the table; counts of the groups' parts give each part's first rank.
    The rows with their parts are written once, to a folder below spark.checkpoint.dir.
    """
    x = df.withColumn("_cut", cut)
    x = x.withColumn("_part", _part(_cuts(x, F.col("_cut"), part), F.col("_cut"))).drop("_cut")
    # a table, since a plan joined with counts of itself can let a filter on the part's expression lose its columns
    folder = work_folder(df.sparkSession, "ranks")
    x.write.parquet(folder)
    x = df.sparkSession.read.schema(x.schema).parquet(folder)
    own = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    every = Window.partitionBy(*groups)
    sizes = x.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(every).alias("_total"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = x.withColumn("_own", own).join(firsts, same)
    return out.select(*df.columns, (F.col("_before") + F.col("_own")).alias(rank), *([F.col("_total").alias(total)] if total else []))


def running(df: DataFrame, groups: list[str], order: list[Column], cut: Column, amount: str, out: str, part: int = PART) -> DataFrame:
    """df with the sum of ``amount`` over each group's rows up to each row by ``order``; ``cut`` as for ``ranked``.

    Quantiles of the cut deal every group over parts; sums of the parts before give each part what it carries on from.
    """
    x = df.withColumn("_cut", cut)
    x = x.withColumn("_part", _part(_cuts(x, F.col("_cut"), part), F.col("_cut"))).drop("_cut")
    folder = work_folder(df.sparkSession, "sums")
    x.write.parquet(folder)
    x = df.sparkSession.read.schema(x.schema).parquet(folder)
    own = F.sum(amount).over(Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = x.groupBy(*groups, "_part").agg(F.sum(amount).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    carried = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return x.withColumn("_own", own).join(carried, same).select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.coalesce("_own", F.lit(0))).alias(out))


def hex_cut(digest: Column) -> Column:
    """A number that rises with a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
