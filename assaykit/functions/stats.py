"""Intervals and tests as column expressions over counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.numbering import ranked

Z95 = 1.959963984540054


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wilson(hits: Column | str, n: Column | str, z: float = Z95, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson interval for a share; null without trials. Clamped to [0, 1] unless told otherwise."""
    k, n = _c(hits).cast("double"), _c(n).cast("double")
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    ok = n > 0
    return F.when(ok, low), F.when(ok, high)


def log_factorial(n: Column) -> Column:
    """ln n!: exact below 16, else by Stirling's series, whose first term left out is under 2e-14."""
    small, x = n.cast("int"), F.greatest(n, F.lit(16)).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    exact = F.array(*(F.lit(math.log(math.factorial(i))) for i in range(16)))
    return F.when(n < 16, F.get(exact, F.greatest(small, F.lit(0)))).otherwise(series)


def binomial_two_sided(b: Column | str, c: Column | str) -> Column:
    """Exact two-sided binomial test of b against c at one half (McNemar, sign test); 1 when there is nothing to compare."""
    b, c = _c(b).cast("long"), _c(c).cast("long")
    n, k = b + c, F.least(b, c)
    terms = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def holm(df: DataFrame, p: str, family: str, label: str) -> DataFrame:
    """Holm's adjusted p within each family: step-down, never falling, at most 1."""
    w = Window.partitionBy(family).orderBy(p, label)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy(family)) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def paired_wald(b: str, c: str, n: str, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Difference of two paired rates, b and c being the discordant pairs of n, and its Wald interval."""
    net = F.col(b) - F.col(c)
    delta, half = net / F.col(n), z * F.sqrt(F.greatest(F.col(b) + F.col(c) - net * net / F.col(n), F.lit(0.0))) / F.col(n)
    return delta, delta - half, delta + half


def two_proportion_z(k1: Column | str, n1: Column | str, k2: Column | str, n2: Column | str) -> Column:
    """Pooled z of two shares; null where its standard error is 0."""
    k1, n1, k2, n2 = (_c(x).cast("double") for x in (k1, n1, k2, n2))
    pool = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), (k1 / n1 - k2 / n2) / se)


def _hypergeometric(a: Column, row: Column, col: Column, n: Column) -> Column:
    return F.exp(log_factorial(row) - log_factorial(a) - log_factorial(row - a) + log_factorial(n - row) - log_factorial(col - a) - log_factorial(n - row - col + a) - log_factorial(n) + log_factorial(col) + log_factorial(n - col))


def fisher(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> tuple[Column, Column]:
    """Fisher's exact test of a 2x2 table: two-sided p, and the right tail (a or more)."""
    a, b, c, d = (_c(x).cast("long") for x in (a, b, c, d))
    n, row, col = a + b + c + d, a + b, a + c
    support = F.sequence(F.greatest(F.lit(0).cast("long"), row + col - n), F.least(row, col))
    mass = F.transform(support, lambda x: F.struct(x.alias("x"), _hypergeometric(x, row, col, n).alias("p")))
    here = _hypergeometric(a, row, col, n)
    two = F.aggregate(mass, F.lit(0.0), lambda s, m: s + F.when(m["p"] <= here * (1 + 1e-9), m["p"]).otherwise(0.0))
    right = F.aggregate(mass, F.lit(0.0), lambda s, m: s + F.when(m["x"] >= a, m["p"]).otherwise(0.0))
    return F.least(F.lit(1.0), two), F.least(F.lit(1.0), right)


def kappa(df: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two raters; null when chance agreement is 1. Categories are those that occur."""
    g = ["_all", *(groups or [])]
    cells = df.withColumn("_all", F.lit(1)).where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*g, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    n = cells.groupBy(*g).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("agree"))
    left = cells.groupBy(*g, "_a").agg(F.sum("_n").alias("_l")).withColumnRenamed("_a", "_k")
    right = cells.groupBy(*g, "_b").agg(F.sum("_n").alias("_r")).withColumnRenamed("_b", "_k")
    chance = left.join(right, [*g, "_k"]).groupBy(*g).agg(F.sum(F.col("_l") * F.col("_r")).alias("_e"))
    joined = n.join(chance, g, "left")
    po, pe = F.col("agree") / F.col("n"), F.coalesce(F.col("_e"), F.lit(0)) / (F.col("n") * F.col("n"))
    return joined.select(*g[1:], "n", "agree", po.alias("observed"), pe.alias("chance"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def average_rank(column: str, *groups: str) -> Column:
    """Rank with ties sharing the mean of their places."""
    return (F.rank().over(Window.partitionBy(*groups).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, column)) - 1) / 2).cast("double")


def spearman(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, *groups)).withColumn("_y", average_rank(y, *groups))
    return both.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("rho"))


def ks_uniform(df: DataFrame, x: str, group: str) -> DataFrame:
    """Largest distance of the empirical distribution of x in [0, 1] from the uniform one."""
    r = ranked(df.where(F.col(x).isNotNull()).select(group, x), [group], [F.col(x)], F.col(x), "_i", "_n")
    gap = F.greatest(F.col("_i") / F.col("_n") - F.col(x), F.col(x) - (F.col("_i") - 1) / F.col("_n"))
    return r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("d"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from contingency counts."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    # the cells and both margins in one grouping; each level's pairs are summed by itself
    levels = cells.groupingSets([[F.col(a), F.col(b)], [F.col(a)], [F.col(b)]], a, b).agg(F.sum("_n").alias("_s"), F.grouping_id().alias("_level"))
    whole = levels.agg(*(F.sum(F.when(F.col("_level") == k, F.col("_s") * (F.col("_s") - 1) / 2)).alias(x) for k, x in ((0, "_i"), (1, "_a"), (2, "_b"))), F.sum(F.when(F.col("_level") == 0, F.col("_s"))).alias("n"))
    expect = F.col("_a") * F.col("_b") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("_a") + F.col("_b")) / 2
    return whole.select("n", F.when(most == expect, F.lit(1.0)).otherwise((F.col("_i") - expect) / (most - expect)).alias("ari"))


def kolmogorov(d: Column | str, n: Column | str) -> Column:
    """The chance of a distance of at least d between n uniform values and their distribution, by the limit for many values.

    The limit's two series are each used where a few terms suffice.
    """
    x = _c(d) * F.sqrt(_c(n))
    far = sum(((-1) ** (k - 1) * 2 * F.exp(-2 * k * k * x * x) for k in range(1, 9)), F.lit(0.0))
    near = 1 - math.sqrt(2 * math.pi) / x * sum((F.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 9)), F.lit(0.0))
    return F.when(x <= 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x < 1.18, near).otherwise(far))))


def against_uniform(df: DataFrame, x: str, group: str) -> DataFrame:
    """(group, n, mean, d, p, deciles, first, last, skew) of values in [0, 1]: the largest distance from the uniform distribution with its
    chance, counts of tenths, shares below 0.3 and from 0.7, and to which side the mean leans. Counts by value come before any window;
    equal values are one step of the distribution."""
    counts = df.where(F.col(x).isNotNull()).groupBy(group, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    r = ranked(counts, [group], [F.col("_x")], F.col("_x"), "_i")
    own = Window.partitionBy(group)
    r = r.withColumn("_n", F.sum("_c").over(own)).withColumn("_upto", F.sum("_c").over(own.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.greatest(F.col("_upto") / F.col("_n") - F.col("_x"), F.col("_x") - (F.col("_upto") - F.col("_c")) / F.col("_n"))
    tenth = F.least(F.lit(9), F.floor(F.col("_x") * 10)).cast("int")
    sums = [F.sum(F.when(tenth == i, F.col("_c")).otherwise(0)) for i in range(10)]
    out = r.groupBy(group).agg(
        F.sum("_c").alias("n"),
        (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.max(gap).alias("d"),
        F.array(*sums).alias("deciles"),
        (F.sum(F.when(F.col("_x") < 0.3, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("first"),
        (F.sum(F.when(F.col("_x") >= 0.7, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("last"),
    )
    skew = F.when(F.col("mean") < 0.45, "early").when(F.col("mean") > 0.55, "late").otherwise("roughly uniform")
    return out.select(group, "n", "mean", "d", kolmogorov("d", "n").alias("p"), "deciles", "first", "last", skew.alias("skew"))


def least_squares(sums: DataFrame, names: list[str], target: str) -> DataFrame:
    """sums with the coefficients ``c_<name>`` of least squares without an intercept, from columns ``<a>_<b>`` that hold the sums of products.

    The equations are solved by Cholesky's factors, column by column. If one is no more than rounding, all coefficients are null.
    """
    size = len(names)
    low: dict[tuple[int, int], Column] = {}
    out = sums
    for j in range(size):
        own = F.col(f"{names[j]}_{names[j]}")
        rest = own - sum((low[j, k] * low[j, k] for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"_l{j}{j}", F.when(rest > 1e-9 * own, F.sqrt(rest)))
        low[j, j] = F.col(f"_l{j}{j}")
        for i in range(j + 1, size):
            both = F.col(f"{names[j]}_{names[i]}") - sum((low[i, k] * low[j, k] for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"_l{i}{j}", both / low[j, j])
            low[i, j] = F.col(f"_l{i}{j}")
    for j in range(size):
        out = out.withColumn(f"_z{j}", (F.col(f"{names[j]}_{target}") - sum((low[j, k] * F.col(f"_z{k}") for k in range(j)), F.lit(0.0))) / low[j, j])
    for j in reversed(range(size)):
        out = out.withColumn(f"c_{names[j]}", (F.col(f"_z{j}") - sum((low[k, j] * F.col(f"c_{names[k]}") for k in range(j + 1, size)), F.lit(0.0))) / low[j, j])
    return out.drop(*(f"_l{i}{j}" for i in range(size) for j in range(i + 1)), *(f"_z{j}" for j in range(size)))
