"""Cluster bootstrap from sufficient statistics, with draws by hash so that any engine gets the same ones.

A statistic is an expression over sums, so that a cluster is one row with its own sums, and a draw one row with theirs. Clusters are numbered; draw d's slot s takes the cluster number
md5(seed|d|s) modulo their count. Draws and slots are joined to clusters by number and added up per draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.numbering import numbered


def resampled(clusters: DataFrame, cluster: str, sums: list[str], value: Column, draws: int = 200, seed: str = "7", least: int = 20) -> DataFrame:
    """(clusters, valid, estimate, low, high): ``value``, an expression over the sums, and its 95 % percentile interval.

    Fewer than two clusters, or fewer than ``least`` draws with a value, give no interval. Each draw's sums are formed where slots
    meet clusters; the table of draws by slots is what grows: draws times the number of clusters.
    """
    spark = clusters.sparkSession
    rows = numbered(clusters.select(F.col(cluster).alias("_c"), *sums), "_c", "_i")
    n = rows.count()
    slots = spark.range(draws * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).cast("long").alias("draw"), (F.col("id") % F.lit(max(n, 1))).alias("slot"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", "slot").cast("binary")), 1, 8), 16, 10).cast("long")
    picked = slots.select("draw", (hashed % F.lit(max(n, 1))).alias("_i"))
    added = [F.sum(c).alias(c) for c in sums]
    point = clusters.agg(*added).select(value.alias("estimate")).withColumn("_k", F.lit(1))
    per = picked.join(rows, "_i").groupBy("draw").agg(*added).select(value.alias("v"))
    interval = per.agg(F.count("v").alias("valid"), F.percentile("v", F.lit(0.025)).alias("_low"), F.percentile("v", F.lit(0.975)).alias("_high")).withColumn("_k", F.lit(1))
    ok = (F.col("valid") >= least) & F.lit(n >= 2)
    return point.join(interval, "_k").select(F.lit(n).cast("long").alias("clusters"), "valid", "estimate", F.when(ok, F.col("_low")).alias("low"), F.when(ok, F.col("_high")).alias("high"))


def bootstrap(clusters: DataFrame, cluster: str, num: str, den: str, draws: int = 200, seed: str = "7", least: int = 20) -> DataFrame:
    """``resampled`` for a ratio of two sums."""
    return resampled(clusters, cluster, [num, den], F.col(num) / F.nullif(F.col(den), F.lit(0)), draws, seed, least)


def multiplicities(clusters: DataFrame, cluster: str, draws: int, seed: str = "7") -> DataFrame:
    """(draw, cluster, times): how often each draw takes each cluster, by the hashes of ``resampled``; one row for each that is taken."""
    rows = numbered(clusters.select(F.col(cluster).alias("_c")).distinct(), "_c", "_i")
    n = rows.count()
    slots = clusters.sparkSession.range(draws * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).cast("long").alias("draw"), (F.col("id") % F.lit(max(n, 1))).alias("slot"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", "slot").cast("binary")), 1, 8), 16, 10).cast("long")
    times = slots.select("draw", (hashed % F.lit(max(n, 1))).alias("_i")).groupBy("draw", "_i").agg(F.count(F.lit(1)).alias("times"))
    return times.join(rows, "_i").select("draw", F.col("_c").alias(cluster), "times")


def weighted_spearman(cells: DataFrame, groups: list[str], x: str, y: str, weight: str) -> DataFrame:
    """(groups, n, rho) of weighted pairs of values: ranks are those of as many rows as the weights say, ties at their middle.

    rho is null below three rows or where either side has one value.
    """
    own = Window.partitionBy(*groups)

    def middle(c: str) -> Column:
        upto = F.sum(weight).over(own.orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
        return upto - (F.sum(weight).over(Window.partitionBy(*groups, c)) - 1) / 2

    w = F.col(weight)
    ranks = cells.withColumns({"_x": middle(x), "_y": middle(y)})
    s = ranks.groupBy(*groups).agg(F.sum(w).alias("n"), *(F.sum(w * v).alias(k) for k, v in (("sx", F.col("_x")), ("sy", F.col("_y")), ("xx", F.col("_x") ** 2), ("yy", F.col("_y") ** 2), ("xy", F.col("_x") * F.col("_y")))))
    n = F.col("n")
    spread = (n * F.col("xx") - F.col("sx") ** 2) * (n * F.col("yy") - F.col("sy") ** 2)
    return s.select(*groups, "n", F.when((n >= 3) & (spread > 0), (n * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).alias("rho"))


def interval(values: DataFrame, value: str) -> DataFrame:
    """(valid, low, median, high): 95 % of the draws' values."""
    return values.agg(F.count(value).alias("valid"), *(F.percentile(value, F.lit(q)).alias(n) for q, n in ((0.025, "low"), (0.5, "median"), (0.975, "high"))))


def percentile_rules(values: DataFrame, value: str, least: int = 20) -> DataFrame:
    """(rule, valid, low, high): the ends of a 95 % interval of draws by four rules. ``linear`` lies between the two nearest draws;
    the others take the draw at 0.025 and 0.975 of their number rounded down, of the sorted draws counted from 0; ``inner`` the one
    below the upper, ``outer`` the one below the lower. Fewer than ``least`` draws with a value give no ends.
    """
    s = values.agg(F.array_sort(F.collect_list(value)).alias("l"), F.percentile(value, F.lit(0.025)).alias("a"), F.percentile(value, F.lit(0.975)).alias("z")).withColumn("n", F.size("l"))  # as many as draws
    lo, hi = F.floor(F.col("n") * 0.025).cast("int"), F.floor(F.col("n") * 0.975).cast("int")
    ends = {"linear": (F.col("a"), F.col("z")), "floor": (F.get("l", lo), F.get("l", hi)), "inner": (F.get("l", lo), F.get("l", hi - 1)), "outer": (F.get("l", lo - 1), F.get("l", hi))}
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col("n").cast("long").alias("valid"), F.when(F.col("n") >= least, a).alias("low"), F.when(F.col("n") >= least, z).alias("high")) for r, (a, z) in ends.items()))
    return s.select(F.explode(rows).alias("_r")).select("_r.*")


def slots_sql(clusters: str, draws: int, seed: str = "7") -> str:
    """``multiplicities`` for DuckDB, from a query that gives c."""
    return f"""cl AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM ({clusters})), nn AS (SELECT count(*) AS n FROM cl), sl AS (SELECT id // n AS draw, id % n AS slot, n FROM nn, LATERAL (SELECT unnest(range({draws} * n)) AS id)),
tm AS (SELECT draw, c, count(*) AS times FROM (SELECT draw, CAST('0x' || substr(md5('{seed}|' || draw || '|' || slot), 1, 8) AS BIGINT) % n AS i FROM sl) JOIN cl USING (i) GROUP BY draw, c)"""


def resampled_sql(clusters: str, sums: list[str], value: str, draws: int = 200, seed: str = "7", least: int = 20) -> str:
    """The same for DuckDB, from a query that gives c and the sums, and an expression over them."""
    added = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in sums)
    return f"""cl AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i FROM ({clusters})), nn AS (SELECT count(*) AS n FROM cl),
sl AS (SELECT id // n AS draw, id % n AS slot, n FROM nn, LATERAL (SELECT unnest(range({draws} * n)) AS id)),
pk AS (SELECT draw, CAST('0x' || substr(md5('{seed}|' || draw || '|' || slot), 1, 8) AS BIGINT) % n AS i FROM sl),
dr AS (SELECT {value} AS v FROM (SELECT draw, {added} FROM pk JOIN cl USING (i) GROUP BY draw)),
iv AS (SELECT count(v) AS valid, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM dr),
pt AS (SELECT {value} AS estimate FROM (SELECT {added} FROM cl))
SELECT n AS clusters, valid, round(estimate, 9) AS estimate, round(CASE WHEN valid >= {least} AND n >= 2 THEN lo END, 9) AS low, round(CASE WHEN valid >= {least} AND n >= 2 THEN hi END, 9) AS high FROM nn, iv, pt"""


def draws_sql(clusters: str, draws: int = 200, seed: str = "7", least: int = 20) -> str:
    """``bootstrap`` for DuckDB, from a query that gives (c, num, den)."""
    return resampled_sql(clusters, ["num", "den"], "num / nullif(den, 0)", draws, seed, least)
