"""Judgement records: supersession, twins, discrimination, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.functions.stats import spearman, wilson
from assaykit.operators import metrics, records
from assaykit.plans.registry import query
from assaykit.sources.tables import JUDGEMENTS_SQL, NEWEST_SQL, TWINS_SQL, judgements, read

W, N, T = f"WITH {JUDGEMENTS_SQL}", f"WITH {NEWEST_SQL}", f"WITH {TWINS_SQL}"
WILSON_SQL = """{k} AS DOUBLE) / {n} + 1.959963984540054 * 1.959963984540054 / (2 * {n})"""


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgements(read(spark, sf_dir, "events"))


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.current(every(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.twins(now(spark, sf_dir))


@query(f"{N} SELECT event_id, user_id, event_type, replicate, score FROM j")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return now(spark, sf_dir).select("event_id", "user_id", "event_type", "replicate", "score")


@query(f"""{W}, per AS (SELECT stratum, user_id, event_type, replicate, count(*) AS n FROM raw GROUP BY ALL)
SELECT stratum, CAST(sum(n) AS BIGINT) AS n_read, count(*) AS n_kept, CAST(sum(n) - count(*) AS BIGINT) AS n_dropped FROM per GROUP BY stratum""")
def superseded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.superseded(every(spark, sf_dir), ["user_id", "event_type", "replicate"], "stratum")


@query(f"""{T} SELECT pair_type, replicate, count(*) AS n, count(*) FILTER (score < clean_score) AS wins, count(*) FILTER (score = clean_score) AS ties,
  (2 * count(*) FILTER (score < clean_score) + count(*) FILTER (score = clean_score)) / CAST(2 * count(*) AS DOUBLE) AS paired FROM tw GROUP BY ALL""")
def paired_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired(pairs(spark, sf_dir), ["pair_type", "replicate"])


@query(f"""{T}, r AS (SELECT pair_type, replicate, count(*) AS n, (2 * count(*) FILTER (score < clean_score) + count(*) FILTER (score = clean_score)) / CAST(2 * count(*) AS DOUBLE) AS p FROM tw GROUP BY ALL)
SELECT pair_type, count(*) AS replicates, CAST(sum(n) AS BIGINT) AS n, round(avg(p), 9) AS paired FROM r GROUP BY pair_type""")
def paired_over_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired_over_replicates(pairs(spark, sf_dir), ["pair_type"]).withColumn("paired", F.round("paired", 9))


@query(f"""{T}, e AS (SELECT pair_type, user_id, event_type, avg(CASE WHEN score < clean_score THEN 1.0 WHEN score = clean_score THEN 0.5 ELSE 0.0 END::DOUBLE) AS p FROM tw GROUP BY ALL)
SELECT pair_type, count(*) AS pairs, round(avg(p), 9) AS paired FROM e GROUP BY pair_type""")
def paired_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired_by_pair(pairs(spark, sf_dir), ["pair_type"], ["user_id", "event_type"]).withColumn("paired", F.round("paired", 9))


@query(f"""{T} SELECT pair_type, count(*) AS n, count(*) FILTER (parse_failure OR clean_failure) AS failed,
  count(*) FILTER (NOT (parse_failure OR clean_failure) AND clean_score > score) AS strict_wins,
  count(*) FILTER (NOT (parse_failure OR clean_failure) AND clean_score > score) / CAST(count(*) AS DOUBLE) AS strict,
  CAST(sum(clean_score - score) FILTER (NOT (parse_failure OR clean_failure)) AS DOUBLE) / nullif(count(*) FILTER (NOT (parse_failure OR clean_failure)), 0) AS mean_gap
FROM tw GROUP BY pair_type""")
def strict_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strict(pairs(spark, sf_dir), ["pair_type"])


@query(f"""{N}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum, user_id, replicate ORDER BY event_id DESC) AS n FROM j WHERE role = 'clean') WHERE n = 1)
SELECT e.replicate, e.pair_type, count(*) AS n, count(*) FILTER (e.score < c.score) AS wins, count(*) FILTER (e.score = c.score) AS ties
FROM j e JOIN c USING (stratum, user_id, replicate) WHERE e.role = 'errored' GROUP BY ALL""")
def twins_by_consultation(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = now(spark, sf_dir)
    clean = records.last_clean(j).select("stratum", "user_id", "replicate", F.col("score").alias("clean_score"))
    joined = j.where("role = 'errored'").join(clean, ["stratum", "user_id", "replicate"])
    return metrics.paired(joined, ["replicate", "pair_type"]).drop("paired")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errored judgements of each type beside all clean ones, so that each type has its own curve."""
    j = now(spark, sf_dir).where(~F.col("parse_failure"))
    types = F.array(*map(F.lit, ("add", "change", "omit")))
    return j.select("replicate", "user_id", "score", (F.col("role") == "errored").alias("positive"), F.explode(F.when(F.col("role") == "clean", types).otherwise(F.array("pair_type"))).alias("curve"))


SCORED = f"""{N}, sc AS (SELECT replicate, user_id, score, role = 'errored' AS positive, unnest(CASE WHEN role = 'clean' THEN ['add', 'change', 'omit'] ELSE [pair_type] END) AS curve FROM j WHERE NOT parse_failure),
ct AS (SELECT curve, replicate, score AS s, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM sc GROUP BY ALL),
cu AS (SELECT curve, replicate, s, pos, neg, sum(pos) OVER w AS n_pos, sum(neg) OVER w AS n_neg,
  coalesce(sum(pos) OVER (PARTITION BY curve, replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
  coalesce(sum(neg) OVER (PARTITION BY curve, replicate ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  s = max(s) OVER w AS is_last FROM ct WINDOW w AS (PARTITION BY curve, replicate))"""
CURVE = ["curve", "replicate"]


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_counts(_scored(spark, sf_dir), CURVE, "score", F.col("positive"))


@query(f"""{SCORED} SELECT curve, replicate, CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_neg) AS BIGINT) AS n_neg,
  CAST(sum(2 * pos * (n_neg - neg_below - neg) + pos * neg) AS DOUBLE) / nullif(2 * CAST(max(n_pos) AS DOUBLE) * max(n_neg), 0) AS auc FROM cu GROUP BY ALL""")
def auc_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_counts(spark, sf_dir), CURVE)


POINTS = {
    "strict": "SELECT curve, replicate, CAST(s AS DOUBLE) AS threshold, 'at' AS side, pos_below AS hits, neg_below AS false_alarms, n_pos, n_neg FROM cu UNION ALL SELECT curve, replicate, CAST(s + 1 AS DOUBLE), 'past', pos_below + pos, neg_below + neg, n_pos, n_neg FROM cu WHERE is_last",
    "both": "SELECT curve, replicate, CAST(s AS DOUBLE) AS threshold, 'at' AS side, pos_below AS hits, neg_below AS false_alarms, n_pos, n_neg FROM cu UNION ALL SELECT curve, replicate, CAST(s AS DOUBLE), 'above', pos_below + pos, neg_below + neg, n_pos, n_neg FROM cu",
    "inclusive": "SELECT curve, replicate, CAST(s AS DOUBLE) AS threshold, 'above' AS side, pos_below + pos AS hits, neg_below + neg AS false_alarms, n_pos, n_neg FROM cu",
}


def points_sql(rule: str) -> str:
    return f"{SCORED}, po AS ({POINTS[rule]}), sw AS (SELECT curve, replicate, threshold, side, CAST(hits AS BIGINT) AS hits, CAST(false_alarms AS BIGINT) AS false_alarms, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, CAST(hits AS DOUBLE) / nullif(n_pos, 0) AS det, CAST(false_alarms AS DOUBLE) / nullif(n_neg, 0) AS fa FROM po)"


@query(f"{points_sql('strict')} SELECT * FROM sw")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(_counts(spark, sf_dir), CURVE)


@query(f"{points_sql('both')} SELECT * FROM sw")
def threshold_sweep_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(_counts(spark, sf_dir), CURVE, "both")


@query(f"{points_sql('inclusive')} SELECT *, det - fa AS youden FROM sw")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(_counts(spark, sf_dir), CURVE, "inclusive").withColumn("youden", F.col("det") - F.col("fa"))


def best_sql(rule: str, cap: float, order: str) -> str:
    return f"{points_sql(rule)} SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY curve, replicate ORDER BY {order}) AS n FROM sw WHERE fa <= {cap}) WHERE n = 1"


@query(best_sql("both", 0.5, "det DESC, fa, threshold DESC, side DESC"))
def best_at_false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_at(metrics.sweep(_counts(spark, sf_dir), CURVE, "both"), CURVE, 0.5)


@query(best_sql("inclusive", 0.5, "det DESC, threshold, side"))
def best_at_false_alarms_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_at(metrics.sweep(_counts(spark, sf_dir), CURVE, "inclusive"), CURVE, 0.5, "first")


@query(f"""{points_sql("inclusive")}, b AS (SELECT curve, replicate, n_pos, n_neg, max(threshold) FILTER (fa <= 0.2 + 1e-12) AS best FROM sw WHERE n_pos > 0 AND n_neg > 0 GROUP BY ALL)
SELECT b.curve, b.replicate, coalesce(best, CAST('-inf' AS DOUBLE)) AS threshold, coalesce(side, 'below') AS side, coalesce(hits, 0) AS hits, coalesce(false_alarms, 0) AS false_alarms, b.n_pos, b.n_neg, coalesce(det, 0.0) AS det, coalesce(fa, 0.0) AS fa FROM b LEFT JOIN sw ON sw.curve = b.curve AND sw.replicate = b.replicate AND sw.threshold = b.best""")
def largest_feasible_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_at(metrics.sweep(_counts(spark, sf_dir), CURVE, "inclusive"), CURVE, 0.2, "largest")


@query(f"""{N}, m AS (SELECT CASE WHEN role = 'errored' THEN pair_type ELSE 'clean' END AS kind, user_id, event_type, role = 'errored' AS positive, CAST(sum(score) AS DOUBLE) / count(*) AS s FROM j GROUP BY ALL),
x AS (SELECT s, positive, unnest(CASE WHEN positive THEN [kind] ELSE ['add', 'change', 'omit'] END) AS curve FROM m),
ct AS (SELECT curve, s, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM x GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS n_pos, sum(neg) OVER w AS n_neg, sum(pos) OVER u AS hp, sum(neg) OVER u AS hn, lead(s) OVER u AS nx, lag(s) OVER u AS pv FROM ct WINDOW w AS (PARTITION BY curve), u AS (PARTITION BY curve ORDER BY s)),
po AS (SELECT curve, CASE WHEN nx IS NULL THEN s + 0.5 ELSE (s + nx) / 2 END AS threshold, hp AS hits, hn AS false_alarms, n_pos, n_neg FROM cu UNION ALL SELECT curve, s - 0.5, 0, 0, n_pos, n_neg FROM cu WHERE pv IS NULL),
ju AS (SELECT *, CAST(hits AS DOUBLE) / n_pos - CAST(false_alarms AS DOUBLE) / n_neg AS j FROM po)
SELECT curve, round(threshold, 9) AS threshold, CAST(hits AS BIGINT) AS hits, CAST(false_alarms AS BIGINT) AS false_alarms, round(j, 9) AS j FROM (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY j DESC, threshold) AS n FROM ju) WHERE n = 1""")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = now(spark, sf_dir)
    means = j.groupBy(F.when(F.col("role") == "errored", F.col("pair_type")).otherwise("clean").alias("kind"), "user_id", "event_type", (F.col("role") == "errored").alias("positive")).agg((F.sum("score") / F.count(F.lit(1))).alias("score"))
    curves = means.withColumn("curve", F.explode(F.when(F.col("positive"), F.array("kind")).otherwise(F.array(*map(F.lit, ("add", "change", "omit"))))))
    return metrics.youden_midpoints(curves, ["curve"], "score", F.col("positive")).withColumns({"threshold": F.round("threshold", 9), "j": F.round("j", 9)})


def low_high_sql(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054"
    mid = f"(CAST({k} AS DOUBLE) / {n} + {z} * {z} / (2 * {n}))"
    half = f"({z} * sqrt(CAST({k} AS DOUBLE) / {n} * (1 - CAST({k} AS DOUBLE) / {n}) / {n} + {z} * {z} / (4 * CAST({n} AS DOUBLE) * {n})))"
    den = f"(1 + {z} * {z} / {n})"
    return f"round(greatest(0.0, ({mid} - {half}) / {den}), 9)", f"round(least(1.0, ({mid} + {half}) / {den}), 9)"


LOW, HIGH = low_high_sql("flags", "n")


@query(f"""{N}, g AS (SELECT role, coalesce(pair_type, 'none') AS pair_type, coalesce(level, 'none') AS level, severity, count(*) AS n, count(*) FILTER (flagged AND NOT parse_failure) AS flags FROM j GROUP BY ALL)
SELECT role, pair_type, level, severity, n, flags, CAST(flags AS DOUBLE) / n AS rate, {LOW} AS low, {HIGH} AS high FROM g""")
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["role", F.coalesce("pair_type", F.lit("none")).alias("pair_type"), F.coalesce("level", F.lit("none")).alias("level"), "severity"]
    g = now(spark, sf_dir).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flagged") & ~F.col("parse_failure")).alias("flags"))
    low, high = wilson("flags", "n")
    return g.select("role", "pair_type", "level", "severity", "n", "flags", (F.col("flags") / F.col("n")).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""{N}, g AS (SELECT CASE WHEN grouping(pair_type) = 1 THEN 'ALL' ELSE pair_type END AS pair_type, CASE WHEN grouping(severity) = 1 THEN 'ALL' ELSE severity END AS severity, count(*) AS n, count(*) FILTER (flagged) AS flags
FROM (SELECT pair_type, severity, flagged FROM j WHERE role = 'errored' UNION ALL SELECT 'omission-any', severity, flagged FROM j WHERE pair_type = 'omit' AND level IS NOT NULL) GROUP BY CUBE (pair_type, severity))
SELECT pair_type, severity, n, flags, CAST(flags AS DOUBLE) / n AS rate FROM g""")
def flag_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    errored = now(spark, sf_dir).where("role = 'errored'")
    both = errored.select(F.explode(F.when((F.col("pair_type") == "omit") & F.col("level").isNotNull(), F.array("pair_type", F.lit("omission-any"))).otherwise(F.array("pair_type"))).alias("_type"), F.col("severity").alias("_severity"), "flagged")
    cube = both.cube("_type", "_severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flags"), F.grouping("_type").alias("_a"), F.grouping("_severity").alias("_b"))
    name = [F.when(F.col(g) == 1, "ALL").otherwise(F.col(c)).alias(c[1:] if c != "_type" else "pair_type") for g, c in (("_a", "_type"), ("_b", "_severity"))]
    return cube.select(*name, "n", "flags", (F.col("flags") / F.col("n")).alias("rate"))


@query(f"""{N}, b AS (SELECT CASE WHEN score <= 2 THEN 'low' WHEN score <= 5 THEN 'middle' ELSE 'high' END AS band, flagged, pair_type FROM j WHERE role = 'errored')
SELECT pair_type, band, count(*) AS n, count(*) FILTER (flagged) AS flags FROM b GROUP BY ALL""")
def strength_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("score") <= 2, "low").when(F.col("score") <= 5, "middle").otherwise("high")
    return now(spark, sf_dir).where("role = 'errored'").groupBy("pair_type", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flags"))


@query(f"""{T}, w AS (SELECT *, CASE severity WHEN 'critical' THEN 1.0 WHEN 'supporting' THEN 0.5 ELSE 0.25 END::DOUBLE AS wt FROM tw)
SELECT pair_type, sum(wt) AS weight, coalesce(sum(wt) FILTER (flagged AND NOT parse_failure), 0) AS detected, coalesce(sum(wt) FILTER (flagged AND NOT parse_failure), 0) / sum(wt) AS weighted_detection,
  CAST(count(*) FILTER (clean_flagged) AS DOUBLE) / count(*) AS fa, coalesce(sum(wt) FILTER (flagged AND NOT parse_failure), 0) / sum(wt) - CAST(count(*) FILTER (clean_flagged) AS DOUBLE) / count(*) AS objective FROM w GROUP BY pair_type""")
def weighted_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "supporting", 0.5).otherwise(0.25)
    g = pairs(spark, sf_dir).withColumn("_w", weight).groupBy("pair_type").agg(F.sum("_w").alias("weight"), F.sum(F.when(F.col("flagged") & ~F.col("parse_failure"), F.col("_w")).otherwise(0.0)).alias("detected"), (F.count_if("clean_flagged") / F.count(F.lit(1))).alias("fa"))
    share = F.col("detected") / F.col("weight")
    return g.select("pair_type", "weight", "detected", share.alias("weighted_detection"), "fa", (share - F.col("fa")).alias("objective"))


@query(f"""{T} SELECT event_id, CASE WHEN score < clean_score THEN 0.5 WHEN score = clean_score THEN 0.25 ELSE 0.0 END::DOUBLE + 0.5 * greatest(0.0, least(1.0, (clean_score - score) / 5.0))::DOUBLE AS reward FROM tw
UNION ALL SELECT event_id, score / 10.0::DOUBLE FROM j WHERE role = 'clean'""")
def example_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("clean_score") - F.col("score")) / 5.0))
    errored = pairs(spark, sf_dir).select("event_id", (0.5 * metrics.tie_adjusted(F.col("score"), F.col("clean_score")) + 0.5 * margin).alias("reward"))
    return errored.unionByName(now(spark, sf_dir).where("role = 'clean'").select("event_id", (F.col("score") / 10.0).alias("reward")))


@query(f"""{N}, m AS (SELECT event_type, replicate, user_id, score, max(score) OVER (PARTITION BY user_id, replicate) AS best FROM j)
SELECT event_type, count(*) AS examples, count(*) FILTER (score >= best - 1e-9) AS leads FROM m GROUP BY event_type""")
def pareto_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max("score").over(Window.partitionBy("user_id", "replicate"))
    return now(spark, sf_dir).withColumn("_best", best).groupBy("event_type").agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("score") >= F.col("_best") - 1e-9).alias("leads"))


@query(f"""{points_sql('inclusive')}, a AS (SELECT *, CAST(hits + n_neg - false_alarms AS DOUBLE) / (n_pos + n_neg) AS accuracy FROM sw)
SELECT curve, replicate, threshold, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY curve, replicate ORDER BY accuracy DESC, threshold) AS n FROM a) WHERE n = 1""")
def oracle_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.sweep(_counts(spark, sf_dir), CURVE, "inclusive")
    accuracy = curve.withColumn("accuracy", (F.col("hits") + F.col("n_neg") - F.col("false_alarms")) / (F.col("n_pos") + F.col("n_neg")))
    return records.newest(accuracy, CURVE, [F.desc("accuracy"), F.asc("threshold")]).select(*CURVE, "threshold", "accuracy")


@query(f"""{N}, r AS (SELECT event_type, CAST(rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS DOUBLE) AS a, CAST(rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 AS DOUBLE) AS b FROM j)
SELECT event_type, count(*) AS n, round(corr(a, b), 9) AS rho FROM r GROUP BY event_type""")
def spearman_k_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(now(spark, sf_dir), "k", "score", ["event_type"]).withColumn("rho", F.round("rho", 9))


@query(f"""{N}, r AS (SELECT k % 10 AS category, count(*) AS n, CAST(count(*) FILTER (flagged) AS DOUBLE) / count(*) AS rate FROM j GROUP BY ALL HAVING count(*) >= 20),
k AS (SELECT CAST(rank() OVER (ORDER BY category) AS DOUBLE) AS a, CAST(rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0 AS DOUBLE) AS b FROM r)
SELECT count(*) AS n, round(corr(a, b), 9) AS rho FROM k""")
def checkability_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = now(spark, sf_dir).groupBy((F.col("k") % 10).alias("category")).agg(F.count(F.lit(1)).alias("_n"), (F.count_if("flagged") / F.count(F.lit(1))).alias("rate")).where("_n >= 20")
    return spearman(rates.withColumn("_g", F.lit(0)), "category", "rate", ["_g"]).select("n", F.round("rho", 9).alias("rho"))


@query(f"""{N}, p AS (SELECT user_id, event_type, any_value(pair_type) AS pair_type, count(*) AS runs, count(*) FILTER (flagged) AS votes FROM j WHERE role = 'errored' GROUP BY user_id, event_type)
SELECT user_id, event_type, pair_type, runs, votes, 2 * votes > runs AS majority FROM p""")
def majority_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = now(spark, sf_dir).where("role = 'errored'").groupBy("user_id", "event_type").agg(F.max_by("pair_type", "replicate").alias("pair_type"), F.count(F.lit(1)).alias("runs"), F.count_if("flagged").alias("votes"))
    return p.withColumn("majority", 2 * F.col("votes") > F.col("runs"))


@query(f"""{N}, r AS (SELECT pair_type, replicate, CAST(count(*) FILTER (flagged) AS DOUBLE) / count(*) AS rate FROM j WHERE role = 'errored' GROUP BY ALL)
SELECT pair_type, count(*) AS runs, round(avg(rate), 9) AS mean, round(coalesce(stddev_samp(rate), 0.0), 9) AS sd, round(stddev_samp(rate), 9) AS spread FROM r GROUP BY pair_type""")
def replicate_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = now(spark, sf_dir).where("role = 'errored'").groupBy("pair_type", "replicate").agg((F.count_if("flagged") / F.count(F.lit(1))).alias("rate"))
    sd = F.stddev_samp("rate")
    return r.groupBy("pair_type").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("rate"), 9).alias("mean"), F.round(F.coalesce(sd, F.lit(0.0)), 9).alias("sd"), F.round(sd, 9).alias("spread"))
