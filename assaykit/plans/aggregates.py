"""Ensembles, panels, rates, tables, tests and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.functions import stats
from assaykit.operators import aggregate, bootstrap, records
from assaykit.plans.judging import N, T, now, pairs
from assaykit.plans.registry import query
from assaykit.sources.tables import JUDGEMENTS_SQL, judgements, read

W = f"WITH {JUDGEMENTS_SQL}"
EIGHT_SQL = f"""{W}, f AS (SELECT user_id, event_type, score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS i FROM raw),
e AS (SELECT user_id, event_type, list_sort(list(score)) AS s, list(CASE WHEN score > 7 THEN 10 ELSE 0 END) AS b FROM f WHERE i <= 8 GROUP BY user_id, event_type HAVING count(*) = 8)"""


def eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight judgements of each note, as samples."""
    first = judgements(read(spark, sf_dir, "events")).withColumn("_i", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("t", "event_id"))).where("_i <= 8")
    return first.groupBy("user_id", "event_type").agg(F.collect_list("score").alias("samples"), F.collect_list(F.when(F.col("score") > 7, 10).otherwise(0)).alias("passes")).where(F.size("samples") == 8)


@query(f"{EIGHT_SQL} SELECT user_id, event_type, CAST(2 * s[2] + s[3] + s[4] + s[5] + s[6] + 2 * s[7] AS DOUBLE) / 8 AS mean FROM e")
def winsorized_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eight(spark, sf_dir).select("user_id", "event_type", aggregate.winsorized(F.col("samples"), exact=8).alias("mean"))


@query(f"""{W}, g AS (SELECT user_id, event_type, list_sort(list(score)) AS s, count(*) AS n, sum(score) AS t FROM raw GROUP BY ALL)
SELECT user_id, event_type, n, CASE WHEN n >= 4 THEN CAST(t - s[1] + s[2] - s[n] + s[n - 1] AS DOUBLE) / n ELSE CAST(t AS DOUBLE) / n END AS mean FROM g""")
def winsorized_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judgements(read(spark, sf_dir, "events")).groupBy("user_id", "event_type").agg(F.collect_list("score").alias("s"))
    return g.select("user_id", "event_type", F.size("s").cast("long").alias("n"), aggregate.winsorized(F.col("s")).alias("mean"))


@query(f"""{EIGHT_SQL}, c AS (SELECT user_id, event_type, CAST(2 * s[2] + s[3] + s[4] + s[5] + s[6] + 2 * s[7] AS DOUBLE) / 8 AS score_mean, CAST(list_sum(b) AS DOUBLE) / 8 AS pass_mean FROM e)
SELECT user_id, event_type, score_mean, score_mean < 8.0 AS score_flagged, pass_mean, pass_mean <= 5.0 AS pass_flagged FROM c""")
def cell_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sm, sf_ = aggregate.cell(F.col("samples"), F.lit("score"), F.lit(8))
    pm, pf = aggregate.cell(F.col("passes"), F.lit("bin"), F.lit(8))
    return eight(spark, sf_dir).select("user_id", "event_type", sm.alias("score_mean"), sf_.alias("score_flagged"), pm.alias("pass_mean"), pf.alias("pass_flagged"))


@query(f"""{N}, f AS (SELECT user_id, event_type, CASE WHEN k % 5 <> 0 THEN score > 3 END AS present, CASE WHEN k % 7 <> 0 THEN score > 5 END AS exact FROM j),
m AS (SELECT user_id, event_type, CASE WHEN count(present) > 0 THEN 2 * count(*) FILTER (present) > count(present) END AS present, CASE WHEN count(exact) > 0 THEN 2 * count(*) FILTER (exact) > count(exact) END AS exact FROM f GROUP BY ALL)
SELECT *, coalesce(present, true) AND coalesce(exact, true) AS passes, coalesce(present, false) AND coalesce(exact, false) AS passes_strictly FROM m""")
def panel_field_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = now(spark, sf_dir).select("user_id", "event_type", F.when(F.col("k") % 5 != 0, F.col("score") > 3).alias("present"), F.when(F.col("k") % 7 != 0, F.col("score") > 5).alias("exact"))
    lenient = aggregate.field_majority(f, ["user_id", "event_type"], ["present", "exact"], True)
    return lenient.withColumn("passes_strictly", F.coalesce("present", F.lit(False)) & F.coalesce("exact", F.lit(False)))


@query(f"""{N}, p AS (SELECT user_id, event_type, max(CASE WHEN replicate = 1 THEN CAST(flagged AS INT) END) AS a, max(CASE WHEN replicate = 2 THEN CAST(flagged AS INT) END) AS b, max(CASE WHEN replicate = 3 THEN CAST(flagged AS INT) END) AS t, count(flagged) AS n_votes, count(*) FILTER (NOT flagged) AS n_refuted FROM j GROUP BY ALL)
SELECT user_id, event_type, n_votes, n_refuted, a IS NOT NULL AND b IS NOT NULL AND a <> b AS split, CASE WHEN a = b THEN a = 1 WHEN a <> b AND t IS NOT NULL THEN t = 1 END AS is_real, CASE WHEN a = b THEN 'skeptics' WHEN a <> b AND t IS NOT NULL THEN 'tiebreak' ELSE 'incomplete' END AS decided_by FROM p""")
def panel_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = now(spark, sf_dir).withColumn("role", F.col("replicate").cast("string"))
    p = aggregate.panel(votes, ["user_id", "event_type"], "role", "flagged", ("1", "2"), "3")
    return p.withColumn("split", F.coalesce("split", F.lit(False)))


@query("""WITH r AS (SELECT doc_id, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS a, CASE toxic WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS b FROM labels)
SELECT doc_id, CASE WHEN a = 'low' OR b = 'low' THEN 'low' ELSE 'high' END AS grade, a <> b AS disputed FROM r""")
def rater_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("quality") == 1, "high").otherwise("low"), F.when(F.col("toxic") == 0, "high").otherwise("low")
    grade, disputed = aggregate.consensus(a, b, ("low", "high"))
    return read(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"), disputed.alias("disputed"))


CREDITS = {"full": {"full": 1.0, "partial": 0.5, "absent": 0.0}, "strict": {"full": 1.0, "partial": 0.0, "absent": 0.0}, "lenient": {"full": 1.0, "partial": 1.0, "absent": 0.0}}


@query(f"""{N}, f AS (SELECT user_id, CASE severity WHEN 'critical' THEN 4.0 WHEN 'supporting' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, CASE WHEN score > 7 THEN 'full' WHEN score > 3 THEN 'partial' ELSE 'absent' END AS v FROM j)
SELECT user_id, sum(w) AS weight, sum(w * CASE v WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END)::DOUBLE / sum(w) AS coverage,
  sum(w * CASE v WHEN 'full' THEN 1.0 ELSE 0.0 END)::DOUBLE / sum(w) AS strict, sum(w * CASE v WHEN 'absent' THEN 0.0 ELSE 1.0 END)::DOUBLE / sum(w) AS lenient,
  CAST(count(*) FILTER (v = 'full') + 0.5 * count(*) FILTER (v = 'partial') AS DOUBLE) / count(*) AS unweighted, bool_or(w = 4 AND v = 'absent') AS critical_absent FROM f GROUP BY user_id""")
def weighted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("severity") == "critical", 4.0).when(F.col("severity") == "supporting", 2.0).otherwise(1.0)
    verdict = F.when(F.col("score") > 7, "full").when(F.col("score") > 3, "partial").otherwise("absent")
    facts = now(spark, sf_dir).select("user_id", weight.alias("w"), verdict.alias("v"))

    def credit(rule: str):
        out = F.lit(0.0)
        for name, value in CREDITS[rule].items():
            out = F.when(F.col("v") == name, value).otherwise(out)
        return out

    total = F.sum("w")
    return facts.groupBy("user_id").agg(
        total.alias("weight"), *((F.sum(F.col("w") * credit(rule)) / total).alias(name) for rule, name in (("full", "coverage"), ("strict", "strict"), ("lenient", "lenient"))), F.avg(credit("full")).alias("unweighted"), F.bool_or((F.col("w") == 4) & (F.col("v") == "absent")).alias("critical_absent")
    )


@query(f"""{N}, d AS (SELECT user_id, replicate, max(CASE WHEN event_type = 'click' THEN score END) AS a, max(CASE WHEN event_type = 'error' THEN score END) AS b, max(CASE WHEN event_type = 'signup' THEN score END) AS c FROM j GROUP BY ALL)
SELECT user_id, replicate, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL ELSE least(a, b, c) END AS lowest, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL ELSE least(a, b, c) < 5 END AS flagged FROM d""")
def lowest_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = now(spark, sf_dir).groupBy("user_id", "replicate").agg(*(F.max(F.when(F.col("event_type") == e, F.col("score"))).alias(e) for e in ("click", "error", "signup")))
    low = aggregate.lowest(F.col("click"), F.col("error"), F.col("signup"))
    return d.select("user_id", "replicate", low.alias("lowest"), (low < 5).alias("flagged"))


@query(f"""{W}, c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM raw GROUP BY ALL)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS r FROM c) WHERE r = 1""")
def modal_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.modal(judgements(read(spark, sf_dir, "events")), ["user_id"], "event_type", "event_id")


@query("""WITH v AS (SELECT source, lang, count(*) AS votes FROM documents GROUP BY ALL), s AS (SELECT *, sum(votes) OVER (PARTITION BY source) AS size, row_number() OVER (PARTITION BY source ORDER BY votes DESC, lang) AS r FROM v)
SELECT source, CASE WHEN votes >= 0.6 * size THEN lang END AS lang, votes, CAST(size AS BIGINT) AS size FROM s WHERE r = 1""")
def cluster_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.placed(read(spark, sf_dir, "documents"), "source", "lang")


@query(f"""{N}, n AS (SELECT user_id, count(*) FILTER (flagged) AS c FROM j GROUP BY user_id)
SELECT user_id % 4 AS stratum, count(*) AS n, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c) AS DOUBLE) / count(*) AS mean, round(stddev_samp(c), 9) AS sd, quantile_cont(c, 0.5) AS median, max(c) AS most, CAST(count(*) FILTER (c > 0) AS DOUBLE) / count(*) AS any_rate FROM n GROUP BY ALL""")
def note_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = now(spark, sf_dir).groupBy("user_id").agg(F.count_if("flagged").alias("c"))
    return n.groupBy((F.col("user_id") % 4).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("total"), (F.sum("c") / F.count(F.lit(1))).alias("mean"), F.round(F.stddev_samp("c"), 9).alias("sd"), F.percentile("c", F.lit(0.5)).alias("median"), F.max("c").alias("most"), (F.count_if(F.col("c") > 0) / F.count(F.lit(1))).alias("any_rate")
    )


@query(f"""{N}, d AS (SELECT unnest(['omit', 'add', 'change']) AS pair_type), s AS (SELECT unnest(['critical', 'supporting', 'peripheral']) AS severity), g AS (SELECT pair_type, severity, count(*) AS n FROM j WHERE role = 'errored' GROUP BY ALL)
SELECT d.pair_type, s.severity, coalesce(n, 0) AS n FROM d CROSS JOIN s LEFT JOIN g USING (pair_type, severity)""")
def composition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(p, s) for p in ("omit", "add", "change") for s in ("critical", "supporting", "peripheral")], "pair_type string, severity string")
    g = now(spark, sf_dir).where("role = 'errored'").groupBy("pair_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(g, ["pair_type", "severity"], "left").select("pair_type", "severity", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{N}, p AS (SELECT severity, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM j) AS pool FROM j GROUP BY severity), d AS (SELECT severity, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM j WHERE flagged) AS drawn FROM j WHERE flagged GROUP BY severity),
m AS (SELECT severity, coalesce(pool, 0) AS pool, coalesce(drawn, 0) AS drawn, 100 * (coalesce(drawn, 0) - coalesce(pool, 0)) AS gap_pp FROM p FULL JOIN d USING (severity))
SELECT severity, round(pool, 9) AS pool, round(drawn, 9) AS drawn, round(gap_pp, 7) AS gap_pp, round(max(abs(gap_pp)) OVER (), 7) AS worst_pp FROM m""")
def marginal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = now(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("_a"), F.count_if("flagged").alias("_b"))
    everything = Window.partitionBy()  # three rows
    m = g.withColumn("pool", F.col("_a") / F.sum("_a").over(everything)).withColumn("drawn", F.col("_b") / F.sum("_b").over(everything)).withColumn("gap_pp", 100 * (F.col("drawn") - F.col("pool")))
    return m.select("severity", F.round("pool", 9).alias("pool"), F.round("drawn", 9).alias("drawn"), F.round("gap_pp", 7).alias("gap_pp"), F.round(F.max(F.abs("gap_pp")).over(everything), 7).alias("worst_pp"))


@query(f"""{N}, c AS (SELECT severity, coalesce(pair_type, 'none') AS pair_type, flagged FROM j), g AS (SELECT severity, pair_type, count(*) AS n, count(*) FILTER (flagged) AS kept, grouping_id(severity, pair_type) AS level FROM c GROUP BY GROUPING SETS ((severity, pair_type), (severity), (pair_type), ()))
SELECT severity, pair_type, CAST(level AS BIGINT) AS level, n, kept, CAST(kept AS DOUBLE) / n AS survival FROM g""")
def survival_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = now(spark, sf_dir).select("severity", F.coalesce("pair_type", F.lit("none")).alias("pair_type"), "flagged")
    sets = [[F.col("severity"), F.col("pair_type")], [F.col("severity")], [F.col("pair_type")], []]
    g = c.groupingSets(sets, "severity", "pair_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("kept"), F.grouping_id().alias("level"))
    return g.select("severity", "pair_type", F.col("level").cast("long").alias("level"), "n", "kept", (F.col("kept") / F.col("n")).alias("survival"))


@query(f"""{N}, r AS (SELECT user_id, bool_or(flagged) AS a, bool_or(flagged AND NOT parse_failure) AS b, bool_or(flagged AND severity = 'critical') AS c FROM j GROUP BY user_id)
SELECT count(*) AS notes, count(*) FILTER (a) AS lenient, count(*) FILTER (b) AS parsed, count(*) FILTER (c) AS critical FROM r""")
def note_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flagged")
    r = now(spark, sf_dir).groupBy("user_id").agg(F.bool_or(f).alias("a"), F.bool_or(f & ~F.col("parse_failure")).alias("b"), F.bool_or(f & (F.col("severity") == "critical")).alias("c"))
    return r.agg(F.count(F.lit(1)).alias("notes"), F.count_if("a").alias("lenient"), F.count_if("b").alias("parsed"), F.count_if("c").alias("critical"))


@query(f"""{N}, x AS (SELECT unnest(CASE WHEN k % 20 = 0 THEN [0] WHEN severity = 'peripheral' THEN [0, 1] WHEN score = 10 THEN [0, 1, 2] ELSE [0, 1, 2, 3] END) AS rung, flagged FROM j)
SELECT CAST(rung AS BIGINT) AS rung, count(*) AS n, count(*) FILTER (flagged) AS flags FROM x GROUP BY rung""")
def exclusion_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as exclusions add up: all, parsed, not peripheral, below the top score."""
    last = F.when(F.col("k") % 20 == 0, 0).when(F.col("severity") == "peripheral", 1).when(F.col("score") == 10, 2).otherwise(3).cast("long")
    x = now(spark, sf_dir).select("flagged", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("rung"))
    return x.groupBy("rung").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flags"))


@query(f"""{N} SELECT pair_type, count(*) FILTER (flagged AND severity = 'critical') AS tp, count(*) FILTER (flagged AND severity <> 'critical') AS fp, count(*) FILTER (NOT flagged AND severity = 'critical') AS fn, count(*) FILTER (NOT flagged AND severity <> 'critical') AS tn,
  CAST(count(*) FILTER (flagged AND severity = 'critical') AS DOUBLE) / nullif(count(*) FILTER (flagged), 0) AS "precision", CAST(count(*) FILTER (flagged AND severity = 'critical') AS DOUBLE) / nullif(count(*) FILTER (severity = 'critical'), 0) AS recall,
  2.0 * count(*) FILTER (flagged AND severity = 'critical') / nullif(count(*) FILTER (flagged) + count(*) FILTER (severity = 'critical'), 0)::DOUBLE AS f1 FROM j WHERE role = 'errored' GROUP BY pair_type""")
def classifier_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, said = F.col("severity") == "critical", F.col("flagged")
    g = now(spark, sf_dir).where("role = 'errored'").groupBy("pair_type").agg(*(F.count_if(c).alias(n) for n, c in (("tp", said & truth), ("fp", said & ~truth), ("fn", ~said & truth), ("tn", ~said & ~truth))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": tp / F.nullif(tp + fp, F.lit(0)), "recall": tp / F.nullif(tp + fn, F.lit(0)), "f1": 2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))})


@query("SELECT source, count(*) AS n, quantile_cont(length(text), 0.25) AS q25, quantile_cont(length(text), 0.5) AS median, quantile_cont(length(text), 0.9) AS q90, max(length(text)) AS longest FROM documents GROUP BY source")
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.percentile(n, F.lit(q)).alias(a) for q, a in ((0.25, "q25"), (0.5, "median"), (0.9, "q90"))), F.max(n).alias("longest"))


@query("""WITH c AS (SELECT l.quality AS a, 1 - l.toxic AS b FROM labels l), v AS (SELECT unnest([0, 1]) AS x) SELECT p.x AS a, CAST(count(*) FILTER (b = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (b = 1) AS BIGINT) AS n1 FROM v p LEFT JOIN c ON c.a = p.x GROUP BY p.x""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0,), (1,)], "a int")
    counted = read(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")).groupBy("a").pivot("b", [0, 1]).count()
    return rows.join(counted, "a", "left").select("a", F.coalesce("0", F.lit(0)).alias("n0"), F.coalesce("1", F.lit(0)).alias("n1"))


@query(f"""WITH l AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)
SELECT event_type, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cents) AS BIGINT) AS cents, CAST(count(*) FILTER (tokens % 4 = 0) AS DOUBLE) / count(*) AS cached_share FROM l GROUP BY event_type""")
def receipt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"), (F.count_if(tokens % 4 == 0) / F.count(F.lit(1))).alias("cached_share"))


@query(f"""{N}, c AS (SELECT user_id, event_type FROM j GROUP BY ALL HAVING count(DISTINCT replicate) = 3), f AS (SELECT user_id, event_type, replicate, CAST(flagged AS INT) AS x FROM j SEMI JOIN c USING (user_id, event_type)), s AS (SELECT user_id, event_type, stddev_samp(x) AS sd FROM f GROUP BY ALL)
SELECT event_type, count(*) AS notes, round(avg(sd), 9) AS mean_sd, round(max(sd), 9) AS max_sd FROM s GROUP BY event_type""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = now(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count_distinct("replicate").alias("runs"), F.stddev_samp(F.col("flagged").cast("int")).alias("sd")).where("runs = 3")
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("notes"), F.round(F.avg("sd"), 9).alias("mean_sd"), F.round(F.max("sd"), 9).alias("max_sd"))


@query(f"""{N}, r AS (SELECT stratum, pair_type, CAST(count(*) FILTER (flagged) AS DOUBLE) / count(*) AS rate FROM j WHERE role = 'errored' GROUP BY ALL)
SELECT a.pair_type, a.stratum, a.rate - b.rate AS delta FROM r a JOIN r b ON a.pair_type = b.pair_type AND b.stratum = 0 WHERE a.stratum <> 0""")
def arm_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = now(spark, sf_dir).where("role = 'errored'").groupBy("stratum", "pair_type").agg((F.count_if("flagged") / F.count(F.lit(1))).alias("rate"))
    base = r.where("stratum = 0").select("pair_type", F.col("rate").alias("_base"))
    return r.where("stratum <> 0").join(base, "pair_type").select("pair_type", "stratum", (F.col("rate") - F.col("_base")).alias("delta"))


@query(f"""{N}, s AS (SELECT DISTINCT user_id, severity, stratum FROM j WHERE flagged) SELECT severity, user_id % 10 AS bucket, array_to_string(list_sort(list(DISTINCT stratum)), ',') AS vendors FROM s GROUP BY ALL HAVING count(DISTINCT stratum) >= 2""")
def cross_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = now(spark, sf_dir).where("flagged").withColumn("bucket", F.col("user_id") % 10)
    return records.coinciding(s, ["severity", "bucket"], "stratum").withColumn("vendors", F.array_join("vendors", ","))


@query(f"""{N}, p AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN flagged::INT END) AS a, max(CASE WHEN event_type = 'error' THEN flagged::INT END) AS b FROM j GROUP BY user_id)
SELECT count(*) FILTER (a = 1 AND b = 1) AS "both", count(*) FILTER (a = 1 AND b = 0) AS first_only, count(*) FILTER (a = 0 AND b = 1) AS second_only, count(*) FILTER (a = 0 AND b = 0) AS neither FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.any_by_cluster(now(spark, sf_dir), "user_id", "event_type", F.col("flagged"), ("click", "error"))


def lf(x: str) -> str:
    return f"lgamma({x} + 1)"


MCNEMAR = f"""least(1.0, 2 * (SELECT sum(exp({lf("(b + c)")} - {lf("i")} - {lf("(b + c - i)")} - (b + c) * ln(2))) FROM (SELECT unnest(range(least(b, c) + 1)) AS i)))"""


@query(f"""{T}, d AS (SELECT pair_type, replicate, count(*) FILTER (flagged AND NOT clean_flagged) AS b, count(*) FILTER (NOT flagged AND clean_flagged) AS c FROM tw GROUP BY ALL), p AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE {MCNEMAR} END AS p FROM d),
h AS (SELECT *, row_number() OVER (PARTITION BY pair_type ORDER BY p, replicate) AS i, count(*) OVER (PARTITION BY pair_type) AS m FROM p)
SELECT pair_type, replicate, b, c, round(p, 7) AS p, round(max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY pair_type ORDER BY p, replicate ROWS UNBOUNDED PRECEDING), 7) AS p_holm FROM h""")
def mcnemar_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = F.col("flagged"), F.col("clean_flagged")
    d = pairs(spark, sf_dir).groupBy("pair_type", "replicate").agg(F.count_if(f & ~c).alias("b"), F.count_if(~f & c).alias("c"))
    tested = stats.holm(d.withColumn("p", stats.binomial_two_sided("b", "c")), "p", "pair_type", "replicate")
    return tested.withColumns({"p": F.round("p", 7), "p_holm": F.round("p_holm", 7)})


@query(f"""{T}, d AS (SELECT pair_type, count(*) FILTER (score < clean_score) AS b, count(*) FILTER (score > clean_score) AS c FROM tw GROUP BY pair_type) SELECT pair_type, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {MCNEMAR} END, 7) AS p FROM d""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir).groupBy("pair_type").agg(F.count_if(F.col("score") < F.col("clean_score")).alias("b"), F.count_if(F.col("score") > F.col("clean_score")).alias("c"))
    return d.withColumn("p", F.round(stats.binomial_two_sided("b", "c"), 7))


@query(f"""{N}, g AS (SELECT stratum, count(*) FILTER (role = 'errored' AND flagged) AS k1, count(*) FILTER (role = 'errored') AS n1, count(*) FILTER (role = 'clean' AND flagged) AS k2, count(*) FILTER (role = 'clean') AS n2 FROM j GROUP BY stratum), p AS (SELECT *, CAST(k1 + k2 AS DOUBLE) / (n1 + n2) AS q FROM g)
SELECT stratum, k1, n1, k2, n2, round(CASE WHEN n1 > 0 AND n2 > 0 AND q * (1 - q) > 0 THEN (CAST(k1 AS DOUBLE) / n1 - CAST(k2 AS DOUBLE) / n2) / sqrt(q * (1 - q) * (1.0 / n1 + 1.0 / n2)) END, 7) AS z FROM p""")
def two_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = F.col("role") == "errored", F.col("flagged")
    g = now(spark, sf_dir).groupBy("stratum").agg(F.count_if(e & f).alias("k1"), F.count_if(e).alias("n1"), F.count_if(~e & f).alias("k2"), F.count_if(~e).alias("n2"))
    return g.withColumns({"z": F.round(stats.two_proportion_z("k1", "n1", "k2", "n2"), 7)})


@query(f"""{T}, d AS (SELECT pair_type, replicate, count(*) AS n, count(*) FILTER (flagged AND NOT clean_flagged) AS b, count(*) FILTER (NOT flagged AND clean_flagged) AS c FROM tw GROUP BY ALL), w AS (SELECT *, CAST(b - c AS DOUBLE) / n AS delta, sqrt(greatest(b + c - CAST((b - c) * (b - c) AS DOUBLE) / n, 0)) / n AS se FROM d)
SELECT pair_type, replicate, n, b, c, round(delta, 6) AS delta, round(delta - 1.96 * se, 6) AS low, round(delta + 1.96 * se, 6) AS high FROM w""")
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag rate of errored notes less that of their clean twins, with the Wald interval on discordant pairs."""
    f, c = F.col("flagged"), F.col("clean_flagged")
    d = pairs(spark, sf_dir).groupBy("pair_type", "replicate").agg(F.count(F.lit(1)).alias("n"), F.count_if(f & ~c).alias("b"), F.count_if(~f & c).alias("c"))
    return d.withColumns({k: F.round(v, 6) for k, v in zip(("delta", "low", "high"), stats.paired_wald("b", "c", "n"), strict=True)})


def hyper(x: str) -> str:
    return f"exp({lf('r')} - {lf(x)} - {lf(f'(r - {x})')} + {lf('(n - r)')} - {lf(f'(k - {x})')} - {lf(f'(n - r - k + {x})')} - {lf('n')} + {lf('k')} + {lf('(n - k)')})"


@query(f"""{N}, g AS (SELECT stratum, severity, count(*) FILTER (role = 'errored' AND flagged) AS a, count(*) FILTER (role = 'errored' AND NOT flagged) AS b, count(*) FILTER (role = 'clean' AND flagged) AS c, count(*) FILTER (role = 'clean' AND NOT flagged) AS d FROM j GROUP BY ALL),
s AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM g)
SELECT stratum, severity, a, b, c, d, round((SELECT least(1.0, sum(CASE WHEN p <= h * (1 + 1e-9) THEN p ELSE 0 END)) FROM (SELECT {hyper("x")} AS p, {hyper("a")} AS h FROM (SELECT unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS x))), 6) AS p,
  round((SELECT least(1.0, sum(CASE WHEN x >= a THEN {hyper("x")} ELSE 0 END)) FROM (SELECT unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS x)), 6) AS p_right FROM s""")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, f = F.col("role") == "errored", F.col("flagged")
    g = now(spark, sf_dir).groupBy("stratum", "severity").agg(F.count_if(e & f).alias("a"), F.count_if(e & ~f).alias("b"), F.count_if(~e & f).alias("c"), F.count_if(~e & ~f).alias("d"))
    two, right = stats.fisher("a", "b", "c", "d")
    return g.withColumns({"p": F.round(two, 6), "p_right": F.round(right, 6)})


@query("""WITH r AS (SELECT source, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)), n AS (SELECT source, count(*) AS n, count(*) FILTER (a = b) AS agree, count(*) FILTER (a = 0) AS a0, count(*) FILTER (b = 0) AS b0 FROM r GROUP BY source),
k AS (SELECT *, CAST(agree AS DOUBLE) / n AS observed, CAST(a0 * b0 + (n - a0) * (n - b0) AS DOUBLE) / (n * n) AS chance FROM n)
SELECT source, n, agree, observed, chance, round(CASE WHEN chance < 1 THEN (observed - chance) / (1 - chance) END, 9) AS kappa FROM k""")
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    k = stats.kappa(r, "a", "b", ["source"])
    return k.select("source", "n", F.col("agree").cast("long").alias("agree"), "observed", F.col("chance").cast("double").alias("chance"), F.round("kappa", 9).alias("kappa"))


@query("""WITH x AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0::DOUBLE AS x FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM x)
SELECT event_type, count(*) AS n, round(max(greatest(CAST(i AS DOUBLE) / n - x, x - CAST(i - 1 AS DOUBLE) / n)), 9) AS d FROM r GROUP BY event_type""")
def ks_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "events").select("event_type", (F.get_json_object("props", "$.k").cast("long") / 100.0).alias("x"))
    return stats.ks_uniform(x, "x", "event_type").withColumn("d", F.round("d", 9))


@query("""WITH v AS (SELECT label AS a, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM v GROUP BY ALL),
i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c), ra AS (SELECT sum(s * (s - 1) / 2) AS x FROM (SELECT sum(n) AS s FROM c GROUP BY a)), rb AS (SELECT sum(s * (s - 1) / 2) AS y FROM (SELECT sum(n) AS s FROM c GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, round((i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 9) AS ari FROM i, ra, rb""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    v = read(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), (F.when(e[0] > 0, 1).otherwise(0) + F.when(e[1] > 0, 2).otherwise(0)).alias("b"))
    return stats.adjusted_rand(v, "a", "b").select("n", F.round("ari", 9).alias("ari"))


@query("""WITH d AS (SELECT CAST(length(text) AS DOUBLE) AS x, CAST(len(string_split(text, ' ')) AS DOUBLE) AS y FROM documents) SELECT count(*) AS n, round(regr_slope(y, x), 7) AS slope, round(regr_intercept(y, x), 4) AS intercept, CAST(sum(floor(y / 128) * 128 * CAST(y > 1024 AS INT)) AS BIGINT) AS cached_tokens FROM d""")
def token_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words against characters, and tokens that a prefix cache of 128-token blocks above 1024 would hold."""
    x, y = F.length("text").cast("double"), F.size(F.split("text", " ", -1)).cast("double")
    d = read(spark, sf_dir, "documents").where("text is not null").select(x.alias("x"), y.alias("y"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "x"), 7).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.sum(F.when(F.col("y") > 1024, F.floor(F.col("y") / 128) * 128).otherwise(0)).alias("cached_tokens"))


@query(f"{T}, {bootstrap.draws_sql('SELECT user_id AS c, sum(2 * CAST(score < clean_score AS INT) + CAST(score = clean_score AS INT)) AS num, 2 * count(*) AS den FROM tw GROUP BY user_id')}")
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of tie-adjusted discrimination, resampling consultations."""
    s, c = F.col("score"), F.col("clean_score")
    per = pairs(spark, sf_dir).groupBy("user_id").agg(F.sum(2 * (s < c).cast("int") + (s == c).cast("int")).alias("num"), (2 * F.count(F.lit(1))).alias("den"))
    return _rounded(bootstrap.bootstrap(per, "user_id", "num", "den"))


@query(f"{N}, {bootstrap.draws_sql('SELECT user_id AS c, count(*) FILTER (flagged) AS num, count(*) AS den FROM j GROUP BY user_id')}")
def bootstrap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = now(spark, sf_dir).groupBy("user_id").agg(F.count_if("flagged").alias("num"), F.count(F.lit(1)).alias("den"))
    return _rounded(bootstrap.bootstrap(per, "user_id", "num", "den"))


@query(f"{N}, {bootstrap.draws_sql('''SELECT user_id AS c, count(*) FILTER (severity = 'critical' AND flagged) AS num, count(*) FILTER (flagged) AS den FROM j GROUP BY user_id''')}")
def bootstrap_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of critical ones among what survived."""
    per = now(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("flagged") & (F.col("severity") == "critical")).alias("num"), F.count_if("flagged").alias("den"))
    return _rounded(bootstrap.bootstrap(per, "user_id", "num", "den"))


CHANCE = "((a + b) * (a + e) + (e + d) * (b + d)) / (m * m)"
CONFUSION_SQL = "SELECT user_id AS c, count(*) FILTER (flagged AND clean_flagged) AS a, count(*) FILTER (flagged AND NOT clean_flagged) AS b, count(*) FILTER (NOT flagged AND clean_flagged) AS e, count(*) FILTER (NOT flagged AND NOT clean_flagged) AS d, count(*) AS m FROM tw GROUP BY user_id"


@query(f"{T}, {bootstrap.resampled_sql(CONFUSION_SQL, ['a', 'b', 'e', 'd', 'm'], f'((a + d) / m - {CHANCE}) / nullif(1 - {CHANCE}, 0)', least=100)}")
def bootstrap_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of Cohen's kappa between flags on errored notes and on their twins; half of the draws must have a kappa."""
    f, c = F.col("flagged"), F.col("clean_flagged")
    per = pairs(spark, sf_dir).groupBy("user_id").agg(F.count_if(f & c).alias("a"), F.count_if(f & ~c).alias("b"), F.count_if(~f & c).alias("e"), F.count_if(~f & ~c).alias("d"), F.count(F.lit(1)).alias("m"))
    a, b, e, d, m = (F.col(x).cast("double") for x in "abedm")
    chance = ((a + b) * (a + e) + (e + d) * (b + d)) / (m * m)
    return _rounded(bootstrap.resampled(per, "user_id", list("abedm"), ((a + d) / m - chance) / F.nullif(1 - chance, F.lit(0.0)), least=100))


MEANS, DIFFERENCE = ["s1", "n1", "s2", "n2"], "s1 / nullif(n1, 0) - s2 / nullif(n2, 0)"
STRATA_SQL = "SELECT user_id AS c, sum(score) FILTER (severity = 'critical') AS s1, count(*) FILTER (severity = 'critical') AS n1, sum(score) FILTER (severity <> 'critical') AS s2, count(*) FILTER (severity <> 'critical') AS n2 FROM j GROUP BY user_id"
FLAGGED_SQL = "SELECT user_id AS c, sum(score) FILTER (flagged) AS s1, count(*) FILTER (flagged) AS n1, sum(score) AS s2, count(*) AS n2 FROM j GROUP BY user_id"


def _difference() -> Column:
    return F.col("s1") / F.nullif(F.col("n1"), F.lit(0)) - F.col("s2") / F.nullif(F.col("n2"), F.lit(0))


@query(f"{N}, {bootstrap.resampled_sql(STRATA_SQL, MEANS, DIFFERENCE)}")
def bootstrap_two_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of critical facts less that of the others, resampling consultations that may hold both."""
    critical, other = F.col("severity") == "critical", F.col("severity") != "critical"
    per = now(spark, sf_dir).groupBy("user_id").agg(F.sum(F.when(critical, F.col("score"))).alias("s1"), F.count_if(critical).alias("n1"), F.sum(F.when(other, F.col("score"))).alias("s2"), F.count_if(other).alias("n2"))
    return _rounded(bootstrap.resampled(per, "user_id", MEANS, _difference()))


@query(f"{N}, {bootstrap.resampled_sql(FLAGGED_SQL, MEANS, DIFFERENCE)}")
def bootstrap_verified_minus_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of what was flagged less the mean of all, each draw taking both from the same consultations."""
    per = now(spark, sf_dir).groupBy("user_id").agg(F.sum(F.when(F.col("flagged"), F.col("score"))).alias("s1"), F.count_if("flagged").alias("n1"), F.sum("score").alias("s2"), F.count(F.lit(1)).alias("n2"))
    return _rounded(bootstrap.resampled(per, "user_id", MEANS, _difference()))


@query(f"""{T}, m AS (SELECT pair_type, w.score AS ws, l.score AS ls, w.clean_score AS wc, l.clean_score AS lc, w.flagged AS wf, l.flagged AS lf FROM tw w JOIN tw l USING (user_id, event_type, pair_type) WHERE w.replicate = 2 AND l.replicate = 1),
o AS (SELECT pair_type, CAST(2 * (ws < wc)::INT + (ws = wc)::INT AS BIGINT) AS hw, CAST(2 * (ls < lc)::INT + (ls = lc)::INT AS BIGINT) AS hl, wf, lf FROM m),
g AS (SELECT pair_type, count(*) AS n, CAST(sum(hw) AS DOUBLE) / (2 * count(*)) AS winner, CAST(sum(hl) AS DOUBLE) / (2 * count(*)) AS baseline, count(*) FILTER (wf AND NOT lf) AS b1, count(*) FILTER (lf AND NOT wf) AS c1, count(*) FILTER (hw > hl) AS b2, count(*) FILTER (hw < hl) AS c2 FROM o GROUP BY pair_type),
f AS (SELECT *, b1 AS b, c1 AS c FROM g), f1 AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE {MCNEMAR} END AS p_flags FROM f), s AS (SELECT * EXCLUDE (b, c), b2 AS b, c2 AS c FROM f1)
SELECT pair_type, n, winner, baseline, round(winner - baseline, 9) AS delta, b1 AS flags_gained, c1 AS flags_lost, round(p_flags, 7) AS p_flags, b2 AS pairs_gained, c2 AS pairs_lost, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {MCNEMAR} END, 7) AS p_pairs FROM s""")
def winner_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One arm (the second replicate) against another on the same pairs: discrimination, flags by McNemar's test, pairs by the sign test."""

    def half(score: str, clean: str) -> Column:
        return 2 * (F.col(score) < F.col(clean)).cast("long") + (F.col(score) == F.col(clean)).cast("long")

    arms = pairs(spark, sf_dir).select("user_id", "event_type", "pair_type", "replicate", "flagged", half("score", "clean_score").alias("h"))
    arm = [F.first(F.when(F.col("replicate") == r, F.col(c)), True).alias(f"{c}{r}") for r in (1, 2) for c in ("h", "flagged")]
    both = arms.where("replicate in (1, 2)").groupBy("user_id", "event_type", "pair_type").agg(*arm).where("h1 is not null and h2 is not null")
    g = both.groupBy("pair_type").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("h2") / (2 * F.count(F.lit(1)))).alias("winner"), (F.sum("h1") / (2 * F.count(F.lit(1)))).alias("baseline"),
        F.count_if(F.col("flagged2") & ~F.col("flagged1")).alias("flags_gained"), F.count_if(F.col("flagged1") & ~F.col("flagged2")).alias("flags_lost"),
        F.count_if(F.col("h2") > F.col("h1")).alias("pairs_gained"), F.count_if(F.col("h2") < F.col("h1")).alias("pairs_lost"),
    )
    p = {f"p_{k}": F.round(stats.binomial_two_sided(f"{k}_gained", f"{k}_lost"), 7) for k in ("flags", "pairs")}
    return g.withColumns({"delta": F.round(F.col("winner") - F.col("baseline"), 9), **p})


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high")})
