"""Rules that differ on purpose between analyses, and panel, residual and roster statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import stats
from assaykit.operators import bootstrap, metrics, notes, sampling
from assaykit.operators.sections import STRENGTH
from assaykit.plans.judging import N, T, now, pairs
from assaykit.plans.registry import query
from assaykit.sources.files import newest_release
from assaykit.sources.tables import read
from assaykit.streaming.latest import work_folder

DRAWN_SQL = f"""{T}, {bootstrap.slots_sql("SELECT DISTINCT user_id AS c FROM tw", 200)}, sm AS (SELECT user_id, sum(2 * CAST(score < clean_score AS INT) + CAST(score = clean_score AS INT)) AS num, 2 * count(*) AS den FROM tw GROUP BY user_id),
dv AS (SELECT draw, CAST(sum(times * num) AS DOUBLE) / sum(times * den) AS v FROM tm JOIN sm ON sm.user_id = tm.c GROUP BY draw), dl AS (SELECT list_sort(list(v)) AS l, count(v) AS n FROM dv)"""


@query(f"""{DRAWN_SQL}, ru AS (SELECT unnest(['linear', 'floor', 'inner', 'outer']) AS rule)
SELECT rule, n AS valid, round(CASE rule WHEN 'linear' THEN list_aggregate(l, 'quantile_cont', 0.025) WHEN 'outer' THEN l[CAST(floor(0.025 * n) AS INT)] ELSE l[CAST(floor(0.025 * n) AS INT) + 1] END, 9) AS low,
  round(CASE rule WHEN 'linear' THEN list_aggregate(l, 'quantile_cont', 0.975) WHEN 'inner' THEN l[CAST(floor(0.975 * n) AS INT)] ELSE l[CAST(floor(0.975 * n) AS INT) + 1] END, 9) AS high FROM dl, ru""")
def bootstrap_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of paired discrimination by each rule for which of the sorted draws are its ends."""
    tw = pairs(spark, sf_dir)
    e, c = F.col("score"), F.col("clean_score")
    per = tw.groupBy("user_id").agg((2 * F.count_if(e < c) + F.count_if(e == c)).alias("num"), (2 * F.count(F.lit(1))).alias("den"))
    drawn = bootstrap.multiplicities(per, "user_id", 200).join(per, "user_id").groupBy("draw").agg((F.sum(F.col("times") * F.col("num")) / F.sum(F.col("times") * F.col("den"))).alias("v"))
    return bootstrap.percentile_rules(drawn, "v").withColumns({x: F.round(x, 9) for x in ("low", "high")})


@query(f"""{T}, x AS (SELECT pair_type, parse_failure OR clean_failure AS bad, score, clean_score FROM tw), r AS (SELECT unnest(['as a tie', 'as a loss', 'left out']) AS failures)
SELECT failures, pair_type, count(*) FILTER (NOT (bad AND failures = 'left out')) AS n, count(*) FILTER (NOT bad AND score < clean_score) AS wins, count(*) FILTER ((NOT bad AND score = clean_score) OR (bad AND failures = 'as a tie')) AS ties,
  round((2.0 * count(*) FILTER (NOT bad AND score < clean_score) + count(*) FILTER ((NOT bad AND score = clean_score) OR (bad AND failures = 'as a tie'))) / (2 * count(*) FILTER (NOT (bad AND failures = 'left out'))), 9) AS paired FROM x, r GROUP BY failures, pair_type""")
def parse_failure_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired discrimination with pairs of which a reply could not be read as ties, as losses, or left out."""
    out: DataFrame | None = None
    for rule in ("tie", "loss", "out"):
        own = metrics.paired_with_failures(pairs(spark, sf_dir), ["pair_type"], rule)
        own = own.select(F.lit({"tie": "as a tie", "loss": "as a loss", "out": "left out"}[rule]).alias("failures"), "pair_type", "n", "wins", "ties", F.round("paired", 9).alias("paired"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""{N}, r AS (SELECT unnest(['at most 7', 'below 5', 'below 1']) AS rule, unnest([7.0, 4.999999, 0.999999]) AS cut), x AS (SELECT rule, role, parse_failure, score <= cut AS hit FROM j, r)
SELECT rule, role, count(*) FILTER (NOT parse_failure) AS n, count(*) FILTER (hit AND NOT parse_failure) AS flags, round(count(*) FILTER (hit AND NOT parse_failure) / CAST(count(*) FILTER (NOT parse_failure) AS DOUBLE), 9) AS rate FROM x GROUP BY rule, role""")
def flag_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of clean and errored notes by three cut-offs; replies that could not be read flag nothing and don't count."""
    s = F.col("score")
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), hit.alias("hit")) for name, hit in (("at most 7", s <= 7), ("below 5", s < 5), ("below 1", s < 1))))
    x = now(spark, sf_dir).where(~F.col("parse_failure")).select("role", F.explode(rules).alias("r")).select("role", "r.*")
    return x.groupBy("rule", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("flags"), F.round(F.count_if("hit") / F.count(F.lit(1)), 9).alias("rate"))


@query(f"""{N}, v AS (SELECT user_id, event_type, bool_or(flagged) FILTER (replicate = 1) AS a, bool_or(flagged) FILTER (replicate = 2) AS b, bool_or(flagged) FILTER (replicate = 3) AS t FROM j GROUP BY ALL), f AS (SELECT *, a <> b AS split, CASE WHEN a = b THEN a ELSE t END AS real FROM v WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n_findings, count(*) FILTER (split) AS n_split, round(count(*) FILTER (split) / CAST(count(*) AS DOUBLE), 9) AS split_rate, round(count(*) FILTER (NOT a) / CAST(count(*) AS DOUBLE), 9) AS refute_first, round(count(*) FILTER (NOT b) / CAST(count(*) AS DOUBLE), 9) AS refute_second,
  count(*) FILTER (split AND t IS NOT NULL AND t = a) AS tiebreak_first, count(*) FILTER (split AND t IS NOT NULL AND t = b) AS tiebreak_second, count(*) FILTER (split AND t IS NULL) AS undecided, count(*) FILTER (real) AS verified FROM f""")
def panel_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two voters and a third for splits did: how often each refuted, and with whom the third sided."""
    votes = [F.bool_or(F.when(F.col("replicate") == r, F.col("flagged"))).alias(n) for r, n in ((1, "a"), (2, "b"), (3, "t"))]
    v = now(spark, sf_dir).groupBy("user_id", "event_type").agg(*votes).where("a is not null and b is not null")
    a, b, t, n = F.col("a"), F.col("b"), F.col("t"), F.count(F.lit(1))
    split = a != b
    return v.agg(
        n.alias("n_findings"), F.count_if(split).alias("n_split"), F.round(F.count_if(split) / n, 9).alias("split_rate"), F.round(F.count_if(~a) / n, 9).alias("refute_first"), F.round(F.count_if(~b) / n, 9).alias("refute_second"),
        F.count_if(split & (t == a)).alias("tiebreak_first"), F.count_if(split & (t == b)).alias("tiebreak_second"), F.count_if(split & t.isNull()).alias("undecided"), F.count_if(F.when(split, t).otherwise(a)).alias("verified"),
    )


GRADES = ", ".join(f"'{s}'" for s in STRENGTH)


@query(f"""{N}, s AS (SELECT user_id, event_type AS quote, replicate, CASE WHEN k % 4 < 3 THEN [{GRADES}][k % 4 + 1] END AS grade FROM j WHERE NOT parse_failure), g AS (SELECT user_id, quote, grade, count(*) AS n, min(replicate) AS first FROM s WHERE grade IS NOT NULL GROUP BY ALL),
m AS (SELECT user_id, quote, grade FROM (SELECT *, row_number() OVER (PARTITION BY user_id, quote ORDER BY n DESC, first, grade) AS r FROM g) WHERE r = 1), q AS (SELECT user_id, quote, count(DISTINCT replicate) AS seeds FROM s GROUP BY ALL)
SELECT user_id, count(*) AS n_verified, string_agg(quote || ':' || coalesce(grade, '-') || ':' || seeds, ' ' ORDER BY quote) AS sites, [{GRADES}][min(list_position([{GRADES}], grade))] AS strongest FROM q LEFT JOIN m USING (user_id, quote) GROUP BY user_id""")
def residual_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that runs found word for word: each with its most frequent grade (the earlier run's of equals), and the strongest of a consultation."""
    grade = F.get(F.array(*map(F.lit, STRENGTH)), (F.col("k") % 4).cast("int"))
    s = now(spark, sf_dir).where(~F.col("parse_failure")).select("user_id", F.col("event_type").alias("quote"), "replicate", grade.alias("grade"))
    g = s.groupBy("user_id", "quote", "grade").agg(F.count(F.lit(1)).alias("n"), F.min("replicate").alias("first"))
    best = F.min(F.when(F.col("grade").isNotNull(), F.struct(-F.col("n"), "first", "grade")))["grade"]
    q = g.groupBy("user_id", "quote").agg(best.alias("grade")).join(s.groupBy("user_id", "quote").agg(F.count_distinct("replicate").alias("seeds")), ["user_id", "quote"])
    rank = F.coalesce(*(F.when(F.col("grade") == x, i) for i, x in enumerate(STRENGTH)))
    site = F.concat_ws(":", "quote", F.coalesce("grade", F.lit("-")), F.col("seeds").cast("string"))
    out = q.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_verified"), F.array_join(F.array_sort(F.collect_list(site)), " ").alias("sites"), F.min(rank).alias("_r"))
    return out.select("user_id", "n_verified", "sites", F.get(F.array(*map(F.lit, STRENGTH)), F.col("_r")).alias("strongest"))


@query(f"""{N}, r AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey <= 400), c AS (SELECT user_id, count(*) FILTER (flagged) AS c FROM j GROUP BY user_id), x AS (SELECT r.user_id % 4 AS stratum, coalesce(c, 0) AS c, c.user_id IS NULL AS silent FROM r LEFT JOIN c USING (user_id))
SELECT stratum, count(*) AS n, count(*) FILTER (silent) AS without_records, CAST(sum(c) AS BIGINT) AS total, round(sum(c) / CAST(count(*) AS DOUBLE), 9) AS mean, round(count(*) FILTER (c > 0) / CAST(count(*) AS DOUBLE), 9) AS any_rate FROM x GROUP BY stratum""")
def roster_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags per consultation of a roster; one without any record counts as none."""
    roster = read(spark, sf_dir, "customer").where("c_custkey <= 400").select(F.col("c_custkey").alias("user_id"))
    c = now(spark, sf_dir).groupBy("user_id").agg(F.count_if("flagged").alias("c"))
    x = roster.join(c, "user_id", "left").select((F.col("user_id") % 4).alias("stratum"), F.coalesce("c", F.lit(0)).alias("n"), F.col("c").isNull().alias("silent"))
    return x.groupBy("stratum").agg(F.count(F.lit(1)).alias("_all"), F.count_if("silent").alias("without_records"), F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("_any")).select(
        "stratum", F.col("_all").alias("n"), "without_records", "total", F.round(F.col("total") / F.col("_all"), 9).alias("mean"), F.round(F.col("_any") / F.col("_all"), 9).alias("any_rate")
    )


@query("""WITH RECURSIVE u AS (SELECT vec_id, vec_id // 25 AS note, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), w AS (SELECT vec_id, note, list_append(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))), 2.2) AS v FROM u),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / (1 + 2.2 * 2.2) AS c FROM w a JOIN w b ON a.note = b.note AND a.vec_id <> b.vec_id), l AS (SELECT unnest([0.8, 0.85, 0.9]::DOUBLE[]) AS level),
r AS (SELECT level, vec_id AS node, vec_id AS label FROM w, l UNION SELECT r.level, p.b, r.label FROM r JOIN p ON p.a = r.node AND p.c >= r.level), g AS (SELECT level, node, min(label) AS label FROM r GROUP BY ALL), d AS (SELECT level, count(*) AS items, count(DISTINCT label) AS n_distinct FROM g GROUP BY level)
SELECT d.level, items, (SELECT count(*) FROM p WHERE a < b AND c >= d.level) AS merged_pairs, n_distinct, round(items / CAST(n_distinct AS DOUBLE), 3) AS factor FROM d""")
def cosine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates within notes at three cosines: merged pairs, distinct items, and the factor by which these are fewer.

    The vectors get one large common component, so that some of them are near each other.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    v = read(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.floor(F.col("vec_id") / 25).cast("long").alias("note"), e.alias("e")).withColumn("_s", size)
    v = v.select("vec_id", "note", F.concat(F.transform("e", lambda x: x / F.col("_s")), F.array(F.lit(2.2))).alias("v"))
    per = notes.cosine_groups(v, ["note"], "vec_id", "v", (0.8, 0.85, 0.9))
    return per.groupBy("level").agg(F.sum("items").alias("items"), F.sum("pairs").alias("merged_pairs"), F.sum("groups").alias("n_distinct"), F.round(F.sum("items") / F.sum("groups"), 3).alias("factor"))


@query(f"""{N}, {bootstrap.resampled_sql("SELECT user_id AS c, count(*) FILTER (flagged AND severity = 'critical') AS a, count(*) FILTER (severity = 'critical') AS b, count(*) FILTER (flagged AND severity = 'peripheral') AS d, count(*) FILTER (severity = 'peripheral') AS e FROM j GROUP BY user_id", ["a", "b", "d", "e"], "a / nullif(b, 0) - d / nullif(e, 0)")}""")
def bootstrap_standard_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two standards' rates, resampling consultations."""
    j = now(spark, sf_dir)
    parts = {n: F.count_if(c).cast("double") for s, (n1, n2) in (("critical", "ab"), ("peripheral", "de")) for n, c in ((n1, F.col("flagged") & (F.col("severity") == s)), (n2, F.col("severity") == s))}
    per = j.groupBy("user_id").agg(*(c.alias(n) for n, c in parts.items()))
    value = F.col("a") / F.nullif(F.col("b"), F.lit(0.0)) - F.col("d") / F.nullif(F.col("e"), F.lit(0.0))
    return bootstrap.resampled(per, "user_id", ["a", "b", "d", "e"], value).withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high")})


@query(f"""{N}, f AS (SELECT user_id, CASE severity WHEN 'critical' THEN 4.0 WHEN 'supporting' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, CASE WHEN score > 7 THEN 1.0 WHEN score > 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS c, score > 3 AND k % 6 = 0 AS flipped FROM j)
SELECT user_id, round(sum(w * c) / sum(w), 9) AS refuted, round(sum(w * CASE WHEN flipped THEN 0.0 ELSE c END) / sum(w), 9) AS unrefuted, count(*) FILTER (flipped) AS flips FROM f GROUP BY user_id""")
def coverage_without_refutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted coverage as judged, and with what a second look turned from absent turned back."""
    w = F.when(F.col("severity") == "critical", 4.0).when(F.col("severity") == "supporting", 2.0).otherwise(1.0)
    credit = F.when(F.col("score") > 7, 1.0).when(F.col("score") > 3, 0.5).otherwise(0.0)
    flipped = (F.col("score") > 3) & (F.col("k") % 6 == 0)
    f = now(spark, sf_dir).select("user_id", w.alias("w"), credit.alias("c"), flipped.alias("flipped"))
    return f.groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("c")) / F.sum("w"), 9).alias("refuted"), F.round(F.sum(F.when(F.col("flipped"), 0.0).otherwise(F.col("w") * F.col("c"))) / F.sum("w"), 9).alias("unrefuted"), F.count_if("flipped").alias("flips"))


AUC_SQL = "CAST(sum(2 * pos * above + pos * neg) AS DOUBLE) / nullif(2 * sum(pos) * sum(neg), 0)"


@query(f"""{T}, sc AS (SELECT replicate, score AS s, count(*) FILTER (role = 'errored') AS pos, count(*) FILTER (role = 'clean') AS neg FROM j WHERE score IS NOT NULL GROUP BY ALL), ab AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY replicate ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM sc), au AS (SELECT replicate, {AUC_SQL} AS auc FROM ab GROUP BY replicate),
g AS (SELECT replicate, CASE severity WHEN 'critical' THEN 3 WHEN 'supporting' THEN 2 ELSE 1 END AS x, clean_score - score AS y, count(*) AS w FROM tw WHERE pair_type = 'omit' AND NOT parse_failure AND NOT clean_failure GROUP BY ALL),
mr AS (SELECT *, sum(w) OVER (PARTITION BY replicate ORDER BY x RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY replicate, x) - 1) / 2 AS rx, sum(w) OVER (PARTITION BY replicate ORDER BY y RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY replicate, y) - 1) / 2 AS ry FROM g),
sm AS (SELECT replicate, CAST(sum(w) AS DOUBLE) AS n, sum(w * rx) AS sx, sum(w * ry) AS sy, sum(w * rx * rx) AS xx, sum(w * ry * ry) AS yy, sum(w * rx * ry) AS xy FROM mr GROUP BY replicate), rh AS (SELECT replicate, (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) AS rho, n FROM sm)
SELECT count(*) AS runs, round(avg(auc), 9) AS auc_mean, round(stddev_samp(auc), 9) AS auc_sd, round(avg(rho), 9) AS rho_mean, round(stddev_samp(rho), 9) AS rho_sd, CAST(min(n) AS BIGINT) AS fewest_pairs FROM au JOIN rh USING (replicate)""")
def cell_rank_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's AUC and its rank correlation of importance with the score gap: mean and deviation over runs."""
    j = now(spark, sf_dir)
    auc = metrics.auc(metrics.score_counts(j, ["replicate"], "score", F.col("role") == "errored"), ["replicate"]).select("replicate", "auc")
    x = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "supporting", 2).otherwise(1)
    sound = pairs(spark, sf_dir).where("pair_type = 'omit' and not parse_failure and not clean_failure")
    cells = sound.groupBy("replicate", x.alias("x"), (F.col("clean_score") - F.col("score")).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    both = auc.join(bootstrap.weighted_spearman(cells, ["replicate"], "x", "y", "w"), "replicate")
    out = both.agg(F.count(F.lit(1)).alias("runs"), *(f(c).alias(f"{c}_{n}") for c in ("auc", "rho") for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))), F.min("n").cast("long").alias("fewest_pairs"))
    return out.withColumns({c: F.round(c, 9) for c in ("auc_mean", "auc_sd", "rho_mean", "rho_sd")})


@query(f"""{T}, e AS (SELECT pair_type, count(*) AS n, count(*) FILTER (score <= 7) AS own, count(*) FILTER (score < 2) AS swept, count(*) FILTER (parse_failure) AS unread FROM tw GROUP BY pair_type)
SELECT pair_type, n, round(own / CAST(n AS DOUBLE), 9) AS own_rule, round(swept / CAST(n AS DOUBLE), 9) AS at_swept, unread FROM e""")
def detection_by_error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection of each type of error by the judge's own rule, and at one threshold chosen over all of them."""
    e, s = pairs(spark, sf_dir).groupBy("pair_type"), F.col("score")
    n = F.count(F.lit(1))
    return e.agg(n.alias("n"), F.round(F.count_if(s <= 7) / n, 9).alias("own_rule"), F.round(F.count_if(s < 2) / n, 9).alias("at_swept"), F.count_if("parse_failure").alias("unread"))


CARRIED_SQL = "it AS (SELECT doc_id AS item, list_sort(list_filter(['long', 'en', 'cap'], lambda c: (c = 'long' AND length(text) > 1500) OR (c = 'en' AND lang = 'en') OR (c = 'cap' AND regexp_matches(text, '[A-Z][A-Z]')))) AS cats FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {CARRIED_SQL}, pl AS (SELECT item, array_to_string(cats, '|') AS stratum FROM it WHERE len(cats) > 0), sz AS (SELECT stratum, count(*) AS size FROM pl GROUP BY stratum), q AS (SELECT *, 50 * size / CAST(sum(size) OVER () AS DOUBLE) AS q FROM sz), b AS (SELECT *, floor(q) AS base, q - floor(q) AS rest FROM q),
s AS (SELECT stratum, size, CAST(least(base + CASE WHEN row_number() OVER (ORDER BY round(rest, 9) DESC, stratum) <= 50 - sum(base) OVER () THEN 1 ELSE 0 END, size) AS BIGINT) AS seats FROM b), r AS (SELECT pl.*, row_number() OVER (PARTITION BY stratum ORDER BY md5('carve' || item), item) AS n FROM pl)
SELECT item, coalesce(stratum, '(none)') AS stratum, coalesce(n <= seats, false) AS carved FROM it LEFT JOIN r USING (item) LEFT JOIN s USING (stratum)""")
def carved_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty items set apart, in proportion to the exact sets of categories that items carry; items without any stay."""
    t = F.col("text")
    cats = F.array_sort(F.array_compact(F.array(F.when(F.length(t) > 1500, "long"), F.when(F.col("lang") == "en", "en"), F.when(t.rlike("[A-Z][A-Z]"), "cap"))))
    items = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("item"), cats.alias("categories"))
    return sampling.carve(items, "item", "categories", 50, "carve")


@query("""SELECT doc_id, lang, CAST(2 AS BIGINT) AS release FROM documents WHERE doc_id % 3 <> 0""")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the newest of several releases in versioned folders: 1.10 comes after 1.9."""
    folder = work_folder(spark, "releases")
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    d.where("doc_id % 5 = 0").withColumn("release", F.lit(1)).write.option("header", True).csv(f"{folder}/data/1.9/files")
    d.where("doc_id % 3 <> 0").withColumn("release", F.lit(2)).write.option("header", True).csv(f"{folder}/data/1.10/files")
    return newest_release(spark, folder, "doc_id long, lang string, release long")


#: Sections of a sitting: which judgements each may show, in SQL that both engines read, and how many.
SITTING = {"omissions": ("pair_type = 'omit' AND severity = 'critical' AND NOT parse_failure", 12), "near misses": ("role = 'errored' AND score BETWEEN 7 AND 8", 10), "clean": ("role = 'clean' AND flagged", 8), "any": ("true", 10)}


def sitting_sql() -> str:
    parts = []
    for i, (name, (holds, n)) in enumerate(SITTING.items()):
        out = "".join(f" AND event_id NOT IN (SELECT event_id FROM s{k})" for k in range(i))
        parts.append(f"s{i} AS (SELECT '{name}' AS section, event_id, row_number() OVER (ORDER BY md5('sit|{name}|' || event_id), event_id) AS place FROM j WHERE {holds}{out} QUALIFY place <= {n})")
    return f"{N}, {', '.join(parts)} {' UNION ALL '.join(f'SELECT section, event_id, place FROM s{i}' for i in range(len(SITTING)))}"


@query(sitting_sql())
def sitting_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements for the sections of a sitting; none is shown twice."""
    return sampling.disjoint(now(spark, sf_dir), "event_id", {name: (F.expr(holds), n) for name, (holds, n) in SITTING.items()}, "sit")


@query(f"""{T}, pr AS (SELECT stratum, CASE WHEN pair_type = 'omit' THEN 'o' ELSE 'c' END AS side, replicate, (2.0 * count(*) FILTER (score < clean_score) + count(*) FILTER (score = clean_score)) / (2 * count(*)) AS p FROM tw WHERE NOT parse_failure AND NOT clean_failure GROUP BY ALL),
pm AS (SELECT stratum, avg(p) FILTER (side = 'o') AS paired_omissions, avg(p) FILTER (side = 'c') AS paired_commissions FROM pr GROUP BY stratum),
ab AS (SELECT stratum, count(*) FILTER (pair_type = 'omit') AS n1, count(*) FILTER (pair_type = 'omit' AND flagged AND NOT parse_failure) AS k1, count(*) FILTER (role = 'clean') AS n2, count(*) FILTER (role = 'clean' AND flagged AND NOT parse_failure) AS k2 FROM j GROUP BY stratum), ap AS (SELECT *, CAST(k1 + k2 AS DOUBLE) / (n1 + n2) AS q FROM ab),
sc AS (SELECT stratum, score, CAST(pair_type IS NOT NULL AS BOOLEAN) AS err FROM j WHERE NOT parse_failure AND (pair_type = 'omit' OR role = 'clean')), th AS (SELECT DISTINCT stratum, CAST(score AS DOUBLE) AS t FROM sc UNION SELECT stratum, max(score) + 1 FROM sc GROUP BY stratum),
sw AS (SELECT th.stratum, t, count(*) FILTER (err AND score < t) / CAST(count(*) FILTER (err) AS DOUBLE) AS det, count(*) FILTER (NOT err AND score < t) / CAST(count(*) FILTER (NOT err) AS DOUBLE) AS fa FROM th JOIN sc USING (stratum) GROUP BY ALL),
bs AS (SELECT stratum, det, fa FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY det DESC, fa, t DESC) AS n FROM sw WHERE fa <= 0.5) WHERE n = 1)
SELECT stratum, round(paired_omissions, 9) AS paired_omissions, round(paired_commissions, 9) AS paired_commissions, round(CAST(k1 AS DOUBLE) / n1, 9) AS det, round(CAST(k2 AS DOUBLE) / n2, 9) AS fa, round(CASE WHEN q * (1 - q) > 0 THEN (CAST(k1 AS DOUBLE) / n1 - CAST(k2 AS DOUBLE) / n2) / sqrt(q * (1 - q) * (1.0 / n1 + 1.0 / n2)) END, 7) AS z, round(bs.det, 9) AS swept_det, round(bs.fa, 9) AS swept_fa FROM ap JOIN pm USING (stratum) LEFT JOIN bs USING (stratum)""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arm's read-out by stratum: discrimination as a mean over runs of read pairs, detection against false alarms with z, and the best point at half of false alarms."""
    j = now(spark, sf_dir)
    omit, clean = F.col("pair_type") == "omit", F.col("role") == "clean"
    side = F.when(omit, "omissions").otherwise("commissions")
    runs = metrics.paired_with_failures(pairs(spark, sf_dir).withColumn("side", side), ["stratum", "side", "replicate"], "out").groupBy("stratum", "side").agg(F.avg("paired").alias("p"))
    paired = runs.groupBy("stratum").agg(*(F.max(F.when(F.col("side") == s, F.col("p"))).alias(f"paired_{s}") for s in ("omissions", "commissions")))
    hit = F.col("flagged") & ~F.col("parse_failure")
    plain = j.groupBy("stratum").agg(F.count_if(omit).alias("n1"), F.count_if(omit & hit).alias("k1"), F.count_if(clean).alias("n2"), F.count_if(clean & hit).alias("k2"))
    counts = metrics.score_counts(j.where(~F.col("parse_failure") & (omit | clean)), ["stratum"], "score", ~clean)
    best = metrics.best_at(metrics.sweep(counts, ["stratum"]), ["stratum"], 0.5).select("stratum", F.col("det").alias("swept_det"), F.col("fa").alias("swept_fa"))
    out = plain.join(paired, "stratum").join(best, "stratum", "left")
    out = out.withColumns({"det": F.col("k1") / F.col("n1"), "fa": F.col("k2") / F.col("n2"), "z": F.round(stats.two_proportion_z("k1", "n1", "k2", "n2"), 7)}).drop("n1", "n2", "k1", "k2")
    return out.withColumns({c: F.round(c, 9) for c in ("paired_omissions", "paired_commissions", "det", "fa", "swept_det", "swept_fa")})
