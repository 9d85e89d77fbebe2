"""Joins of releases, lots and arms; arm blocks; more intervals; parsers of landed replies; clustering read-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.functions import stats, text
from assaykit.operators import bootstrap, edits, matching, metrics, records, sampling
from assaykit.operators.numbering import numbered, ranked
from assaykit.plans.aggregates import _rounded
from assaykit.plans.judging import N, T, low_high_sql, now, pairs
from assaykit.plans.registry import query
from assaykit.plans.texts import REPLIES_SQL, SHINGLES, TALK_SQL, WORDS, replies, talks
from assaykit.sources.tables import judgements, read


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2', 'src3')) SELECT doc_id, source FROM documents SEMI JOIN s USING (source)""")
def subset_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of named sources; a name without documents raises an error."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    names = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source string")
    gone = [r["source"] for r in records.missing(names, docs, "source").collect()]
    if gone:
        raise ValueError(f"no documents of {gone}")
    return records.allowed(docs, names, "source")


@query(f"""{N}, g AS (SELECT event_id, CASE WHEN k % 13 = 0 THEN 'n/a' ELSE CAST(k % 5 AS VARCHAR) END AS raw, flagged, parse_failure, role FROM j), p AS (SELECT *, TRY_CAST(raw AS INT) AS n FROM g)
SELECT event_id, CASE WHEN n BETWEEN 0 AND 3 THEN n END AS grade, CASE WHEN n BETWEEN 0 AND 3 THEN n >= 2 END AS from_two, CASE WHEN n BETWEEN 0 AND 3 THEN n >= 3 END AS from_three, CASE WHEN parse_failure THEN role = 'clean' ELSE flagged END AS conservative,
  CASE WHEN n IS NULL THEN 'unread' WHEN n >= 3 THEN 'high' WHEN n >= 1 THEN 'middle' ELSE 'low' END AS bucket FROM p""")
def grade_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades read with a domain check and cut at two points; a failed reply counts against the judge."""
    raw = F.when(F.col("k") % 13 == 0, "n/a").otherwise((F.col("k") % 5).cast("string"))
    n = raw.try_cast("int")
    grade = F.when(n.between(0, 3), n)
    bucket = F.when(n.isNull(), "unread").when(n >= 3, "high").when(n >= 1, "middle").otherwise("low")
    return now(spark, sf_dir).select("event_id", grade.alias("grade"), (grade >= 2).alias("from_two"), (grade >= 3).alias("from_three"), F.when(F.col("parse_failure"), F.col("role") == "clean").otherwise(F.col("flagged")).alias("conservative"), bucket.alias("bucket"))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT o.o_orderstatus AS status, count(*) AS orders, CAST(sum(coalesce(t.n, 0)) AS BIGINT) AS lines, count(*) FILTER (t.n IS NULL) AS without FROM orders o LEFT JOIN t ON o.o_orderkey = t.l_orderkey GROUP BY 1""")
def lookup_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup join with the rows that found nothing counted; the many side is pre-aggregated before it meets the other."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return joined.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"), F.count_if(F.col("n").isNull()).alias("without"))


@query(f"""{N}, a AS (SELECT user_id, event_type, flagged FROM j WHERE replicate = 1), b AS (SELECT user_id, event_type, flagged FROM j WHERE replicate = 2) SELECT event_type, count(*) AS shared, count(*) FILTER (a.flagged AND NOT b.flagged) AS lost, count(*) FILTER (NOT a.flagged AND b.flagged) AS won FROM a JOIN b USING (user_id, event_type) GROUP BY 1""")
def shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that both arms judged, and where they part."""
    j = now(spark, sf_dir)
    a, b = (j.where(F.col("replicate") == r).select("user_id", "event_type", F.col("flagged").alias(n)) for r, n in ((1, "a"), (2, "b")))
    return a.join(b, ["user_id", "event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(~F.col("a") & F.col("b")).alias("won"))


@query(f"""{N}, k AS (SELECT event_id, stratum AS lot, md5('pack' || stratum) AS pack, severity FROM j WHERE replicate = 1), r AS (SELECT event_id, stratum AS lot, CASE WHEN stratum = 3 THEN md5('old') ELSE md5('pack' || stratum) END AS pack, score FROM j WHERE replicate = 1 AND k % 2 = 0)
SELECT r.event_id, r.lot, k.severity, r.score FROM r JOIN k ON r.event_id = k.event_id AND r.lot = k.lot AND r.pack = k.pack""")
def unblinding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned answers meet the key of their lot; answers to another version of the pack are left out."""
    j = now(spark, sf_dir).where("replicate = 1")
    pack = F.md5(F.concat(F.lit("pack"), F.col("stratum").cast("string")))
    key = j.select("event_id", F.col("stratum").alias("lot"), pack.alias("pack"), "severity")
    back = j.where("k % 2 = 0").select("event_id", F.col("stratum").alias("lot"), F.when(F.col("stratum") == 3, F.md5(F.lit("old"))).otherwise(pack).alias("pack"), "score")
    return back.join(key, ["event_id", "lot", "pack"]).select("event_id", "lot", "severity", "score")


@query("""WITH k AS (SELECT doc_id, source, md5(text) AS h, lang FROM documents), a AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN md5(text || 'x') ELSE h END AS h FROM (SELECT doc_id, source, text, md5(text) AS h FROM documents)),
e AS (SELECT source, h, min(lang) AS lang FROM k GROUP BY ALL), l AS (SELECT source, CASE WHEN count(DISTINCT h) = 1 THEN min(lang) END AS lang FROM k GROUP BY source)
SELECT a.doc_id, coalesce(e.lang, l.lang) AS lang, CASE WHEN e.lang IS NOT NULL THEN 'key' WHEN l.lang IS NOT NULL THEN 'count' END AS via FROM a LEFT JOIN e USING (source, h) LEFT JOIN l ON l.source = a.source""")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value by hashed key, else by the source alone where that has one row."""
    d = read(spark, sf_dir, "documents")
    right = d.select("source", F.md5("text").alias("h"), "lang").groupBy("source", "h").agg(F.min("lang").alias("lang"))
    left = d.select("doc_id", "source", F.when(F.col("doc_id") % 4 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("h"))
    return records.hashed_then_unique(left, right, ["source", "h"], ["source"], "lang").select("doc_id", "lang", "via")


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'corrected' ELSE text END AS s FROM conversations WHERE text IS NOT NULL) SELECT conv_id, md5(string_agg(s, ' ' ORDER BY turn)) AS twin FROM s GROUP BY conv_id""")
def corrected_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence of each text replaced by its number."""
    t = read(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    twin = F.transform("s", lambda x: F.when(x["turn"] == 1, "corrected").otherwise(x["text"]))
    return t.select("conv_id", F.md5(F.array_join(twin, " ")).alias("twin"))


@query(f"""{N}, k AS (SELECT DISTINCT user_id, md5('split' || user_id) < '4' AS test FROM j), p AS (SELECT j.*, k.test FROM j JOIN k USING (user_id)) SELECT count(DISTINCT user_id) FILTER (test) AS test_consultations, count(*) FILTER (role = 'errored' AND (NOT test OR event_id % 97 = 0)) AS train_pairs, count(DISTINCT user_id) FILTER (test AND role = 'errored' AND event_id % 97 = 0) AS leaked FROM p""")
def split_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs are those whose consultation is in no test pair, and some that break the rule; consultations on both sides are counted."""
    j = now(spark, sf_dir)
    test = j.where(sampling.stable(F.col("user_id"), "split") < "4").select("user_id").distinct()
    errored = j.where("role = 'errored'")
    train = errored.join(test, "user_id", "left_anti").unionByName(errored.where("event_id % 97 = 0").join(test, "user_id", "left_semi"))
    sides = test.withColumn("s", F.lit(1)).unionByName(train.select("user_id").distinct().withColumn("s", F.lit(2))).groupBy("user_id").agg(F.bit_or("s").alias("s"))
    counts = sides.agg(F.count_if(F.col("s").isin(1, 3)).alias("test_consultations"), F.count_if(F.col("s") == 3).alias("leaked")).withColumn("_k", F.lit(1))
    return train.agg(F.count(F.lit(1)).alias("train_pairs")).withColumn("_k", F.lit(1)).join(counts, "_k").drop("_k")


@query(f"""WITH {TALK_SQL}, q AS (SELECT conv_id, lower(trim(regexp_replace(transcript, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ')) AS t, lower(trim(regexp_replace(note, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ')) AS n FROM t WHERE note IS NOT NULL), v AS (SELECT conv_id, t, trim(CASE conv_id % 4 WHEN 0 THEN n WHEN 1 THEN n || ' ...' WHEN 2 THEN reverse(n) ELSE substr(n, 1, 7) END, ' ') AS n FROM q)
SELECT conv_id, CASE WHEN length(n) < 8 THEN 'absent' WHEN contains(t, n) THEN 'whole' WHEN contains(t, substr(n, 1, 60)) THEN 'head' ELSE 'absent' END AS rescue FROM v""")
def quote_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact called absent is rescued only by a quote of eight characters or more that stands in the text, whole or by its first 60.

    Quotes are the note as it is, with an ellipsis, backwards, or its first seven characters, by conversation.
    """
    n, kind = text.flat(F.col("note")), F.col("conv_id") % 4
    quote = F.trim(F.when(kind == 0, n).when(kind == 1, F.concat(n, F.lit(" ..."))).when(kind == 2, F.reverse(n)).otherwise(F.substring(n, 1, 7)))
    how = F.when(F.length("q") < 8, "absent").when(F.contains("t", "q"), "whole").when(F.contains("t", F.substring("q", 1, 60)), "head").otherwise("absent")
    asked = talks(spark, sf_dir).where("note is not null").select("conv_id", text.flat(F.col("transcript")).alias("t"), quote.alias("q"))
    return asked.select("conv_id", how.alias("rescue"))


@query(f"""{N}, v AS (SELECT user_id, event_type, count(*) FILTER (flagged) AS fails, count(*) AS runs, max(score) AS top FROM j GROUP BY ALL) SELECT user_id, event_type, fails >= 2 AS failed, CASE WHEN 2 * fails > runs THEN 'drop' WHEN runs - fails >= 2 THEN 'keep' ELSE 'again' END AS fate, top FROM v""")
def site_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items fail in two of up to three runs; sites are dropped by a majority and kept by two seeds."""
    v = now(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count_if("flagged").alias("fails"), F.count(F.lit(1)).alias("runs"), F.max("score").alias("top"))
    fate = F.when(2 * F.col("fails") > F.col("runs"), "drop").when(F.col("runs") - F.col("fails") >= 2, "keep").otherwise("again")
    return v.select("user_id", "event_type", (F.col("fails") >= 2).alias("failed"), fate.alias("fate"), "top")


@query("""WITH d AS (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS lang), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, coalesce(n, 0) AS n, coalesce(n, 0) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM d LEFT JOIN c USING (lang)""")
def class_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in a fixed list of classes; classes without rows stay."""
    domain = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "it")], "lang string")
    c = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    joined = domain.join(c, "lang", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("""WITH l AS (SELECT event_type, user_id % 3 AS experiment, CAST(floor(value * 100) AS BIGINT) AS cents FROM events) SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS spend_type, CAST(CASE WHEN grouping(experiment) = 1 THEN -1 ELSE experiment END AS BIGINT) AS experiment, CAST(sum(cents) AS BIGINT) AS cents FROM l GROUP BY ROLLUP (event_type, experiment)""")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("_t"), (F.col("user_id") % 3).alias("_e"), F.floor(F.col("value") * 100).cast("long").alias("_c"))
    g = e.rollup("_t", "_e").agg(F.sum("_c").alias("cents"), F.grouping("_t").alias("_a"), F.grouping("_e").alias("_b"))
    return g.select(F.when(F.col("_a") == 1, "ALL").otherwise(F.col("_t")).alias("spend_type"), F.when(F.col("_b") == 1, F.lit(-1)).otherwise(F.col("_e")).alias("experiment"), "cents")


@query("""SELECT source, count(*) AS seen, count(*) FILTER (why IS NULL) AS used, count(*) FILTER (why = 'short') AS short, count(*) FILTER (why = 'unlabelled') AS unlabelled, count(*) FILTER (why = 'toxic') AS toxic FROM (
  SELECT d.source, CASE WHEN length(d.text) < 400 THEN 'short' WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' END AS why FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source""")
def corpus_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in, what is out, and why."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("_l"))
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("_n")).join(labels, "doc_id", "left")
    why = F.when(F.col("_n") < 400, "short").when(F.col("_l").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic")
    return d.withColumn("w", why).groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("w").isNull()).alias("used"), *(F.count_if(F.col("w") == x).alias(x) for x in ("short", "unlabelled", "toxic")))


LOW, HIGH = low_high_sql("wins", "n")


@query(f"""{T}, b AS (SELECT * REPLACE (coalesce(level, 'none') AS level) FROM tw), r AS (SELECT pair_type, level, severity, count(*) AS n, count(*) FILTER (score < clean_score) AS wins, count(*) FILTER (score = clean_score) AS ties, count(*) FILTER (flagged AND NOT parse_failure) AS hits, count(*) FILTER (clean_flagged AND NOT clean_failure) AS false_alarms FROM b GROUP BY GROUPING SETS ((pair_type), (pair_type, level), (pair_type, severity)))
SELECT pair_type, coalesce(level, '-') AS level, coalesce(severity, '-') AS severity, n, (2 * wins + ties) / CAST(2 * n AS DOUBLE) AS paired, CAST(hits AS DOUBLE) / n AS det, CAST(false_alarms AS DOUBLE) / n AS fa, {LOW} AS low, {HIGH} AS high FROM r""")
def arm_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired and absolute read-outs of an arm by type, residual level and severity, with Wilson bounds of strict wins."""
    t = pairs(spark, sf_dir).withColumn("level", F.coalesce("level", F.lit("none")))
    e, c = F.col("score"), F.col("clean_score")
    p, v, s = F.col("pair_type"), F.col("level"), F.col("severity")
    g = t.groupingSets([[p], [p, v], [p, s]], "pair_type", "level", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e < c).alias("wins"), F.count_if(e == c).alias("ties"), F.count_if(F.col("flagged") & ~F.col("parse_failure")).alias("hits"), F.count_if(F.col("clean_flagged") & ~F.col("clean_failure")).alias("false_alarms")
    )
    low, high = stats.wilson("wins", "n")
    n = F.col("n")
    return g.select("pair_type", F.coalesce("level", F.lit("-")).alias("level"), F.coalesce("severity", F.lit("-")).alias("severity"), "n", ((2 * F.col("wins") + F.col("ties")) / (2 * n)).alias("paired"), (F.col("hits") / n).alias("det"), (F.col("false_alarms") / n).alias("fa"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""{N}, a AS (SELECT stratum, replicate, CAST(count(*) FILTER (role = 'errored' AND flagged) AS DOUBLE) / count(*) FILTER (role = 'errored') AS det, CAST(count(*) FILTER (role = 'clean' AND flagged) AS DOUBLE) / count(*) FILTER (role = 'clean') AS fa FROM j GROUP BY ALL)
SELECT stratum, replicate, det, fa, CASE WHEN det > fa THEN 'informative' ELSE 'chance' END AS reading FROM (SELECT *, row_number() OVER (ORDER BY det DESC, stratum, replicate, fa) AS n FROM a) WHERE n = 1""")
def anchor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arm with the best detection, then the fewest ingredients, then the fewest false alarms; and how it reads."""
    e, f = F.col("role") == "errored", F.col("flagged")
    a = now(spark, sf_dir).groupBy("stratum", "replicate").agg((F.count_if(e & f) / F.count_if(e)).alias("det"), (F.count_if(~e & f) / F.count_if(~e)).alias("fa"))
    return a.orderBy(F.desc("det"), "stratum", "replicate", "fa").limit(1).withColumn("reading", F.when(F.col("det") > F.col("fa"), "informative").otherwise("chance"))


@query(f"""{N}, b AS (SELECT CAST(floor(k / 10) AS BIGINT) AS batch, score AS s, count(*) FILTER (role = 'errored') AS pos, count(*) FILTER (role = 'clean') AS neg FROM j GROUP BY ALL), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY batch ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM b)
SELECT batch, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CAST(sum(2 * pos * above + pos * neg) AS DOUBLE) / nullif(2 * sum(pos) * sum(neg), 0) AS auc FROM w GROUP BY batch""")
def batch_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = now(spark, sf_dir).withColumn("batch", F.floor(F.col("k") / 10).cast("long"))
    return metrics.auc(metrics.score_counts(j, ["batch"], "score", F.col("role") == "errored"), ["batch"])


@query("""WITH u AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, CAST(floor(l_extendedprice) AS DOUBLE) AS c FROM lineitem), s AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * c) AS xc, sum(y * c) AS yc FROM u)
SELECT round((xc * yy - yc * xy) / (xx * yy - xy * xy), 4) AS a, round((yc * xx - xc * xy) / (xx * yy - xy * xy), 4) AS b FROM s""")
def cost_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares without an intercept on two classes, from the normal equations."""
    x, y, c = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), F.floor("l_extendedprice").cast("double")
    s = read(spark, sf_dir, "lineitem").agg(F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x * c).alias("xc"), F.sum(y * c).alias("yc"))
    d = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return s.select(F.round((F.col("xc") * F.col("yy") - F.col("yc") * F.col("xy")) / d, 4).alias("a"), F.round((F.col("yc") * F.col("xx") - F.col("xc") * F.col("xy")) / d, 4).alias("b"))


@query(f"{N}, {bootstrap.draws_sql('''SELECT user_id AS c, count(*) FILTER (flagged AND NOT parse_failure) AS num, count(*) FILTER (flagged) AS den FROM j GROUP BY user_id''')}")
def bootstrap_standard_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of a stricter to a looser standard, resampling consultations."""
    per = now(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("flagged") & ~F.col("parse_failure")).alias("num"), F.count_if("flagged").alias("den"))
    return _rounded(bootstrap.bootstrap(per, "user_id", "num", "den"))


@query(f"""{N}, {bootstrap.slots_sql("SELECT DISTINCT user_id AS c FROM j", 100)}, pc AS (SELECT user_id, score, count(*) FILTER (role = 'errored') AS pos, count(*) FILTER (role = 'clean') AS neg FROM j WHERE score IS NOT NULL GROUP BY ALL),
dc AS (SELECT draw, score AS s, sum(times * pos) AS pos, sum(times * neg) AS neg FROM tm JOIN pc ON pc.user_id = tm.c GROUP BY ALL), ab AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY draw ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM dc),
au AS (SELECT draw, CAST(sum(2 * pos * above + pos * neg) AS DOUBLE) / nullif(2 * sum(pos) * sum(neg), 0) AS auc FROM ab GROUP BY draw) SELECT count(auc) AS valid, round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.5), 9) AS median, round(quantile_cont(auc, 0.975), 9) AS high FROM au""")
def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of an AUC, which no sums per cluster give: scores are counted per draw, and each draw's curve is its own group."""
    j = now(spark, sf_dir).where("score is not null")
    per = j.groupBy("user_id", F.col("score").alias("s")).agg(F.count_if(F.col("role") == "errored").alias("pos"), F.count_if(F.col("role") == "clean").alias("neg"))
    drawn = bootstrap.multiplicities(j, "user_id", 100).join(per, "user_id")
    counts = drawn.groupBy("draw", "s").agg(F.sum(F.col("times") * F.col("pos")).alias("pos"), F.sum(F.col("times") * F.col("neg")).alias("neg"))
    return bootstrap.interval(metrics.auc(counts, ["draw"]), "auc").withColumns({c: F.round(c, 9) for c in ("low", "median", "high")})


@query(f"""{T}, mg AS (SELECT user_id, CASE severity WHEN 'critical' THEN 3 WHEN 'supporting' THEN 2 ELSE 1 END AS x, round(avg(clean_score - score), 6) AS y FROM tw WHERE pair_type = 'omit' AND NOT parse_failure AND NOT clean_failure GROUP BY user_id, event_type, severity),
{bootstrap.slots_sql("SELECT DISTINCT user_id AS c FROM mg", 100)}, pc AS (SELECT user_id, x, y, count(*) AS n FROM mg GROUP BY ALL), dw AS (SELECT draw, x, y, sum(times * n) AS w FROM tm JOIN pc ON pc.user_id = tm.c GROUP BY ALL),
mr AS (SELECT *, sum(w) OVER (PARTITION BY draw ORDER BY x RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY draw, x) - 1) / 2 AS rx, sum(w) OVER (PARTITION BY draw ORDER BY y RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY draw, y) - 1) / 2 AS ry FROM dw),
sm AS (SELECT draw, CAST(sum(w) AS DOUBLE) AS n, sum(w * rx) AS sx, sum(w * ry) AS sy, sum(w * rx * rx) AS xx, sum(w * ry * ry) AS yy, sum(w * rx * ry) AS xy FROM mr GROUP BY draw),
rh AS (SELECT CASE WHEN n >= 3 AND (n * xx - sx * sx) * (n * yy - sy * sy) > 0 THEN (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) END AS rho FROM sm)
SELECT count(rho) AS valid, round(quantile_cont(rho, 0.025), 7) AS low, round(quantile_cont(rho, 0.5), 7) AS median, round(quantile_cont(rho, 0.975), 7) AS high FROM rh""")
def bootstrap_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the rank correlation between an omission's importance and its score gap; ranks are formed in each draw, from counts."""
    x = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "supporting", 2).otherwise(1)
    sound = pairs(spark, sf_dir).where("pair_type = 'omit' and not parse_failure and not clean_failure")
    gaps = sound.groupBy("user_id", "event_type", x.alias("x")).agg(F.round(F.avg(F.col("clean_score") - F.col("score")), 6).alias("y"))
    per = gaps.groupBy("user_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    drawn = bootstrap.multiplicities(gaps, "user_id", 100).join(per, "user_id")
    cells = drawn.groupBy("draw", "x", "y").agg(F.sum(F.col("times") * F.col("n")).cast("double").alias("w"))
    return bootstrap.interval(bootstrap.weighted_spearman(cells, ["draw"], "x", "y", "w"), "rho").withColumns({c: F.round(c, 7) for c in ("low", "median", "high")})


@query(f"""{N}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('smoke' || event_id), event_id) AS i FROM j), o AS (SELECT event_id, user_id, stratum, pair_type, row_number() OVER (PARTITION BY stratum ORDER BY md5('smoke' || event_id), event_id) AS t FROM r WHERE i = 1) SELECT event_id, user_id, stratum, coalesce(pair_type, 'none') AS pair_type FROM o WHERE t <= 4""")
def smoke_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judgement of each consultation, and four consultations of each stratum in turn."""
    order = [sampling.stable(F.col("event_id"), "smoke"), F.col("event_id")]
    once = sampling.first_n(now(spark, sf_dir), ["user_id"], 1, order)
    return sampling.first_n(once, ["stratum"], 4, order).select("event_id", "user_id", "stratum", F.coalesce("pair_type", F.lit("none")).alias("pair_type"))


@query("""WITH l AS (SELECT DISTINCT lang FROM documents) SELECT lang, row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 99 END, lang) AS place FROM l""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known names in their own order, then the rest alphabetically."""
    place = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(99)
    names = read(spark, sf_dir, "documents").select("lang").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(place, "lang")).cast("long"))  # one row for each name


@query("""WITH x AS (SELECT doc_id, 'toxic' AS list FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'poor' FROM labels WHERE quality = 0), e AS (SELECT DISTINCT doc_id FROM x) SELECT source, count(*) AS kept FROM documents ANTI JOIN e USING (doc_id) GROUP BY source""")
def exclusion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when every list of exclusions is taken together."""
    labels = read(spark, sf_dir, "labels")
    gone = labels.where("toxic = 1").select("doc_id").union(labels.where("quality = 0").select("doc_id")).distinct()
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(gone, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH {REPLIES_SQL}, v AS (SELECT event_id, '{{"F1": "' || CASE WHEN score > 7 THEN 'FULL' WHEN score > 3 THEN 'partially' ELSE 'missing' END || '", "F2": "' || CASE WHEN k % 2 = 0 THEN 'full' ELSE 'odd' END || '", "X9": "full"}}' AS reply FROM r),
m AS (SELECT event_id, lower(json_extract_string(reply, '$.F1')) AS a, lower(json_extract_string(reply, '$.F2')) AS b FROM v), n AS (SELECT event_id, CASE WHEN a IN ('full', 'fully', 'present') THEN 'full' WHEN a IN ('partial', 'partially') THEN 'partial' WHEN a IN ('absent', 'missing') THEN 'absent' END AS f1, CASE WHEN b IN ('full', 'fully', 'present') THEN 'full' WHEN b IN ('partial', 'partially') THEN 'partial' WHEN b IN ('absent', 'missing') THEN 'absent' END AS f2 FROM m)
SELECT event_id, f1, f2, CAST((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT AS INTEGER) AS n_read, f1 IS NOT NULL AND f2 IS NOT NULL AS complete FROM n""")
def keyed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts keyed by fact: synonyms are folded, unknown words dropped, and facts that were not asked for ignored."""
    j = judgements(read(spark, sf_dir, "events"))
    first = F.when(F.col("score") > 7, "FULL").when(F.col("score") > 3, "partially").otherwise("missing")
    reply = F.concat(F.lit('{"F1": "'), first, F.lit('", "F2": "'), F.when(F.col("k") % 2 == 0, "full").otherwise("odd"), F.lit('", "X9": "full"}'))
    said = F.map_filter(F.from_json(reply, "map<string,string>"), lambda k, v: k.isin("F1", "F2"))
    word = lambda v: F.when(F.lower(v).isin("full", "fully", "present"), "full").when(F.lower(v).isin("partial", "partially"), "partial").when(F.lower(v).isin("absent", "missing"), "absent")
    sound = F.map_filter(F.transform_values(said, lambda k, v: word(v)), lambda k, v: v.isNotNull())
    return j.select("event_id", sound.alias("m")).select("event_id", F.try_element_at("m", F.lit("F1")).alias("f1"), F.try_element_at("m", F.lit("F2")).alias("f2"), F.size("m").alias("n_read"), (F.size("m") == 2).alias("complete"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({WORDS.format(t="text")}) AS w FROM benchmark WHERE text IS NOT NULL), x AS (SELECT item_id, unnest(w) AS word FROM b), n AS (SELECT count(*) AS n FROM b), d AS (SELECT word, ln(CAST(any_value(n) AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM x, n GROUP BY word),
i AS (SELECT item_id, sum(idf) AS total FROM x JOIN d USING (word) GROUP BY item_id), q AS (SELECT doc_id, unnest(list_distinct({WORDS.format(t="text")})) AS word FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, item_id, sum(idf) AS got FROM q JOIN x USING (word) JOIN d USING (word) GROUP BY ALL),
c AS (SELECT doc_id, item_id, round(got / total, 9) AS share FROM s JOIN i USING (item_id)), m AS (SELECT *, max(share) OVER (PARTITION BY doc_id) AS best FROM c) SELECT doc_id, count(*) AS near_best, min(item_id) AS item_id, max(share) AS share FROM m WHERE share >= 0.28 AND share >= best - 0.005 GROUP BY doc_id""")
def tfidf_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF-weighted containment of each item in each document, behind a gate: 0.28 or more, and within 0.005 of the best."""
    found = matching.contained(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "doc_id", "text", 0.28)
    share = found.withColumn("share", F.round("share", 9)).where("share >= 0.28")
    gated = share.withColumn("_b", F.max("share").over(Window.partitionBy("doc_id"))).where("share >= _b - 0.005")
    return gated.groupBy("doc_id").agg(F.count(F.lit(1)).alias("near_best"), F.min("item_id").alias("item_id"), F.max("share").alias("share"))


@query(f"""WITH d AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL), dx AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM (SELECT doc_id, {SHINGLES.format(n=12)} AS s FROM d)), bx AS (SELECT DISTINCT unnest({SHINGLES.format(n=12)}) AS g FROM b)
SELECT doc_id, count(*) AS runs, CAST(count(*) AS DOUBLE) / any_value(n) AS share, count(*) >= 15 OR CAST(count(*) AS DOUBLE) / any_value(n) >= 0.2 AS fails FROM dx JOIN bx USING (g) GROUP BY doc_id""")
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word runs of twelve shared with withheld texts; fifteen runs or a fifth of a text fail."""
    held = read(spark, sf_dir, "benchmark").select(F.explode(text.shingles(F.col("text"), 12)).alias("_g")).distinct().withColumn("_h", F.xxhash64("_g"))
    s = read(spark, sf_dir, "documents").select("doc_id", text.shingles(F.col("text"), 12).alias("_s")).select("doc_id", F.size("_s").alias("_n"), F.explode("_s").alias("_g")).withColumn("_h", F.xxhash64("_g"))
    hit = text.having(s, held, "_h").join(held, ["_h", "_g"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), (F.count(F.lit(1)) / F.max("_n")).alias("share"))
    return hit.withColumn("fails", (F.col("runs") >= 15) | (F.col("share") >= 0.2))


@query(r"""WITH q AS (SELECT conv_id, turn, text, unnest(regexp_extract_all(replace(text, '. ', '" "'), '"([^"]{20,})"', 1)) AS quote FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, md5(quote) AS quote, contains(text, quote) AS verbatim FROM (SELECT conv_id, turn, text, CASE WHEN (conv_id + turn) % 3 = 0 THEN replace(quote, 'e', 'ee') ELSE quote END AS quote FROM q)""")
def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted spans (here: sentences put in quotes, a third of them spoilt), and whether they stand in the text word for word."""
    quoted = F.regexp_extract_all(F.replace("text", F.lit(". "), F.lit('" "')), F.lit('"([^"]{20,})"'), 1)
    q = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text", F.explode(quoted).alias("quote"))
    q = q.withColumn("quote", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.replace("quote", F.lit("e"), F.lit("ee"))).otherwise(F.col("quote")))
    return q.select("conv_id", "turn", F.md5("quote").alias("quote"), F.contains("text", F.col("quote")).alias("verbatim"))


@query("""WITH g AS (SELECT conv_id, count(*) AS items, count(DISTINCT md5(left(text, 1))) AS groups FROM conversations WHERE role = 'user' AND conv_id % 7 <> 3 GROUP BY conv_id), a AS (SELECT DISTINCT conv_id FROM conversations) SELECT CAST(sum(coalesce(items, 0)) AS BIGINT) AS items, CAST(sum(coalesce(groups, 0)) AS BIGINT) AS distinct_items, count(*) FILTER (items IS NULL) AS unmerged_notes FROM a LEFT JOIN g USING (conv_id)""")
def distinct_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after grouping within notes by their first letter; notes without groups count unmerged."""
    c = read(spark, sf_dir, "conversations")
    g = c.where("role = 'user' and conv_id % 7 <> 3").groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct(F.md5(F.substring("text", 1, 1))).alias("groups"))
    a = c.select("conv_id").distinct().join(g, "conv_id", "left")
    return a.agg(F.sum(F.coalesce("items", F.lit(0))).alias("items"), F.sum(F.coalesce("groups", F.lit(0))).alias("distinct_items"), F.count_if(F.col("items").isNull()).alias("unmerged_notes"))


@query(f"""{N}, s AS (SELECT DISTINCT stratum, user_id FROM j), d AS (SELECT DISTINCT user_id FROM j WHERE replicate = 1 AND flagged AND severity = 'critical' AND score <= 1), q AS (SELECT * FROM s ANTI JOIN d USING (user_id)) SELECT stratum, user_id, row_number() OVER (PARTITION BY stratum ORDER BY user_id) AS sequence, count(*) OVER (PARTITION BY stratum) AS queued FROM q""")
def capture_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources not yet captured, with their place in the queue."""
    j = now(spark, sf_dir)
    q = records.outstanding(j.select("stratum", "user_id").distinct(), j.where("replicate = 1 and flagged and severity = 'critical' and score <= 1"), ["user_id"])
    return ranked(q.select("stratum", "user_id"), ["stratum"], [F.col("user_id")], F.col("user_id"), "sequence", "queued")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT user_id AS id, CAST(floor(user_id / 3) AS BIGINT) AS parent FROM events), t AS (SELECT id, 0 AS depth FROM n WHERE id = 0 UNION ALL SELECT n.id, t.depth + 1 FROM n JOIN t ON n.parent = t.id AND n.id <> 0) SELECT id, CAST(depth AS INTEGER) AS depth FROM t""")
def lineage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each candidate below the first, over (id, parent)."""
    n = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.floor(F.col("user_id") / 3).cast("long").alias("parent")).distinct()
    return records.depths(n, "id", "parent").where(F.col("root") == 0).select("id", "depth")


@query(f"""{N}, m AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS chunk, count(*) AS n, count(*) FILTER (flagged) AS kept FROM j GROUP BY 1) SELECT chunk, CAST(sum(n) OVER w AS BIGINT) AS seen, CAST(sum(kept) OVER w AS BIGINT) AS kept, CAST(sum(kept) OVER w AS DOUBLE) / sum(n) OVER w AS survival FROM m WINDOW w AS (ORDER BY chunk ROWS UNBOUNDED PRECEDING)""")
def running_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival so far at each chunk boundary: chunks are counted first, and only their counts are summed in order."""
    m = now(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 500).cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("k"))
    w = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("chunk", F.sum("n").over(w).alias("seen"), F.sum("k").over(w).alias("kept"), (F.sum("k").over(w) / F.sum("n").over(w)).alias("survival"))


@query(f"""{N}, x AS (SELECT unnest(['F-bin-k1', 'F-score-k8', 'FC-score-k1']) AS cell) SELECT cell, string_split(cell, '-')[1] AS family, string_split(cell, '-')[2] AS form, CAST(replace(string_split(cell, '-')[3], 'k', '') AS INTEGER) AS k FROM x""")
def arm_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms as a dimension table, from their names."""
    part = F.split("cell", "-")
    return spark.createDataFrame([("F-bin-k1",), ("F-score-k8",), ("FC-score-k1",)], "cell string").select("cell", part[0].alias("family"), part[1].alias("form"), F.regexp_replace(part[2], "k", "").cast("int").alias("k"))


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM conversations), e AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS g FROM w),
m AS (SELECT a.conv_id, a.turn, b.turn AS other, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS k FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.g = b.g AND a.turn <> b.turn GROUP BY ALL), nr AS (SELECT conv_id, turn, list(other) AS near FROM m WHERE c >= 0.3 * (n + k - c) GROUP BY ALL),
s0 AS (SELECT conv_id, list(turn ORDER BY turn) AS rest FROM w GROUP BY conv_id),
s AS (SELECT conv_id, rest, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS place, false AS moved FROM s0
  UNION ALL SELECT s.conv_id, list_filter(s.rest, lambda x: x <> p.pick), p.pick, s.place + 1, p.pick <> s.rest[1] FROM s LEFT JOIN nr ON nr.conv_id = s.conv_id AND nr.turn = s.turn, LATERAL (SELECT coalesce(list_filter(s.rest, lambda x: NOT list_contains(coalesce(nr.near, []), x))[1], s.rest[1]) AS pick) p WHERE len(s.rest) > 0)
SELECT conv_id, turn, place, moved FROM s WHERE place > 0""")
def near_duplicate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns in order, but near-duplicates not next to each other where another turn can stand between."""
    return edits.apart(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 0.3)


@query(f"""WITH {REPLIES_SQL} SELECT k % 5 AS kind, count(*) AS calls, count(DISTINCT reply) AS different FROM (SELECT p.reply, r.k FROM p JOIN r USING (event_id)) GROUP BY 1""")
def routing_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different replies repeated calls gave."""
    kinds = judgements(read(spark, sf_dir, "events")).select("event_id", (F.col("k") % 5).alias("kind"))
    return replies(spark, sf_dir).join(kinds, "event_id").groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("reply").alias("different"))
