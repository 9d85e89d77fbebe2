"""Draws, orders, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.operators import records, sampling
from assaykit.operators.numbering import numbered, running
from assaykit.plans.judging import N, now
from assaykit.plans.registry import query
from assaykit.sources.tables import JUDGEMENTS_SQL, judgements, read

W = f"WITH {JUDGEMENTS_SQL}"


def apportion_sql(key: str) -> str:
    return f"""WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), q AS (SELECT *, 60 * CAST(size AS DOUBLE) / sum(size) OVER () AS q FROM s), f AS (SELECT *, floor(q) AS base, q - floor(q) AS rest FROM q),
g AS (SELECT *, least(base + CAST(row_number() OVER (ORDER BY round(rest, 9) DESC, {key}) <= 60 - sum(base) OVER () AS INT), size) AS seats FROM f), h AS (SELECT *, 60 - sum(seats) OVER () AS spare, coalesce(sum(size - seats) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT source, size, CAST(seats + greatest(0, least(size - seats, spare - before)) AS BIGINT) AS seats FROM h"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("size"))


@query(apportion_sql("source"))
def apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.apportion(_sources(spark, sf_dir), "source", "size", 60)


@query(apportion_sql("source DESC"))
def apportionment_reverse_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.apportion(_sources(spark, sf_dir), "source", "size", 60, "desc")


@query("""WITH l AS (SELECT doc_id, lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM documents) SELECT doc_id, lang, CAST(floor(i * 3 / m) + 1 AS BIGINT) AS part FROM l""")
def rank_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("_n"))
    squeezed = F.col("doc_id") / (1 + F.abs("doc_id")) / 2  # rises with doc_id and stays below the next length
    return sampling.terciles(d, [F.col("_n"), F.col("doc_id")], ["lang"], F.col("_n") + squeezed).drop("_n")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY source) AS place FROM documents")
def stratified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fractional_order(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")


@query(f"{N} SELECT event_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('turn' || event_id), event_id) AS turn FROM j")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.in_turn(now(spark, sf_dir).select("event_id", "stratum"), "stratum", "event_id", "turn")


@query(f"""{W}, k AS (SELECT DISTINCT stratum, user_id FROM raw), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('split' || user_id), user_id) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM k)
SELECT stratum, user_id, i <= CASE WHEN n >= 3 THEN greatest(1, floor(n * 0.2 + 0.5)) ELSE floor(n * 0.2 + 0.5) END AS valid FROM r""")
def consultation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(judgements(read(spark, sf_dir, "events")), "stratum", "user_id", 0.2)


@query(f"""{N}, r AS (SELECT *, row_number() OVER (PARTITION BY pair_type ORDER BY md5('batch' || event_id), event_id) <= CASE pair_type WHEN 'omit' THEN 8 ELSE 4 END AS quota FROM j WHERE role = 'errored'),
f AS (SELECT event_id, pair_type, quota, row_number() OVER (ORDER BY quota DESC, md5('batch' || event_id), event_id) AS i FROM r) SELECT event_id, pair_type, quota FROM f WHERE i <= 20""")
def quota_minibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty errored notes: eight omissions and four of each other type, and what is left over from all others."""
    order = [sampling.stable(F.col("event_id"), "batch"), F.col("event_id")]
    r = sampling.in_turn(now(spark, sf_dir).where("role = 'errored'"), "pair_type", "event_id", "batch")
    r = r.withColumn("quota", F.col("turn") <= F.when(F.col("pair_type") == "omit", 8).otherwise(4))
    return r.orderBy(F.desc("quota"), *order).limit(20).select("event_id", "pair_type", "quota")


@query(f"""{N}, c AS (SELECT user_id FROM j GROUP BY user_id HAVING count(DISTINCT event_type) = 5), r AS (SELECT user_id, user_id % 4 AS s, row_number() OVER (PARTITION BY user_id % 4 ORDER BY md5('stable' || user_id), user_id) AS i FROM c) SELECT user_id, s AS stratum FROM r WHERE i <= 3""")
def stability_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sampling.covered(now(spark, sf_dir), "user_id", "event_type", 5).withColumn("stratum", F.col("user_id") % 4)
    return sampling.first_n(c, ["stratum"], 3, [sampling.stable(F.col("user_id"), "stable"), F.col("user_id")])


@query(f"""{N}, e AS (SELECT * FROM j WHERE role = 'errored'), a AS (SELECT *, row_number() OVER (PARTITION BY stratum, severity ORDER BY score, event_id) <= CASE severity WHEN 'critical' THEN 3 WHEN 'supporting' THEN 2 ELSE 0 END AS q FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY q DESC, score, event_id) AS r FROM a)
SELECT event_id, stratum, severity, CASE WHEN q THEN 'quota' ELSE 'back-fill' END AS "by" FROM b WHERE r <= 7""")
def quota_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = now(spark, sf_dir).where("role = 'errored'")
    return sampling.quota_backfill(e, "severity", {"critical": 3, "supporting": 2}, 7, [F.col("score"), F.col("event_id")], ["stratum"]).select("event_id", "stratum", "severity", "by")


@query(f"""{N}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END, score, md5('jitter' || event_id)) AS i FROM j WHERE role = 'errored') SELECT user_id, event_id, severity, score FROM r WHERE i = 1""")
def target_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "supporting", 1).otherwise(2)
    best = F.min_by(F.struct("event_id", "severity", "score"), F.struct(rank, "score", sampling.stable(F.col("event_id"), "jitter")))
    return now(spark, sf_dir).where("role = 'errored'").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


@query(f"""{N}, k AS (SELECT DISTINCT user_id, event_type FROM j), i AS (SELECT *, row_number() OVER (ORDER BY user_id, event_type) - 1 AS item FROM k) SELECT user_id, event_type, item, CAST(7 * 100000 + item * 10 AS BIGINT) AS seed, CAST(floor(item / 25) AS BIGINT) AS chunk FROM i""")
def item_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable item numbers over distinct notes, with seeds and chunks of 25."""
    place = F.expr("5 * user_id + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")
    notes = now(spark, sf_dir).select("user_id", "event_type").distinct().withColumn("_place", place)  # in the order of both keys
    items = numbered(notes, "_place", "item")
    return items.select("user_id", "event_type", "item", (7 * 100_000 + F.col("item") * 10).alias("seed"), F.floor(F.col("item") / 25).cast("long").alias("chunk"))


@query("""WITH e AS (SELECT user_id % 8 AS run, event_id, ts, CAST(floor(value * 100) AS BIGINT) AS cents FROM events), r AS (SELECT *, sum(cents) OVER (PARTITION BY run ORDER BY ts, event_id) AS spent FROM e), b AS (SELECT run, CAST(sum(cents) AS BIGINT) AS total, min(struct_pack(ts := ts, id := event_id)) FILTER (spent > 100000) AS w, min(struct_pack(ts := ts, id := event_id)) FILTER (spent > 500000) AS s FROM r GROUP BY run)
SELECT run, total, w.id AS warn_at, s.id AS stop_at FROM b""")
def spend_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running spend per run, and the calls at which it first passes the warning and the stop."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("run"), "event_id", "ts", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    at = F.struct("ts", "event_id")
    g = running(e, ["run"], [F.col("ts"), F.col("event_id")], F.unix_micros(F.col("ts").cast("timestamp")), "cents", "_s").groupBy("run").agg(F.sum("cents").alias("total"), F.min(F.when(F.col("_s") > 100_000, at)).alias("_w"), F.min(F.when(F.col("_s") > 500_000, at)).alias("_x"))
    return g.select("run", "total", F.col("_w.event_id").alias("warn_at"), F.col("_x.event_id").alias("stop_at"))


@query("""WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (before IS NULL OR before <> event_type) AS blocks FROM e GROUP BY user_id""")
def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("_b", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_b").isNull() | (F.col("_b") != F.col("event_type"))).alias("blocks"))


@query(f"""{N}, r AS (SELECT user_id, replicate, event_type, score, row_number() OVER (PARTITION BY user_id, replicate ORDER BY score DESC, event_type) AS i FROM j) SELECT user_id, replicate, max(event_type) FILTER (i = 1) AS best, max(event_type) FILTER (i = 2) AS runner_up, CAST(max(score) FILTER (i = 1) - max(score) FILTER (i = 2) AS INTEGER) AS margin FROM r WHERE i <= 2 GROUP BY ALL""")
def best_and_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = now(spark, sf_dir).withColumn("_i", F.row_number().over(Window.partitionBy("user_id", "replicate").orderBy(F.desc("score"), "event_type"))).where("_i <= 2")

    def of(i: int, c: str):
        return F.max(F.when(F.col("_i") == i, F.col(c)))

    return r.groupBy("user_id", "replicate").agg(of(1, "event_type").alias("best"), of(2, "event_type").alias("runner_up"), (of(1, "score") - of(2, "score")).alias("margin"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source, lang LIMIT 10")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "lang").limit(10)


@query("WITH d AS (SELECT *, dense_rank() OVER (ORDER BY source) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) SELECT source, lang, n FROM d WHERE r <= 5")
def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the first five groups."""
    g = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    first = g.select("source").distinct().orderBy("source").limit(5)
    return g.join(first, "source", "left_semi")


@query("""SELECT doc_id, 'labelled' AS cohort FROM labels UNION ALL SELECT doc_id, 'unlabelled' FROM documents ANTI JOIN labels USING (doc_id)""")
def cohort_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    rest = docs.select("doc_id").join(labels, "doc_id", "left_anti")
    return labels.select("doc_id", F.lit("labelled").alias("cohort")).unionByName(rest.withColumn("cohort", F.lit("unlabelled")))


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) AS both_sides, (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) AS only_customers, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS only_orders""")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit and customers with a large order: in both sets and in either alone, from one pass over each."""
    a = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("s"))
    b = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"), F.lit(2).alias("s"))
    sides = a.unionByName(b).groupBy("k").agg(F.bit_or("s").alias("s"))
    return sides.agg(*(F.count_if(F.col("s") == v).alias(n) for v, n in ((3, "both_sides"), (1, "only_customers"), (2, "only_orders"))))


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("digest"))
    return records.duplicates(d, ["digest"])


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 11 < 2 THEN NULL ELSE text END AS text, CASE doc_id % 22 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 11 THEN NULL ELSE lang END AS lang FROM documents)
SELECT doc_id FROM d a WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.doc_id % 2 = 1 AND b.text IS NOT DISTINCT FROM a.text AND b.lang IS NOT DISTINCT FROM a.lang)""")
def content_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one release (even ids) whose content the other (odd ids) lacks; a null is content of its own, not an empty string."""
    n = F.col("doc_id")
    lang = F.when((n % 22).isin(0, 11), F.lit(None)).when(n % 22 == 1, "").otherwise(F.col("lang"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(n % 11 >= 2, F.col("text")).alias("text"), lang.alias("lang"))
    return records.by_content(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text", "lang"]).select("doc_id")


@query(f"""{N}, a AS (SELECT event_id, flagged FROM j WHERE stratum < 3), b AS (SELECT event_id, CASE WHEN k % 9 = 0 THEN NOT flagged ELSE flagged END AS flagged FROM j WHERE stratum > 0)
SELECT event_id, CASE WHEN a.flagged IS NULL THEN 'undrawn' WHEN b.flagged IS NULL THEN 'unscored' ELSE 'drift' END AS problem FROM a FULL JOIN b USING (event_id) WHERE a.flagged IS DISTINCT FROM b.flagged""")
def verdict_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = now(spark, sf_dir)
    scored = j.where("stratum > 0").withColumn("flagged", F.when(F.col("k") % 9 == 0, ~F.col("flagged")).otherwise(F.col("flagged")))
    return records.drift(j.where("stratum < 3"), scored, "event_id", "flagged")


@query(f"""{N}, p AS (SELECT user_id, event_type, replicate FROM (SELECT DISTINCT user_id FROM j), (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type), (SELECT unnest([1, 2, 3]) AS replicate)) SELECT event_type, replicate, count(*) AS missing FROM p ANTI JOIN j USING (user_id, event_type, replicate) GROUP BY ALL""")
def outstanding_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned judgements less those stored, per type and replicate."""
    j = now(spark, sf_dir)
    kinds, runs = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))
    planned = j.select("user_id").distinct().select("user_id", F.explode(kinds).alias("event_type")).select("*", F.explode(runs).alias("replicate"))
    return records.outstanding(planned, j, ["user_id", "event_type", "replicate"]).groupBy("event_type", "replicate").agg(F.count(F.lit(1)).alias("missing"))


@query("""WITH c AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 1000000 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS e FROM events WHERE event_type = 'view'), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c)
SELECT user_id, prev AS gap_start, s AS gap_end FROM m WHERE prev IS NOT NULL AND s > prev""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between intervals (microseconds), whatever their overlaps."""
    s = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    c = read(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", s.alias("s"), (s + 1_000_000 * F.get_json_object("props", "$.k").cast("long")).alias("e"))
    prev = F.max("e").over(Window.partitionBy("user_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("gap_start", prev).where("gap_start is not null and s > gap_start").select("user_id", "gap_start", F.col("s").alias("gap_end"))
