"""A cost model with projection, positions against the uniform distribution, last-wins files, gated releases, and matching by rare words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import stats
from assaykit.operators import gates, matching
from assaykit.plans.judging import N, now
from assaykit.plans.registry import query
from assaykit.plans.texts import TALK_SQL, WORDS, talks
from assaykit.sources.files import last_lines
from assaykit.sources.tables import read
from assaykit.streaming.latest import work_folder

TOKENS = ("a", "b", "c")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, a, b, c, y): line items as calls: three classes of tokens and the cost."""
    part = [F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), F.round(F.col("l_discount") * 100).cast("double")]
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), *(p.alias(n) for p, n in zip(part, TOKENS, strict=True)), F.floor("l_extendedprice").cast("double").alias("y"))


RECEIPTS_SQL = "rc AS (SELECT l_returnflag AS cell, CAST(l_quantity AS DOUBLE) AS a, CAST(l_linenumber AS DOUBLE) AS b, CAST(round(l_discount * 100) AS DOUBLE) AS c, CAST(floor(l_extendedprice) AS DOUBLE) AS y FROM lineitem)"
#: Cramer's rule, where the library has Cholesky's factors.
FITTED_SQL = RECEIPTS_SQL + """, sm AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS "by", sum(c * y) AS cy FROM rc),
dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM sm),
cf AS (SELECT n, (ay * (bb * cc - bc * bc) - ab * ("by" * cc - bc * cy) + ac * ("by" * bc - bb * cy)) / det AS ca, (aa * ("by" * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - "by" * ac)) / det AS cb,
  (aa * (bb * cy - "by" * bc) - ab * (ab * cy - "by" * ac) + ay * (ab * bc - bb * ac)) / det AS cc FROM dt)"""


def fitted(rows: DataFrame) -> DataFrame:
    """One row: n and the coefficients of the three classes."""
    names = [*TOKENS, "y"]
    sums = [F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for i, p in enumerate(names) for q in names[i:]]
    return stats.least_squares(rows.agg(F.count(F.lit(1)).alias("n"), *sums), list(TOKENS), "y").select("n", *(f"c_{t}" for t in TOKENS))


@query(f"WITH {FITTED_SQL} SELECT n, round(ca, 4) AS c_a, round(cb, 4) AS c_b, round(cc, 4) AS c_c, round(1 - cb / ca, 4) AS discount, round((SELECT avg(abs(ca * a + cb * b + cf.cc * c - y)) FROM rc), 2) AS residual FROM cf")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of three classes of tokens, fitted to what calls cost, with the mean absolute residual."""
    rows = receipts(spark, sf_dir)
    fit = fitted(rows)
    off = F.avg(F.abs(sum(F.col(f"c_{t}") * F.col(t) for t in TOKENS) - F.col("y")))
    residual = rows.join(F.broadcast(fit)).agg(off.alias("residual"))  # fit is one row
    return fit.join(F.broadcast(residual)).select("n", *(F.round(f"c_{t}", 4).alias(f"c_{t}") for t in TOKENS), F.round(1 - F.col("c_b") / F.col("c_a"), 4).alias("discount"), F.round("residual", 2).alias("residual"))


@query(f"""WITH {FITTED_SQL}, gr AS (SELECT cell, count(*) AS calls, avg(y) AS usd, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, sum(b) / sum(a + b) AS hit FROM rc GROUP BY cell), pl AS (SELECT unnest([1, 8]) AS k, unnest([3, 2]) AS runs)
SELECT cell, CAST(k AS INTEGER) AS k, calls, round(usd, 4) AS usd_per_call, round(hit, 6) AS hit_rate, CAST(495 * k * runs AS BIGINT) AS planned, round(495 * k * runs * usd, 2) AS by_mean, round(495 * k * runs * (ca * ma + cb * mb + cf.cc * mc), 2) AS by_model FROM gr, pl, cf""")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planned calls of each cell cost, one sample or eight, by its mean cost and by the fitted prices."""
    rows = receipts(spark, sf_dir)
    means = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("calls"), F.avg("y").alias("usd"), *(F.avg(t).alias(f"m_{t}") for t in TOKENS), (F.sum("b") / F.sum(F.col("a") + F.col("b"))).alias("hit"))
    plan = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(495 * k * runs).cast("long").alias("planned")) for k, runs in ((1, 3), (8, 2)))))
    laid = means.join(F.broadcast(fitted(rows))).select("*", plan.alias("p"))
    model = sum(F.col(f"c_{t}") * F.col(f"m_{t}") for t in TOKENS)
    return laid.select("cell", "p.k", "calls", F.round("usd", 4).alias("usd_per_call"), F.round("hit", 6).alias("hit_rate"), "p.planned", F.round(F.col("p.planned") * F.col("usd"), 2).alias("by_mean"), F.round(F.col("p.planned") * model, 2).alias("by_model"))


PHASE_SQL = "WITH x AS (SELECT event_type, (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 * CASE WHEN event_type = 'click' THEN 0.5 WHEN event_type = 'view' THEN 1.5 ELSE 1.0 END + event_id % 10 / 10.0)::DOUBLE / 16 AS x FROM events)"


@query(f"""{PHASE_SQL}, c AS (SELECT event_type, x, count(*) AS c FROM x GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY event_type) AS n, sum(c) OVER (PARTITION BY event_type ORDER BY x) AS u FROM c),
g AS (SELECT event_type, CAST(sum(c) AS BIGINT) AS n, sum(x * c) / sum(c) AS mean, max(greatest(CAST(u AS DOUBLE) / n - x, x - CAST(u - c AS DOUBLE) / n)) AS d, {", ".join(f"CAST(sum(CASE WHEN least(9, floor(x * 10)) = {i} THEN c ELSE 0 END) AS BIGINT) AS d{i}" for i in range(10))},
  sum(CASE WHEN x < 0.3 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE) AS first, sum(CASE WHEN x >= 0.7 THEN c ELSE 0 END) / CAST(sum(c) AS DOUBLE) AS last FROM r GROUP BY event_type), l AS (SELECT *, d * sqrt(n) AS z FROM g)
SELECT event_type, n, round(mean, 9) AS mean, round(d, 9) AS d, round(CASE WHEN z <= 0.04 THEN 1.0 WHEN z < 1.18 THEN 1 - sqrt(2 * pi()) / z * list_sum(list_transform(range(1, 30), lambda k: exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * z * z)))) ELSE greatest(0.0, 2 * list_sum(list_transform(range(1, 30), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * z * z)))) END, 6) AS p,
  concat_ws(' ', {", ".join(f"d{i}" for i in range(10))}) AS deciles, round(first, 9) AS first, round(last, 9) AS last, CASE WHEN mean < 0.45 THEN 'early' WHEN mean > 0.55 THEN 'late' ELSE 'roughly uniform' END AS skew FROM l""")
def position_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where events stand in a made-up phase against the uniform distribution: distance with its chance, tenths, and lean."""
    kind = F.col("event_type")
    x = (F.get_json_object("props", "$.k").cast("long") % 10 * F.when(kind == "click", 0.5).when(kind == "view", 1.5).otherwise(1.0) + F.col("event_id") % 10 / F.lit(10.0)) / 16
    out = stats.against_uniform(read(spark, sf_dir, "events").select("event_type", x.alias("x")), "x", "event_type")
    return out.withColumns({**{c: F.round(c, 9) for c in ("mean", "d", "first", "last")}, "p": F.round("p", 6), "deciles": F.array_join(F.col("deciles").cast("array<string>"), " ")})


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(CAST(event_id AS VARCHAR)) DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def last_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each key over several JSON-lines files, written in an order that is no column's."""
    folder = work_folder(spark, "lines")
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.md5(F.col("event_id").cast("string")).alias("_o"))
    rows.repartitionByRange(4, "_o", "event_id").sortWithinPartitions("_o", "event_id").drop("_o").write.json(folder)
    return last_lines(spark, folder, rows.drop("_o").schema, ["user_id", "event_type"])


@query(f"""{N}, v AS (SELECT unnest(['strict', 'loose']) AS version, unnest([4, 1]) AS least), x AS (SELECT version, parse_failure AS c0, score <= least AS c1, severity = 'peripheral' AND version = 'strict' AS c2 FROM j, v),
s AS (SELECT version, [count(*) FILTER (c0), count(*) FILTER (c1 AND NOT c0), count(*) FILTER (c2 AND NOT c1 AND NOT c0), count(*) FILTER (NOT c0 AND NOT c1 AND NOT c2)] AS n, [count(*) FILTER (c0), count(*) FILTER (c1), count(*) FILTER (c2), 0] AS a FROM x GROUP BY version)
SELECT version, unnest(['unread', 'low', 'peripheral', 'kept']) AS cause, unnest(n) AS n, CAST(unnest(a) AS BIGINT) AS all_failing FROM s""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two versions of the exclusion rules leave out, by first cause and in all."""
    low, none = F.col("score"), F.lit(False)
    causes = {v: {"unread": F.col("parse_failure"), "low": low <= least, "peripheral": (F.col("severity") == "peripheral") if v == "strict" else none} for v, least in (("strict", 4), ("loose", 1))}
    return gates.cause_report(now(spark, sf_dir), causes)


@query(f"""{N} SELECT event_id, user_id, event_type, replicate, score FROM j WHERE NOT parse_failure AND score > 1""")
def gated_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements that pass the rules, read back from a release that was written behind its gates."""
    folder = f"{work_folder(spark, 'release')}/judgements"
    rows = now(spark, sf_dir).select("event_id", "user_id", "event_type", "replicate", "score", "parse_failure")
    gates.release(rows, {"unread": F.col("parse_failure"), "low": F.col("score") <= 1}, {"most are kept": lambda n: 2 * n["kept"] >= n["read"]}, folder)
    return spark.read.parquet(folder).drop("parse_failure")


@query(f"""WITH {TALK_SQL}, r AS (SELECT conv_id, {WORDS.format(t="transcript")} AS w FROM t WHERE transcript IS NOT NULL), m AS (SELECT conv_id, {WORDS.format(t="'zqzq ' || note")} AS w FROM t WHERE note IS NOT NULL), nn AS (SELECT count(*) AS n FROM r),
rt AS (SELECT conv_id, g, count(*) AS tf FROM (SELECT conv_id, unnest(w) AS g FROM r) GROUP BY ALL), mt AS (SELECT conv_id, g, count(*) AS tf FROM (SELECT conv_id, unnest(w) AS g FROM m) GROUP BY ALL),
d AS (SELECT g, ln(CAST(any_value(n) AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM rt, nn GROUP BY g), rw AS (SELECT conv_id, g, tf * idf AS w FROM rt JOIN d USING (g)), mw AS (SELECT conv_id, g, tf * coalesce(idf, ln(CAST((SELECT n FROM nn) AS DOUBLE)) + 1) AS w FROM mt LEFT JOIN d USING (g)),
rn AS (SELECT conv_id, sqrt(sum(w * w)) AS l FROM rw GROUP BY 1), mn AS (SELECT conv_id, sqrt(sum(w * w)) AS l FROM mw GROUP BY 1), p AS (SELECT mw.conv_id AS note_id, rw.conv_id AS conv_id, sum(mw.w * rw.w) AS dot FROM mw JOIN rw USING (g) GROUP BY ALL),
c AS (SELECT note_id, p.conv_id, dot / (mn.l * rn.l) AS cosine FROM p JOIN mn ON mn.conv_id = note_id JOIN rn ON rn.conv_id = p.conv_id)
SELECT note_id, conv_id, round(cosine, 7) AS cosine FROM c WHERE cosine >= 0.2""")
def cosine_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts whose tf-idf cosine with a note, which has a word that no transcript has, is 0.2 or more."""
    t = talks(spark, sf_dir)
    notes = t.where("note is not null").select(F.col("conv_id").alias("note_id"), F.concat(F.lit("zqzq "), "note").alias("text"))
    found = matching.cosine_matches(notes, t.select("conv_id", F.col("transcript").alias("text")), "note_id", "conv_id", "text", 0.2)
    return found.withColumn("cosine", F.round("cosine", 7))
