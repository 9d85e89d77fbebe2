"""Read-outs composed of the operators: lists in replies, decisions on notes, whole cells, rounds, sites, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.functions import replies
from assaykit.functions.stats import wilson
from assaykit.functions.text import flat
from assaykit.operators import decisions
from assaykit.operators.numbering import numbered
from assaykit.operators.sampling import stable
from assaykit.plans.judging import N, T, low_high_sql, now, pairs
from assaykit.plans.registry import query
from assaykit.plans.texts import TALK_SQL, talks
from assaykit.sources.tables import read

C = "c AS (SELECT * FROM conversations WHERE text IS NOT NULL)"
#: What annotators write for no finding; weights of severities; credits of verdicts.
NO_ANNOTATION = ("", "na", "n/a", "none", "no errors", "no error", "-")
WEIGHTS = {"critical": 3.0, "supporting": 2.0, "peripheral": 1.0}
CREDIT = {"full": 1.0, "partial": 0.5, "absent": 0.0}


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("text is not null")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _listed(turns: DataFrame, item: Column, field: str, more: str = "") -> DataFrame:
    """A reply for each conversation, whose list holds the turns' items in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda s: s["item"])
    return turns.groupBy("conv_id").agg(F.concat(F.lit(f'Here: {{"{field}": ['), F.array_join(ordered, ", "), F.lit(f"]{more}}} done.")).alias("reply"))


@query(f"""WITH {C}, k AS (SELECT conv_id, text, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE lower(trim(['', 'F1', ' f1 ', 'x'][turn % 4 + 1])) END AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM c WHERE (conv_id + turn) % 7 <> 0),
b AS (SELECT *, CASE WHEN id = '' THEN 'f' || n ELSE id END AS base FROM k)
SELECT conv_id, CAST(n - 1 AS INTEGER) AS place, CASE WHEN row_number() OVER (PARTITION BY conv_id, base ORDER BY n) > 1 THEN base || '_' || n ELSE base END AS id, md5(text) AS fact FROM b""")
def fact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read from replies: plain strings, missing and repeated ids, and empty facts among them."""
    fact = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "").otherwise(F.col("text"))
    plain = F.to_json(F.array(fact))
    item = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.substring(plain, F.lit(2), F.length(plain) - 2)).otherwise(F.to_json(F.struct(_pick(("", "F1", " f1 ", "x"), F.col("turn")).alias("id"), fact.alias("fact"))))
    found = _listed(_turns(spark, sf_dir), item, "facts").select("conv_id", F.posexplode(replies.facts(F.col("reply"))).alias("place", "f"))
    return found.select("conv_id", "place", "f.id", F.md5("f.fact").alias("fact"))


@query(f"""WITH {C}, k AS (SELECT conv_id, turn, 't' || CASE turn % 3 WHEN 1 THEN turn - 1 ELSE turn END AS id, lower(trim(['Critical', '', 'peripheral ', 'huge'][(conv_id + turn) % 4 + 1])) AS s FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) AS n FROM k WHERE id IN ('t0', 't2', 't4', 't6'))
SELECT conv_id, id, CASE WHEN s IN ('critical', 'supporting', 'peripheral') THEN s ELSE 'supporting' END AS severity, s NOT IN ('critical', 'supporting', 'peripheral') AS defaulted FROM f WHERE n = 1""")
def audit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit keeps of four candidates: repeated and unknown ids go, unknown severities are marked."""
    turn = F.col("turn")
    named = F.concat(F.when(turn % 3 == 0, "T").otherwise("t"), F.when(turn % 3 == 1, turn - 1).otherwise(turn).cast("string"))
    item = F.to_json(F.struct(named.alias("id"), F.col("text").alias("fact"), _pick(("Critical", "", "peripheral ", "huge"), F.col("conv_id") + turn).alias("severity")))
    wanted = F.array(*map(F.lit, ("T0", "t2", "t4", "t6")))
    found = _listed(_turns(spark, sf_dir), item, "facts").select("conv_id", F.explode(replies.audited(F.col("reply"), wanted)).alias("f"))
    return found.select("conv_id", "f.id", "f.severity", "f.defaulted")


@query(f"""WITH {TALK_SQL}, {C}, f AS (SELECT conv_id AS note, turn, text, CASE turn % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, (conv_id * 7 + turn * 3) % 11 AS h FROM c),
v AS (SELECT *, CASE WHEN h < 4 THEN 'full' WHEN h < 6 THEN 'partial' WHEN h < 10 THEN 'absent' WHEN (note + turn) % 3 <> 0 THEN 'full' END AS v, CASE turn % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'full' ELSE 'no' END AS found, turn % 4 <> 2 AND length(text) >= 8 AS held FROM f),
r AS (SELECT *, v = 'absent' AND found <> 'no' AND held AS rescued, v = 'absent' AND found <> 'no' AND NOT held AS unproved FROM v),
g AS (SELECT note, count(*) AS n_facts, count(*) FILTER (v IS NULL) AS n_open, bool_or(h = 10) AS retried, count(*) FILTER (v = 'absent') AS absent, count(*) FILTER (rescued) AS flips, count(*) FILTER (unproved) AS unproved,
  sum(w * CASE CASE WHEN rescued THEN found ELSE v END WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) / sum(w) AS m FROM r GROUP BY note)
SELECT note, n_facts, n_open, retried, CASE WHEN n_open = 0 THEN absent END AS absent, CASE WHEN n_open = 0 THEN flips END AS flips, CASE WHEN n_open = 0 THEN unproved END AS unproved, round(CASE WHEN n_open = 0 THEN m END, 9) AS aggregate FROM g""")
def note_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes decided from landed verdicts, one retry, and a refuter's reply that is read from JSON."""
    h = (F.col("note") * 7 + F.col("fact") * 3) % 11
    facts = _turns(spark, sf_dir).select(F.col("conv_id").alias("note"), F.col("turn").alias("fact"), "text")
    weighted = facts.select("note", "fact", F.lit(list(WEIGHTS.values()))[(F.col("fact") % 3).cast("int")].alias("weight"))
    checked = facts.where(h < 10).select("note", "fact", F.when(h < 4, "full").when(h < 6, "partial").otherwise("absent").alias("verdict"))
    retried = facts.where((F.col("note") + F.col("fact")) % 3 != 0).select("note", "fact", F.lit("full").alias("verdict"))
    said = F.struct(_pick(("yes", "Partial", "full", "not found"), F.col("fact")).alias("found"), F.when(F.col("fact") % 4 == 2, "what nobody said").otherwise(F.substring(flat(F.col("text")), 1, 40)).alias("quote"))
    entry = F.concat(F.lit('"T'), F.col("fact").cast("string"), F.lit('": '), F.to_json(said))
    asked = facts.where((h >= 6) & (h < 10)).groupBy("note").agg(F.concat(F.lit('{"verdicts": {'), F.array_join(F.collect_list(entry), ", "), F.lit("}}")).alias("reply"), F.collect_list(F.concat(F.lit("t"), F.col("fact").cast("string"))).alias("wanted"))
    claims = asked.select("note", F.explode(replies.refuted(F.col("reply"), F.col("wanted"))).alias("c")).select("note", F.substring("c.id", 2, 20).cast("long").alias("fact"), "c.found", "c.quote")
    texts = talks(spark, sf_dir).select(F.col("conv_id").alias("note"), F.col("transcript").alias("text"))
    return decisions.decide(weighted, checked, retried, claims, texts, CREDIT).withColumn("aggregate", F.round("aggregate", 9))


CELL_LOW, CELL_HIGH = low_high_sql("hits", "units")


@query(f"""{T}, u AS (SELECT user_id, event_type, replicate, NOT (parse_failure OR clean_failure) AND clean_score > score AS hit, CAST(NOT (parse_failure OR clean_failure) AND clean_score = score AS INT) AS tie, CAST(parse_failure OR clean_failure AS INT) AS failed, CASE WHEN NOT (parse_failure OR clean_failure) THEN clean_score - score END AS gap,
  unnest(list_filter(['discrimination/overall', 'type/' || pair_type, 'stratum/' || stratum, CASE WHEN pair_type = 'omit' THEN 'omission/' || severity END], lambda x: x IS NOT NULL)) AS cell FROM tw
  UNION ALL SELECT user_id, event_type, replicate, flagged, NULL, NULL, NULL, 'false alarms/overall' FROM j WHERE role = 'clean'),
p AS (SELECT cell, replicate, avg(CAST(hit AS INT)) AS rate, avg(tie) AS tie, avg(failed) AS failed, avg(gap) AS gap FROM u GROUP BY ALL),
a AS (SELECT cell, count(*) AS runs, avg(rate) AS mean, coalesce(stddev_samp(rate), 0.0) AS sd, avg(tie) AS ties, avg(failed) AS failures, avg(gap) AS gap FROM p GROUP BY cell),
m AS (SELECT cell, user_id, event_type, 2 * count(*) FILTER (hit) > count(*) AS hit FROM u GROUP BY ALL), w AS (SELECT cell, count(*) AS units, count(*) FILTER (hit) AS hits FROM m GROUP BY cell)
SELECT cell, runs, round(mean, 9) AS mean, round(sd, 9) AS sd, round(ties, 9) AS ties, round(failures, 9) AS failures, round(gap, 9) AS gap, units, hits, {CELL_LOW} AS low, {CELL_HIGH} AS high FROM a JOIN w USING (cell)""")
def whole_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of a cell: mean and spread over runs by type, stratum and severity, and the majority over runs with its interval."""
    failed = F.col("parse_failure") | F.col("clean_failure")
    margin = F.col("clean_score") - F.col("score")
    names = F.array_compact(F.array(F.lit("discrimination/overall"), F.concat(F.lit("type/"), "pair_type"), F.concat(F.lit("stratum/"), F.col("stratum").cast("string")), F.when(F.col("pair_type") == "omit", F.concat(F.lit("omission/"), "severity"))))
    unit = ["user_id", "event_type", "replicate"]
    errored = pairs(spark, sf_dir).select(*unit, (~failed & (margin > 0)).alias("hit"), (~failed & (margin == 0)).cast("int").alias("tie"), failed.cast("int").alias("failed"), F.when(~failed, margin).alias("gap"), F.explode(names).alias("cell"))
    clean = now(spark, sf_dir).where("role = 'clean'").select(*unit, F.col("flagged").alias("hit"), F.lit("false alarms/overall").alias("cell"))
    every = errored.unionByName(clean, allowMissingColumns=True)
    run = every.groupBy("cell", "replicate").agg(F.avg(F.col("hit").cast("int")).alias("rate"), *(F.avg(c).alias(c) for c in ("tie", "failed", "gap")))
    over = run.groupBy("cell").agg(F.count(F.lit(1)).alias("runs"), F.avg("rate").alias("mean"), F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("sd"), F.avg("tie").alias("ties"), F.avg("failed").alias("failures"), F.avg("gap").alias("gap"))
    majority = every.groupBy("cell", "user_id", "event_type").agg((2 * F.count_if("hit") > F.count(F.lit(1))).alias("hit")).groupBy("cell").agg(F.count(F.lit(1)).alias("units"), F.count_if("hit").alias("hits"))
    low, high = wilson("hits", "units")
    rounded = [F.round(c, 9).alias(c) for c in ("mean", "sd", "ties", "failures", "gap")]
    return over.join(majority, "cell").select("cell", "runs", *rounded, "units", "hits", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""WITH {C}, w AS (SELECT DISTINCT conv_id, role = 'user' AS ours, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM c WHERE role IN ('user', 'assistant')),
m AS (SELECT *, EXISTS (FROM w x WHERE x.conv_id = w.conv_id AND x.ours <> w.ours AND x.word[1:4] = w.word[1:4]) AS met FROM w)
SELECT conv_id, count(*) FILTER (ours) AS n_ours, count(*) FILTER (NOT ours) AS n_theirs, CAST(count(*) FILTER (ours AND met) AS DOUBLE) / nullif(count(*) FILTER (ours), 0) AS recall, CAST(count(*) FILTER (NOT ours AND met) AS DOUBLE) / nullif(count(*) FILTER (NOT ours), 0) AS precision FROM m GROUP BY conv_id""")
def fact_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of one side's words that the other has, both ways; words match by their first four letters, counted without forming pairs."""
    words = _turns(spark, sf_dir).where("role in ('user', 'assistant')").select("conv_id", (F.col("role") == "user").alias("ours"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("word")).distinct()
    stem = words.groupBy("conv_id", F.substring("word", 1, 4).alias("stem")).agg(F.count_if("ours").alias("a"), F.count_if(~F.col("ours")).alias("b"))
    g = stem.groupBy("conv_id").agg(F.sum("a").alias("n_ours"), F.sum("b").alias("n_theirs"), F.sum(F.when(F.col("b") > 0, F.col("a")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("a") > 0, F.col("b")).otherwise(0)).alias("_b"))
    return g.select("conv_id", "n_ours", "n_theirs", (F.col("_a") / F.nullif("n_ours", F.lit(0))).alias("recall"), (F.col("_b") / F.nullif("n_theirs", F.lit(0))).alias("precision"))


@query(f"""{N}, a AS (SELECT user_id, event_type, CASE WHEN NOT parse_failure THEN score END AS score FROM j WHERE replicate = 1), b AS (SELECT user_id, event_type, score AS later FROM j WHERE replicate = 2 AND NOT parse_failure AND k % 2 = 1)
SELECT user_id, event_type, coalesce(score, later) AS score, CASE WHEN score IS NOT NULL THEN 'first' WHEN later IS NOT NULL THEN 'completed' ELSE 'open' END AS origin FROM a LEFT JOIN b USING (user_id, event_type)""")
def folded_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed first records filled from a completion pass."""
    j, keys = now(spark, sf_dir), ["user_id", "event_type"]
    first = j.where("replicate = 1").select(*keys, F.when(~F.col("parse_failure"), F.col("score")).alias("score"))
    return decisions.folded(first, j.where("replicate = 2 and not parse_failure and k % 2 = 1"), keys, "score")


@query(f"""{N}, f AS (SELECT user_id, k % 10 AS kind, replicate, event_id FROM j WHERE flagged), s AS (SELECT user_id, kind, 1 AS round, min(event_id) AS event_id FROM f WHERE replicate = 1 GROUP BY ALL), t AS (SELECT user_id, kind, 2 AS round, min(event_id) AS event_id FROM f WHERE replicate = 2 GROUP BY ALL)
FROM s UNION ALL SELECT t.* FROM t ANTI JOIN s USING (user_id, kind)""")
def completeness_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a first round, and those of a second one that the first doesn't have."""
    found = now(spark, sf_dir).where("flagged").select("user_id", (F.col("k") % 10).alias("kind"), "replicate", "event_id")
    keys = ["user_id", "kind"]
    first = found.where("replicate = 1").groupBy(*keys).agg(F.min("event_id").alias("event_id"))
    more = decisions.harvested(first, found.where("replicate = 2"), keys, "event_id")
    return first.withColumn("round", F.lit(1)).unionByName(more.withColumn("round", F.lit(2)))


@query(f"""{N}, n AS (SELECT 2 * event_id AS note_no, CASE WHEN role = 'errored' THEN 'errored' ELSE 'error_free' END AS note_role, event_id AS pair_key FROM j WHERE replicate = 1 UNION ALL SELECT 2 * event_id + 1, 'clean_twin', event_id FROM j WHERE replicate = 1 AND role = 'errored')
SELECT *, row_number() OVER (ORDER BY note_no) - 1 AS item_index FROM n""")
def note_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each judgement to buy: a note as it is, and the clean twin of an errored one, numbered in key order."""
    errored = F.col("role") == "errored"
    kinds = F.array_compact(F.array(F.when(errored, "errored").otherwise("error_free"), F.when(errored, "clean_twin")))
    notes = now(spark, sf_dir).where("replicate = 1").select(F.col("event_id").alias("pair_key"), F.explode(kinds).alias("note_role"))
    return numbered(notes.withColumn("note_no", 2 * F.col("pair_key") + (F.col("note_role") == "clean_twin").cast("long")), "note_no", "item_index")


@query(f"""WITH {C}, l AS (SELECT conv_id, turn, CASE WHEN (turn // 2) % 2 = 0 THEN '-' ELSE '+' END AS sign, replace(substr(text, 1, 30), chr(10), ' ') AS body, turn >= 3 AS hunk FROM c),
s AS (SELECT *, CAST(sign <> lag(sign) OVER w OR hunk <> lag(hunk) OVER w AS INT) AS new FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS run FROM s)
SELECT conv_id, CAST(run AS INTEGER) AS run, any_value(sign) AS sign, CAST(count(*) AS INTEGER) AS lines, string_agg(body, '|' ORDER BY turn) AS body FROM r GROUP BY conv_id, run""")
def diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of removed and added lines of diffs in two hunks."""
    line = F.concat(F.when(F.floor(F.col("turn") / 2) % 2 == 0, "-").otherwise("+"), F.translate(F.substring("text", 1, 30), "\n", " "))
    shown = F.concat(F.when(F.col("turn") == 3, "@@ next @@\n").otherwise(""), line)
    diffs = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", shown.alias("line")))), lambda s: s["line"]), "\n").alias("diff"))
    runs = diffs.select("conv_id", F.posexplode(replies.hunk_runs(F.col("diff"))).alias("run", "r"))
    return runs.select("conv_id", "run", "r.sign", F.size("r.lines").alias("lines"), F.array_join("r.lines", "|").alias("body"))


@query(f"""WITH {C}, s AS (SELECT conv_id, turn AS site, ['stated', 'partial', 'implied', 'partial', 'named'][(conv_id + turn) % 5 + 1] AS strength, 400 * turn AS s, 400 * turn + length(text) AS e, (conv_id + 2 * turn) % 17 <> 0 AS found, turn = 0 AND conv_id % 6 <> 0 AS p FROM c),
o AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY s, e) > s, false) AS o, CASE strength WHEN 'stated' THEN 1 WHEN 'implied' THEN 2 ELSE 0 END AS r FROM s),
g AS (SELECT conv_id, count(*) AS n_sites, bool_and(found) AND NOT bool_or(o) AND bool_or(p) AS eligible, first(site ORDER BY r, s) FILTER (r > 0 AND NOT p) AS a, first(site ORDER BY s) FILTER (strength = 'partial' AND NOT p) AS b FROM o GROUP BY conv_id)
SELECT conv_id, n_sites, eligible, CASE WHEN eligible THEN a END AS strong_site, CASE WHEN eligible THEN b END AS weak_site FROM g""")
def survivor_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which mention of a fact may survive a removal, where all of its mentions were found and none overlap."""
    conv, turn = F.col("conv_id"), F.col("turn")
    sites = _turns(spark, sf_dir).select("conv_id", turn.alias("site"), _pick(("stated", "partial", "implied", "partial", "named"), conv + turn).alias("strength"), (400 * turn).alias("start"), (400 * turn + F.length("text")).alias("end"), ((conv + 2 * turn) % 17 != 0).alias("found"), ((turn == 0) & (conv % 6 != 0)).alias("is_primary"))
    return decisions.survivors(sites, "conv_id", ("stated", "implied"), "partial")


@query(f"""WITH {C}, i AS (SELECT conv_id, ['omission', 'addition', 'other'][(conv_id + turn) % 11 // 5 + 1] AS kind, turn % 4 <> 3 OR conv_id % 3 = 0 AS fine, conv_id % 5 AS h FROM c)
SELECT conv_id, bool_and(kind <> 'other') AND h <> 0 AS valid, CASE WHEN bool_and(kind <> 'other') AND h <> 0 THEN bool_and(fine) END AS passes, conv_id % 4 <> 1 AS claimed FROM i GROUP BY conv_id, h""")
def audit_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of a sound form (known kinds, a note of 40 characters); whether they pass follows from their items, not from what they claim."""
    conv, turn = F.col("conv_id"), F.col("turn")
    item = F.to_json(F.struct(F.element_at(F.array(*map(F.lit, ("omission", "addition", "other"))), (F.floor((conv + turn) % 11 / 5) + 1).cast("int")).alias("kind"), F.when((turn % 4 != 3) | (conv % 3 == 0), "ok").otherwise("bad").alias("verdict")))
    landed = _listed(_turns(spark, sf_dir), item, "audit", ', "pass": true').withColumn("reply", F.when(conv % 4 == 1, F.replace("reply", F.lit('"pass": true'), F.lit('"pass": false'))).otherwise(F.col("reply"))).select("conv_id", F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "audit array<struct<kind: string, verdict: string>>, pass boolean").alias("r"))
    note = F.when(conv % 5 == 0, "too short").otherwise(F.repeat(F.lit("a verified note "), F.lit(4)))
    valid = F.coalesce(F.forall("r.audit", lambda x: x["kind"].isin("omission", "addition")), F.lit(False)) & (F.length(F.trim(note)) >= 40)
    return landed.select("conv_id", valid.alias("valid"), F.when(valid, F.forall("r.audit", lambda x: x["verdict"] == "ok")).alias("passes"), F.col("r.pass").alias("claimed"))


@query(f"""WITH {C} SELECT conv_id * 100 + turn AS item, len(regexp_extract_all(lower(text), '\\b(hen|with|stan)\\b')) AS hits, turn % 3 <> 0 AS reviewed FROM c WHERE regexp_matches(lower(text), '\\b(hen|with|stan)\\b')""")
def keyword_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with one of the words, and whether the reviewed list clears them."""
    turns = _turns(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("item"), F.lower("text").alias("text"), "turn")
    return decisions.reviewed_hits(turns, "item", "text", r"\b(hen|with|stan)\b", turns.where("turn % 3 <> 0")).withColumn("hits", F.col("hits").cast("long"))


@query("""WITH p AS (SELECT * FROM (VALUES ('en', 0.5), ('de', 0.2), ('fr', 0.2), ('xx', 0.1)) t(lang, published)), d AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), s AS (SELECT lang, n, CAST(n AS DOUBLE) / sum(n) OVER () AS share FROM d)
SELECT lang, coalesce(n, 0) AS n, round(coalesce(share, 0.0), 9) AS share, CAST(published AS DOUBLE) AS published, round(coalesce(share, 0.0) - published, 9) AS difference FROM p FULL JOIN s USING (lang)""")
def frame_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of classes beside published ones; a class that only one side has stays."""
    frame = spark.createDataFrame([("en", 0.5), ("de", 0.2), ("fr", 0.2), ("xx", 0.1)], "lang string, published double")
    counts = read(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    both = frame.join(counts.withColumn("_all", F.sum("n").over(Window.partitionBy())), "lang", "full")  # one row for each class
    share = F.coalesce(F.col("n") / F.col("_all"), F.lit(0.0))
    return both.select("lang", F.coalesce("n", F.lit(0)).alias("n"), F.round(share, 9).alias("share"), "published", F.round(share - F.col("published"), 9).alias("difference"))


@query(f"""WITH {C}, a AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN ' None ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN 'No errors' WHEN 4 THEN NULL ELSE text END AS a FROM c)
SELECT conv_id, turn, lower(trim(coalesce(a, ''))) NOT IN ('', 'na', 'n/a', 'none', 'no errors', 'no error', '-') AS annotated FROM a""")
def annotation_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("turn") % 6
    said = F.when(kind == 0, " None ").when(kind == 1, "N/A").when(kind == 2, "").when(kind == 3, "No errors").when(kind == 5, F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", (~F.lower(F.trim(F.coalesce(said, F.lit("")))).isin(*NO_ANNOTATION)).alias("annotated"))


@query(f"""{N} SELECT event_id, role, level FROM j WHERE role = 'clean' OR level IN ('complete', 'partial-weak')""")
def confirmatory_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return now(spark, sf_dir).where("role = 'clean' or level in ('complete', 'partial-weak')").select("event_id", "role", "level")


@query("""SELECT doc_id FROM documents ORDER BY md5('audit' || doc_id), doc_id LIMIT 25""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by hash order."""
    return read(spark, sf_dir, "documents").select("doc_id").orderBy(stable(F.col("doc_id"), "audit"), "doc_id").limit(25)
