"""Notes, findings, vectors, provenance, and the log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.functions import text
from assaykit.operators import edits, notes, provenance
from assaykit.plans.judging import N, T, now, pairs
from assaykit.plans.registry import query
from assaykit.plans.texts import TALK_SQL, talks
from assaykit.sources.tables import NEWEST_SQL, judgements, read
from assaykit.streaming.latest import newest_state, upsert_newest, work_folder


@query(f"{N} SELECT event_id, user_id, event_type, replicate, score FROM j")
def streamed_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest judgement per note and replicate, from the event log read as a stream."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder, log = work_folder(spark, "newest"), judgements(stream)
    upsert_newest(log, folder, ["user_id", "event_type", "replicate"], [F.desc("t"), F.desc("event_id")], buckets=16)
    state = newest_state(spark, folder, log.schema)
    return state.select("event_id", "user_id", "event_type", "replicate", "score")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM x GROUP BY vec_id), u AS (SELECT vec_id, label, d, x / n AS u FROM x JOIN n USING (vec_id) WHERE n > 0),
c AS (SELECT label, d, avg(u) AS m FROM u GROUP BY ALL), s AS (SELECT label, vec_id, sum(u * m) AS s FROM u JOIN c USING (label, d) GROUP BY ALL) SELECT label, vec_id, round(s, 7) AS mean_cosine FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS r FROM s) WHERE r = 1""")
def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.medoids(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("mean_cosine", F.round("mean_cosine", 7))


@query()
def cosine_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups within notes of up to 25 consecutive vectors."""
    e = read(spark, sf_dir, "embeddings").withColumn("note", F.floor(F.col("vec_id") / 25).cast("long"))
    return notes.cosine_groups(e, ["note"], "vec_id", "embedding", (0.2, 0.3, 0.9))


@query()
def turn_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns clustered greedily by their words."""
    return notes.greedy_clusters(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 0.3)


@query()
def note_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edited note keeps of its transcript, word by word."""
    t = talks(spark, sf_dir).where("note is not null").select("conv_id", "transcript", F.concat(F.lit("In short: "), F.replace("note", F.lit("the "), F.lit("our "))).alias("note"))
    return edits.word_changes(t, "transcript", "note").drop("transcript", "note")


QUOTES_SQL = f"""WITH {TALK_SQL}, n AS (SELECT conv_id, lower(trim(regexp_replace(transcript, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ')) AS t, lower(trim(regexp_replace(note, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), ' ')) AS n FROM t WHERE note IS NOT NULL),
q AS (SELECT conv_id, t, trim(CASE conv_id % 6 WHEN 0 THEN n WHEN 1 THEN substr(n, 1, 85) || ' zzz' WHEN 2 THEN substr(n, 1, 35) || ' zzz' WHEN 3 THEN array_to_string(list_reverse(string_split(n, ' ')), ' ') WHEN 4 THEN 'none' ELSE 'qqzzqq vvzzvv' END, ' ') AS q FROM n),
w AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(list_filter(string_split(q, ' '), lambda w: length(w) >= 6)), lambda w: {{'n': -length(w), 'w': w}}))[1:6], lambda s: s.w) AS w FROM q),
f AS (SELECT *, list_filter(w, lambda x: length(t) - length(replace(t, x, '')) = length(x)) AS once, list_filter(w, lambda x: contains(t, x)) AS held FROM w),
h AS (SELECT *, CASE WHEN q IN ('', '-', 'n/a', 'none') OR t = '' THEN 'no_quote' WHEN contains(t, q) THEN 'exact' WHEN length(q) > 80 AND contains(t, substr(q, 1, 80)) THEN 'prefix80' WHEN length(q) > 50 AND contains(t, substr(q, 1, 50)) THEN 'prefix50' WHEN length(q) > 30 AND contains(t, substr(q, 1, 30)) THEN 'prefix30' WHEN len(once) > 0 THEN 'unique_word' WHEN len(held) > 0 THEN 'word' ELSE 'not_found' END AS how FROM f),
p AS (SELECT *, CASE how WHEN 'exact' THEN q WHEN 'prefix80' THEN substr(q, 1, 80) WHEN 'prefix50' THEN substr(q, 1, 50) WHEN 'prefix30' THEN substr(q, 1, 30) WHEN 'unique_word' THEN once[1] WHEN 'word' THEN held[1] END AS part FROM h)
SELECT conv_id, how, round(CASE WHEN part IS NOT NULL THEN (instr(t, part) - 1) / CAST(length(t) AS DOUBLE) END, 9) AS position FROM p"""


@query(QUOTES_SQL)
def quote_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes stand: the note itself, its beginnings with something added, its words backwards, no quote, and words it lacks."""
    n, kind = text.flat(F.col("note")), F.col("conv_id") % 6
    added = [F.concat(F.substring(n, 1, k), F.lit(" zzz")) for k in (85, 35)]
    quote = F.when(kind == 0, n).when(kind == 1, added[0]).when(kind == 2, added[1]).when(kind == 3, F.array_join(F.reverse(F.split(n, " ")), " ")).when(kind == 4, "none").otherwise("qqzzqq vvzzvv")
    asked = talks(spark, sf_dir).where("note is not null").select("conv_id", "transcript", quote.alias("quote"))
    found = asked.select("conv_id", notes.locate(F.col("transcript"), F.col("quote")).alias("l"))
    return found.select("conv_id", "l.how", F.round("l.position", 9).alias("position"))


@query()
def balanced_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve critical judgements of the first run, balanced over stratum and type."""
    j = now(spark, sf_dir).where("severity = 'critical' and replicate = 1")
    return notes.spread(j, ["stratum", "event_type"], "event_id", 12)


@query()
def boschloo_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each consultation's flags, errored against clean."""
    e, f = F.col("role") == "errored", F.col("flagged")
    g = now(spark, sf_dir).groupBy("user_id").agg(F.count_if(e & f).alias("a"), F.count_if(e & ~f).alias("b"), F.count_if(~e & f).alias("c"), F.count_if(~e & ~f).alias("d"))
    return g.select("user_id", "a", "b", "c", "d", notes.boschloo(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 50).alias("p"))


MANIFEST_SQL = """m AS (SELECT user_id AS run, count(*) AS calls, CAST(sum(floor(value * 100)) AS BIGINT) AS cents, count(DISTINCT event_type) AS kinds, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS worst FROM events GROUP BY user_id)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor(F.col("value") * 100)).alias("cents"), F.count_distinct("event_type").alias("kinds"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("worst"))


@query(f"""WITH {MANIFEST_SQL} SELECT run, 'few calls' AS problem FROM m WHERE NOT calls >= 60 UNION ALL SELECT run, 'missing kind' FROM m WHERE NOT kinds = 5 UNION ALL SELECT run, 'over budget' FROM m WHERE NOT cents <= 320000 UNION ALL SELECT run, 'parse failure' FROM m WHERE NOT worst < 99""")
def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"few calls": F.col("calls") >= 60, "missing kind": F.col("kinds") == 5, "over budget": F.col("cents") <= 320_000, "parse failure": F.col("worst") < 99}
    return provenance.problems(manifests(spark, sf_dir), ["run"], rules)


@query("""WITH a AS (SELECT item_id, md5(text) AS h FROM benchmark WHERE item_id % 5 <> 0), b AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM benchmark WHERE item_id % 3 <> 0)
SELECT item_id, CASE WHEN a.h IS NULL THEN 'untracked' WHEN b.h IS NULL THEN 'missing' ELSE 'changed' END AS state FROM a FULL JOIN b USING (item_id) WHERE a.h IS DISTINCT FROM b.h""")
def prompt_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    recorded = b.where("item_id % 5 <> 0").select("item_id", F.md5("text").alias("h"))
    present = b.where("item_id % 3 <> 0").select("item_id", F.md5(F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return provenance.drift(recorded, present, "item_id", "h")


@query(f"""{N}, m AS (SELECT pair_type AS name, CAST(count(*) FILTER (flagged) AS DOUBLE) / count(*) AS value FROM j WHERE role = 'errored' GROUP BY 1), e AS (SELECT * FROM (VALUES ('omit', 0.8, 0.05), ('add', 0.8, 0.0001), ('swap', 0.5, 0.1)) t(name, value, tolerance))
SELECT e.name, e.value::DOUBLE AS expected, m.value AS measured, coalesce(abs(e.value::DOUBLE - m.value) <= e.tolerance::DOUBLE, false) AS ok FROM e LEFT JOIN m USING (name)""")
def number_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = now(spark, sf_dir).where("role = 'errored'").groupBy(F.col("pair_type").alias("name")).agg((F.count_if("flagged") / F.count(F.lit(1))).alias("value"))
    e = spark.createDataFrame([("omit", 0.8, 0.05), ("add", 0.8, 0.0001), ("swap", 0.5, 0.1)], "name string, value double, tolerance double")
    return provenance.guards(e, m, "name", "tolerance")


@query(f"""{N}, r AS (SELECT user_id, replicate, count(*) AS n FROM j GROUP BY ALL), a AS (SELECT user_id, count(*) FILTER (n = 5) AS replicates FROM r GROUP BY user_id) SELECT user_id, replicates, replicates >= 3 AS complete FROM a""")
def complete_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.complete_arms(now(spark, sf_dir), ["user_id"], "replicate", "event_type", 5)


@query(f"""{T}, s AS (SELECT user_id, replicate, max(CASE WHEN level = 'complete' THEN score - clean_score END) AS whole, max(CASE WHEN level = 'partial-weak' THEN score - clean_score END) AS part FROM tw GROUP BY ALL)
SELECT replicate, count(*) AS matched, count(*) FILTER (whole < part) AS whole_lower, count(*) FILTER (whole > part) AS part_lower FROM s WHERE whole IS NOT NULL AND part IS NOT NULL GROUP BY replicate""")
def matched_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete against partial omissions of the same consultation."""
    gap = F.col("score") - F.col("clean_score")
    s = pairs(spark, sf_dir).groupBy("user_id", "replicate").agg(F.max(F.when(F.col("level") == "complete", gap)).alias("w"), F.max(F.when(F.col("level") == "partial-weak", gap)).alias("p")).where("w is not null and p is not null")
    return s.groupBy("replicate").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("w") < F.col("p")).alias("whole_lower"), F.count_if(F.col("w") > F.col("p")).alias("part_lower"))


@query(f"""{N}, e AS (SELECT event_id, user_id, pair_type, coalesce(level, 'none') AS level, severity, CASE WHEN user_id % 10 = 0 THEN 'trained' WHEN user_id % 10 = 1 THEN 'development' END AS held_out_reason FROM j WHERE role = 'errored')
SELECT event_id, CASE WHEN pair_type = 'omit' THEN 'omission' WHEN pair_type IN ('add', 'change') THEN 'commission' ELSE 'unknown' END AS class, CASE WHEN pair_type <> 'omit' THEN NULL WHEN level = 'none' THEN 'complete' ELSE level END AS residual,
  CASE level WHEN 'complete' THEN 0 WHEN 'partial-weak' THEN 1 WHEN 'partial' THEN 2 WHEN 'partial-strong' THEN 3 END AS residual_order, CASE WHEN severity IN ('critical', 'supporting', 'peripheral') THEN severity ELSE 'ungraded' END AS grade, held_out_reason, held_out_reason IS NULL AS eval_set FROM e""")
def factorial_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, residual level and its order, severity with no default grade, and what is held out and why."""
    kind, level = F.col("pair_type"), F.coalesce("level", F.lit("none"))
    why = F.when(F.col("user_id") % 10 == 0, "trained").when(F.col("user_id") % 10 == 1, "development")
    order = F.when(level == "complete", 0).when(level == "partial-weak", 1).when(level == "partial", 2).when(level == "partial-strong", 3)
    return now(spark, sf_dir).where("role = 'errored'").select(
        "event_id", F.when(kind == "omit", "omission").when(kind.isin("add", "change"), "commission").otherwise("unknown").alias("class"), F.when(kind != "omit", None).when(level == "none", "complete").otherwise(level).alias("residual"), order.alias("residual_order"),
        F.when(F.col("severity").isin("critical", "supporting", "peripheral"), F.col("severity")).otherwise("ungraded").alias("grade"), why.alias("held_out_reason"), why.isNull().alias("eval_set"),
    )


@query(f"""{N}, f AS (SELECT user_id, replicate, list({{'severity': severity, 'verdict': CASE WHEN score > 7 THEN 'full' WHEN score > 3 THEN 'partial' ELSE 'absent' END, 'type': event_type}}) AS facts FROM j GROUP BY ALL)
SELECT user_id, replicate, len(list_filter(facts, lambda x: x.severity = 'critical' AND x.verdict = 'absent')) > 0 AS critical_absent, len(list_filter(facts, lambda x: x.verdict <> 'absent')) = len(facts) AS none_absent,
  CASE WHEN len(list_filter(facts, lambda x: x.verdict = 'absent')) = len(facts) THEN 'all' WHEN len(list_filter(facts, lambda x: x.verdict = 'absent')) > 0 THEN 'some' ELSE 'none' END AS cause, CAST(len(facts) AS INTEGER) AS n_facts FROM f""")
def fact_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates over a note's nested facts: any, all, and how many are absent."""
    verdict = F.when(F.col("score") > 7, "full").when(F.col("score") > 3, "partial").otherwise("absent")
    f = now(spark, sf_dir).groupBy("user_id", "replicate").agg(F.collect_list(F.struct("severity", verdict.alias("verdict"))).alias("facts"))
    absent = lambda x: x["verdict"] == "absent"
    cause = F.when(F.forall("facts", absent), "all").when(F.exists("facts", absent), "some").otherwise("none")
    return f.select("user_id", "replicate", F.exists("facts", lambda x: (x["severity"] == "critical") & absent(x)).alias("critical_absent"), F.forall("facts", lambda x: ~absent(x)).alias("none_absent"), cause.alias("cause"), F.size("facts").alias("n_facts"))


@query("""WITH c AS (SELECT doc_id, replace(replace(lower(text), 'the ', 'a '), 'of ', 'a ') AS t, length(text) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, n, list_filter(['apache', 'license', '@', 'http', 'token'], lambda x: contains(t, x)) AS cats FROM c)
SELECT doc_id, array_to_string(list_sort(cats), '+') AS categories, CAST(len(cats) AS INTEGER) AS n_categories, n BETWEEN 300 AND 2500 AS valid_length FROM f""")
def category_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories found as substrings after surface variants are rewritten, and a length check."""
    t = F.lower("text")
    for a, b in (("the ", "a "), ("of ", "a ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    kinds = F.array(*map(F.lit, ("apache", "license", "@", "http", "token")))
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.alias("t"), F.length("text").alias("n"))
    cats = F.array_sort(F.filter(kinds, lambda k: F.contains(F.col("t"), k)))
    return d.select("doc_id", F.array_join(cats, "+").alias("categories"), F.size(cats).alias("n_categories"), F.col("n").between(300, 2500).alias("valid_length"))


@query(f"""WITH {NEWEST_SQL}, l AS (SELECT user_id, event_type, max(score) FILTER (replicate = 1) AS first_score, max(score) FILTER (replicate = 2) AS second_score FROM j GROUP BY ALL)
SELECT CASE WHEN first_score IS NULL THEN 'new' WHEN first_score <= 7 THEN 'flagged' ELSE 'clear' END AS fate_1, CASE WHEN second_score IS NULL THEN 'gone' WHEN second_score <= 7 THEN 'flagged' ELSE 'clear' END AS fate_2, count(*) AS n FROM l GROUP BY ALL""")
def fate_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How notes fared in one run and the next."""
    j = now(spark, sf_dir)
    a = j.where("replicate = 1").select("user_id", "event_type", F.col("score").alias("a"))
    b = j.where("replicate = 2").select("user_id", "event_type", F.col("score").alias("b"))
    every = j.select("user_id", "event_type").distinct().join(a, ["user_id", "event_type"], "left").join(b, ["user_id", "event_type"], "left")
    one = F.when(F.col("a").isNull(), "new").when(F.col("a") <= 7, "flagged").otherwise("clear")
    two = F.when(F.col("b").isNull(), "gone").when(F.col("b") <= 7, "flagged").otherwise("clear")
    return every.groupBy(one.alias("fate_1"), two.alias("fate_2")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), f AS (SELECT conv_id, turn, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS anchor FROM n) SELECT conv_id, turn, anchor FROM f""")
def section_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn at or before each turn: an as-of lookup by a running maximum."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("anchor"))


@query(f"""{N}, a AS (SELECT user_id, CASE WHEN count(*) FILTER (parse_failure) = 0 THEN min(score) END AS own FROM j GROUP BY user_id), g AS (SELECT stratum, min(score) AS fallback FROM j GROUP BY stratum) SELECT user_id, user_id % 4 AS stratum, coalesce(own, fallback) AS score, CASE WHEN own IS NOT NULL THEN 'own' ELSE 'stratum' END AS via FROM a JOIN g ON g.stratum = a.user_id % 4""")
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consultation's own lowest score where all its replies were read, else its stratum's."""
    j = now(spark, sf_dir)
    own = j.groupBy("user_id").agg(F.when(F.count_if("parse_failure") == 0, F.min("score")).alias("own")).withColumn("stratum", F.col("user_id") % 4)
    rest = j.groupBy("stratum").agg(F.min("score").alias("_f"))
    return own.join(rest, "stratum").select("user_id", "stratum", F.coalesce("own", "_f").alias("score"), F.when(F.col("own").isNotNull(), "own").otherwise("stratum").alias("via"))


@query("""WITH s AS (SELECT conv_id, turn, text, 0 AS rank FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, text, 1 FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, text, 2 FROM conversations) SELECT conv_id, turn, md5(text) AS digest, rank AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank) AS n FROM s) WHERE n = 1""")
def first_source_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaykit.operators.records import first_source

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    merged = first_source([c.where("role = 'assistant'").drop("role"), c.where("turn % 2 = 0").drop("role"), c.drop("role")], ["conv_id", "turn"])
    return merged.select("conv_id", "turn", "digest", "source_rank")


FLAT_LINES = r"list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0b]+', ' ', 'g'), ' '))"
UNITS = r"list_filter(flatten(list_transform(" + FLAT_LINES + r", lambda x: CASE WHEN ends_with(x, ':') THEN [x] ELSE string_split(regexp_replace(x, '([.!?]) ([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)) END)), lambda x: x <> '')"
NUMBERED_SQL = r"'^(\s*)(\d{1,9})([.)]\s)'"
LISTED_SQL = r"'1. ' || note || chr(10) || '2. ' || replace(note, '. ', '.  ') || chr(10) || '3. end , here'"


@query(rf"""WITH {TALK_SQL}, n AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN {LISTED_SQL} ELSE note END AS note, conv_id % 3 AS kind FROM t WHERE note IS NOT NULL),
u AS (SELECT *, CASE kind WHEN 0 THEN CASE conv_id % 2 WHEN 0 THEN '3. end' ELSE 'end' END WHEN 1 THEN ({UNITS.format(t="note")})[-1] ELSE ' and ' END AS span FROM n),
p AS (SELECT *, '(?i)' || array_to_string(list_transform(list_filter(string_split_regex(span, '\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\s+') AS rx FROM u),
f AS (SELECT *, len(regexp_extract_all(note, rx)) AS matches, regexp_extract(note, rx) AS hit FROM p),
g AS (SELECT *, CASE WHEN matches = 1 THEN instr(note, hit) - 1 END AS start, CASE WHEN matches = 1 THEN instr(note, hit) - 1 + length(hit) END AS stop FROM f),
h AS (SELECT *, substr(note, 1, start) AS l, substr(note, stop + 1) AS r FROM g),
i AS (SELECT *, string_split(l, chr(10))[-1] AS lh, string_split(r, chr(10))[1] AS rh FROM h),
j AS (SELECT *, CASE WHEN trim(lh || rh, ' ') = '' THEN substr(l, 1, length(l) - length(lh)) || substr(r, length(rh) + 2) WHEN ends_with(l, ' ') AND regexp_matches(r, '^[ .,;]') THEN rtrim(l, ' ') || r ELSE l || r END AS rest FROM i),
k AS (SELECT *, regexp_replace(rest, '^\s+|\s+$', '', 'g') AS cut, list_transform(list_filter(string_split(note, chr(10)), lambda x: regexp_matches(x, {NUMBERED_SQL})), lambda x: CAST(regexp_extract(x, {NUMBERED_SQL}, 2) AS INT)) AS nums FROM j),
m AS (SELECT *, string_split(cut, chr(10)) AS ls FROM k)
SELECT conv_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(matches AS INTEGER) AS matches, md5(CASE WHEN start IS NULL THEN NULL WHEN len(nums) > 0 AND nums = range(1, len(nums) + 1) THEN array_to_string(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, {NUMBERED_SQL}) THEN regexp_extract(x, {NUMBERED_SQL}, 1) || len(list_filter(ls[1:i], lambda y: regexp_matches(y, {NUMBERED_SQL}))) || regexp_extract(x, {NUMBERED_SQL}, 3) || regexp_replace(x, {NUMBERED_SQL}, '') ELSE x END), chr(10)) ELSE cut END) AS rest FROM m""")
def span_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without a span, whatever its white space: an item of a list or its end, the last sentence, and a word that may stand there often."""
    note, kind = F.col("note"), F.col("conv_id") % 3
    listed = F.concat(F.lit("1. "), note, F.lit("\n2. "), F.replace(note, F.lit(". "), F.lit(".  ")), F.lit("\n3. end , here"))
    t = talks(spark, sf_dir).where("note is not null").select("conv_id", F.when(kind == 0, listed).otherwise(note).alias("note"))
    span = F.when(kind == 0, F.when(F.col("conv_id") % 2 == 0, "3. end").otherwise("end")).when(kind == 1, F.element_at(text.units(note), -1)).otherwise(" and ")
    t = t.withColumn("f", edits.find_span(note, span))
    places = F.array(F.struct(F.col("f.start").alias("start"), F.col("f.stop").alias("stop")))
    return t.select("conv_id", "f.*", F.md5(F.when(F.col("f.matches") == 1, edits.without_spans(note, places))).alias("rest"))


@query(rf"""WITH {TALK_SQL}, n AS (SELECT conv_id, note, {UNITS.format(t="note")} AS u FROM t WHERE note IS NOT NULL),
s AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN u[-1] WHEN 1 THEN array_to_string(u[1:2], '   ') WHEN 2 THEN substr(u[1], 1, length(u[1]) // 2) WHEN 3 THEN 'zzqq nowhere' ELSE 'the' END AS span FROM n),
p AS (SELECT *, '(?i)' || array_to_string(list_transform(list_filter(string_split_regex(span, '\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\s+') AS rx FROM s),
f AS (SELECT *, len(regexp_extract_all(note, rx)) AS matches, regexp_extract(note, rx) AS hit FROM p),
h AS (SELECT *, lower(trim(regexp_replace(hit, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')) AS target, list_transform(u, lambda x: lower(x)) AS lu FROM f),
k AS (SELECT *, CASE WHEN matches = 1 THEN list_filter(range(0, len(u)), lambda i: contains(target, lu[i + 1])) ELSE [] END AS held FROM h)
SELECT conv_id, CAST(matches AS INTEGER) AS matches, CASE WHEN len(held) > 0 THEN held[-1] - held[1] + 1 = len(held) AND array_to_string(lu[held[1] + 1:held[-1] + 1], ' ') = target ELSE false END AS aligned, array_to_string(held, ' ') AS units FROM k""")
def span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a place in a note is one or more whole units: the last one, two with other white space, half of one, nothing, a frequent word."""
    u, kind = text.units(F.col("note")), F.col("conv_id") % 5
    first = F.element_at(u, 1)
    span = F.when(kind == 0, F.element_at(u, -1)).when(kind == 1, F.array_join(F.slice(u, 1, 2), "   ")).when(kind == 2, F.substr(first, F.lit(1), F.floor(F.length(first) / 2).cast("int"))).when(kind == 3, "zzqq nowhere").otherwise("the")
    t = talks(spark, sf_dir).where("note is not null").select("conv_id", "note", edits.find_span(F.col("note"), span).alias("f"))
    t = t.select("conv_id", "f.matches", edits.unit_alignment(F.col("note"), F.col("f.start"), F.col("f.stop")).alias("a"))
    return t.select("conv_id", "matches", "a.aligned", F.array_join(F.col("a.units").cast("array<string>"), " ").alias("units"))


@query(rf"""WITH {TALK_SQL}, n AS (SELECT conv_id, note, {UNITS.format(t="note")} AS u, ['add', 'omit', 'change'][conv_id % 3 + 1] AS kind, conv_id // 3 % 6 AS how FROM t WHERE note IS NOT NULL),
e AS (SELECT *, CASE how WHEN 0 THEN list_concat(u, ['Quite new zq1.', 'And zq2 more.']) WHEN 1 THEN u[1:len(u) - 1] WHEN 2 THEN list_concat([regexp_replace(u[1], '^[^ ]+', 'Zq3')], u[2:]) WHEN 3 THEN u WHEN 4 THEN list_concat(['Zq4 first.'], u[2:len(u)], ['Zq5 last.']) ELSE list_concat(u, list_transform(range(0, 9), lambda i: 'Zq' || i || ' more.')) END AS v FROM n),
f AS (SELECT *, coalesce(list_max(list_filter(range(0, least(len(u), len(v)) + 1), lambda k: u[1:k] = v[1:k])), 0) AS head FROM e),
g AS (SELECT *, coalesce(list_max(list_filter(range(0, least(len(u), len(v)) - head + 1), lambda k: u[len(u) - k + 1:] = v[len(v) - k + 1:])), 0) AS tail FROM f),
h AS (SELECT *, u[head + 1:len(u) - tail] AS a, v[head + 1:len(v) - tail] AS b FROM g),
i AS (SELECT *, len(a) + len(b) > 0 AND len(list_intersect(a, b)) = 0 AS one, string_split(array_to_string(a, ' '), ' ') AS wa, string_split(array_to_string(b, ' '), ' ') AS wb FROM h),
j AS (SELECT *, CASE WHEN one THEN CASE WHEN len(a) = 0 THEN 'insert' WHEN len(b) = 0 THEN 'delete' ELSE 'replace' END END AS tag, coalesce(list_max(list_filter(range(0, least(len(wa), len(wb)) + 1), lambda k: wa[1:k] = wb[1:k])), 0) AS wh FROM i),
k AS (SELECT *, coalesce(list_max(list_filter(range(0, least(len(wa), len(wb)) - wh + 1), lambda k: wa[len(wa) - k + 1:] = wb[len(wb) - k + 1:])), 0) AS wt FROM j),
l AS (SELECT *, CASE WHEN tag = 'replace' THEN len(wa) + len(wb) - 2 * (wh + wt) END AS changed, CASE WHEN one THEN len(a) END AS units_out, CASE WHEN one THEN len(b) END AS units_in FROM k)
SELECT conv_id, kind, one, tag, CAST(units_out AS INTEGER) AS units_out, CAST(units_in AS INTEGER) AS units_in, CAST(changed AS INTEGER) AS changed_words,
  coalesce((kind = 'add' AND tag = 'insert' AND units_in <= 2) OR (kind = 'omit' AND tag = 'delete' AND units_out <= 2) OR (kind = 'change' AND tag = 'replace' AND units_out <= 2 AND units_in <= 2 AND changed <= 30), false) AS accepted_first,
  coalesce((kind = 'add' AND tag = 'insert' AND units_in <= 6) OR (kind = 'omit' AND tag = 'delete' AND units_out <= 6) OR (tag = 'replace' AND units_out <= 3 AND units_in <= 3 AND changed <= 30), false) AS accepted_second FROM l""")
def edit_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edits both rules take: units added, dropped, one with another word, none, two places, and too many added; each of every kind."""
    u, how = text.units(F.col("note")), F.floor(F.col("conv_id") / 3) % 6
    kind = F.element_at(F.array(*map(F.lit, ("add", "omit", "change"))), (F.col("conv_id") % 3 + 1).cast("int"))
    rest, many = F.slice(F.col("u"), 2, F.greatest(F.size("u") - 1, F.lit(0))), [F.lit(f"Zq{i} more.") for i in range(9)]
    made = (
        F.when(how == 0, F.concat("u", F.array(F.lit("Quite new zq1."), F.lit("And zq2 more."))))
        .when(how == 1, F.slice("u", 1, F.greatest(F.size("u") - 1, F.lit(0))))
        .when(how == 2, F.concat(F.array(F.regexp_replace(F.element_at("u", 1), "^[^ ]+", "Zq3")), rest))
        .when(how == 3, F.col("u"))
        .when(how == 4, F.concat(F.array(F.lit("Zq4 first.")), rest, F.array(F.lit("Zq5 last."))))
        .otherwise(F.concat("u", F.array(*many)))
    )
    t = talks(spark, sf_dir).where("note is not null").select("conv_id", "note", u.alias("u"), kind.alias("kind")).where("size(u) > 0")
    t = t.select("conv_id", "note", "kind", F.array_join(made, "\n").alias("edited"))
    out = edits.edit_acceptance(t, "note", "edited", "kind")
    return out.select("conv_id", "kind", (F.col("n_blocks") == 1).alias("one"), "tag", "units_out", "units_in", "changed_words", "accepted_first", "accepted_second")


STOPPED = ", ".join(f"'{w}'" for w in edits.LITTLE)
TOLD = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z'']+'), lambda w: length(w) > 2 AND w NOT IN (" + STOPPED + ")))"


@query(rf"""WITH {TALK_SQL}, n AS (SELECT conv_id, transcript, {TOLD.format(x="note")} AS w FROM t WHERE note IS NOT NULL), l AS (SELECT conv_id, w, unnest(string_split_regex(transcript, '\r\n|\r|\n')) AS line, generate_subscripts(string_split_regex(transcript, '\r\n|\r|\n'), 1) - 1 AS i FROM n),
c AS (SELECT conv_id, i, line, len(list_intersect(w, {TOLD.format(x="line")})) AS share FROM l), m AS (SELECT *, arg_min(i, {{'s': -share, 'i': i}}) OVER (PARTITION BY conv_id) AS mid FROM c),
d AS (SELECT *, min(share) OVER (PARTITION BY conv_id, sign(i - mid) ORDER BY abs(i - mid)) AS least FROM m),
s AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY CAST(i <> mid AS INT), least DESC, sign(i - mid), abs(i - mid) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < 400 AS held FROM d),
g AS (SELECT conv_id, min(i) FILTER (held) AS first, max(i) FILTER (held) AS last, max(i) AS stop, string_agg(line, chr(10) ORDER BY i) FILTER (held) AS body FROM s GROUP BY conv_id)
SELECT conv_id, first, last, CASE WHEN first > 0 THEN '[...]' || chr(10) ELSE '' END || regexp_replace(body, '^\s+|\s+$', '', 'g') || CASE WHEN last < stop THEN chr(10) || '[...]' ELSE '' END AS excerpt FROM g""")
def best_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each transcript that say most of what its note says."""
    return edits.excerpts(talks(spark, sf_dir).where("note is not null"), "conv_id", "transcript", "note", 400)


@query()
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("l")))), lambda s: s["l"])
    return notes.speaker_turns(turns.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("script")), "conv_id", "script")


@query(f"""WITH {TALK_SQL}, e AS (SELECT conv_id, note, replace(note, 'the ', 'our ') AS edited FROM t WHERE note IS NOT NULL), w AS (SELECT *, list_filter(string_split(regexp_replace(lower(note), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS a, list_filter(string_split(regexp_replace(lower(edited), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS b FROM e)
SELECT conv_id, concat_ws('; ', CASE WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 THEN 'new words' END, CASE WHEN contains(edited, 'and ') THEN 'removed span still there' END, CASE WHEN NOT contains(edited, 'the ') THEN 'kept span gone' END, CASE WHEN note = edited THEN 'nothing changed' END) AS problems FROM w""")
def edit_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanical checks of an edit that puts one word for another."""
    t = talks(spark, sf_dir).where("note is not null").withColumn("edited", F.replace("note", F.lit("the "), F.lit("our ")))
    found = notes.edit_checks(F.col("note"), F.col("edited"), F.array(F.lit("and ")), F.array(F.lit("the ")))
    return t.select("conv_id", F.array_join(found, "; ").alias("problems"))


@query()
def grid_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten facts for each cell of error type and severity, few of one consultation, those that are built already first."""
    j = now(spark, sf_dir).where("role = 'errored'")
    supply = j.select("pair_type", "severity", F.concat_ws("|", F.col("user_id").cast("string"), "severity").alias("fact"), (F.col("user_id") % 40).alias("consultation"), (F.col("user_id") % 7 == 0).alias("built"))
    return notes.allocate(supply, "pair_type", "severity", "fact", "consultation", "built", 10, salt="grid")
