"""Sections of notes, how residuals lie to what was removed, and judges' figures by that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.operators import sections
from assaykit.operators.bootstrap import bootstrap, draws_sql
from assaykit.plans.judging import pairs
from assaykit.plans.registry import query
from assaykit.sources.tables import TWINS_SQL, read

#: Made-up headers, dealt to turns by number; an empty one is none.
HEADERS = ("History:", "PLAN -", "Past Medical History:", "", "Exam;", "Plan:", "Notes -", "Medications / current:")


def sited_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, note, edited, sites): a conversation's turns as a note with headers, the last assistant turn removed in ``edited``.

    Kept sites are the assistant's other turns; a quote of every fifth turn is spoilt, so that it is not found.
    """
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    head = F.element_at(F.array(*map(F.lit, HEADERS)), ((F.col("conv_id") * 3 + F.col("turn")) % 8 + 1).cast("int"))
    body = F.trim(F.regexp_replace("text", r"[ \t\r\n\f\x0b]+", " "))
    between = F.when(F.col("head") == "", "").when(F.col("turn") % 2 == 0, " ").otherwise("\n")
    t = turns.select("conv_id", "turn", "role", head.alias("head"), F.concat(F.when(F.col("turn") % 3 == 0, "- ").otherwise(""), body).alias("body"))
    t = t.withColumn("chunk", F.concat("head", between, "body")).withColumn("lead", F.length("head") + F.length(between))
    w = Window.partitionBy("conv_id")
    t = t.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w))
    start = F.coalesce(F.sum(F.length("chunk") + 1).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("at", (start + F.col("lead")).cast("int"))
    quote = F.when(F.col("turn") % 5 == 3, F.concat(F.substring("body", 1, 12), F.lit(" zzqq"))).otherwise(F.substring("body", 1, 60))
    strength = F.element_at(F.array(*map(F.lit, sections.STRENGTH)), (F.col("turn") % 3 + 1).cast("int"))
    gone = F.col("turn") == F.col("last")
    site = F.when(F.col("role") == "assistant", F.struct(F.col("turn").alias("site"), gone.alias("removed"), "at", quote.alias("quote"), F.col("head").alias("label"), strength.alias("strength")))
    rows = t.where("last is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("chunk", F.when(gone, F.lit("")).otherwise(F.col("chunk")).alias("left")).alias("c")))).alias("c"), F.array_sort(F.collect_list(site)).alias("sites"))
    return rows.select("conv_id", F.array_join(F.transform("c", lambda x: x["c"]["chunk"]), "\n").alias("note"), F.array_join(F.transform("c", lambda x: x["c"]["left"]), "\n").alias("edited"), "sites")


def canonical_sql(x: str) -> str:
    return rf"CASE WHEN {x} IS NULL OR {x} IN ('', '(none)') THEN '(none)' ELSE lower(regexp_replace(trim(regexp_replace(trim(regexp_replace({x}, '(?s)\s+[-/]\s+.*$', ''), ' '), '[:;.,\-#–— ]+$', ''), ' '), '\s+', ' ', 'g')) END"


def role_sql(x: str) -> str:
    cases = " ".join("WHEN {} IN ({}) THEN '{}'".format(x, ", ".join(f"'{v}'" for v in labels.split(", ")), name) for name, labels in sections.ROLES.items())
    return f"CASE WHEN {x} IS NULL OR {x} = '(none)' THEN 'no_header' {cases} ELSE 'unclassified' END"


SITED_SQL = rf"""tn AS (SELECT conv_id, turn, role, [{", ".join(f"'{h}'" for h in HEADERS)}][(conv_id * 3 + turn) % 8 + 1] AS head, CASE WHEN turn % 3 = 0 THEN '- ' ELSE '' END || trim(regexp_replace(text, '[ \t\r\n\f\x0b]+', ' ', 'g'), ' ') AS body FROM conversations WHERE text IS NOT NULL),
tc AS (SELECT *, head || (CASE WHEN head = '' THEN '' WHEN turn % 2 = 0 THEN ' ' ELSE chr(10) END) || body AS chunk, length(head) + (CASE WHEN head = '' THEN 0 ELSE 1 END) AS lead, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM tn),
tp AS (SELECT *, coalesce(sum(length(chunk) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + lead AS pos FROM tc WHERE last IS NOT NULL),
nt AS (SELECT conv_id, string_agg(chunk, chr(10) ORDER BY turn) AS note, string_agg(CASE WHEN turn = last THEN '' ELSE chunk END, chr(10) ORDER BY turn) AS edited FROM tp GROUP BY conv_id),
st AS (SELECT conv_id, turn AS site, turn = last AS removed, pos, head AS label, trim(CASE WHEN turn % 5 = 3 THEN substr(body, 1, 12) || ' zzqq' ELSE substr(body, 1, 60) END, ' ') AS q, CASE turn % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'paraphrase' ELSE 'partial' END AS strength FROM tp WHERE role = 'assistant'),
ky AS (SELECT DISTINCT conv_id, {canonical_sql("label")} AS key FROM st),
ln AS (SELECT conv_id, side, line, sum(length(line) + 1) OVER (PARTITION BY conv_id, side ORDER BY i) - length(line) - 1 AS start FROM (
  SELECT conv_id, 'old' AS side, unnest(string_split(note, chr(10))) AS line, generate_subscripts(string_split(note, chr(10)), 1) AS i FROM nt
  UNION ALL SELECT conv_id, 'new', unnest(string_split(edited, chr(10))), generate_subscripts(string_split(edited, chr(10)), 1) FROM nt)),
an AS (SELECT conv_id, side, key, min(start) AS start FROM ln JOIN ky USING (conv_id) WHERE key NOT IN ('(none)', '') AND starts_with(lower(trim(line, ' ')), key) GROUP BY ALL),
sa AS (SELECT st.*, CASE WHEN removed THEN note ELSE edited END AS body, CASE WHEN removed THEN 'old' ELSE 'new' END AS side,
  CASE WHEN removed THEN pos WHEN q <> '' AND instr(edited, q) > 0 THEN instr(edited, q) - 1 WHEN length(q) > 40 AND instr(edited, substr(q, 1, 40)) > 0 THEN instr(edited, substr(q, 1, 40)) - 1 END AS p FROM st JOIN nt USING (conv_id)),
sb AS (SELECT sa.*, (SELECT arg_max(an.key, {{'s': an.start, 'k': an.key}}) FROM an WHERE an.conv_id = sa.conv_id AND an.side = sa.side AND an.start <= sa.p) AS hit,
  trim(string_split(substr(body, 1, CAST(p AS BIGINT)), chr(10))[-1] || string_split(substr(body, CAST(p AS BIGINT) + 1), chr(10))[1], ' ') AS line FROM sa),
ls AS (SELECT conv_id, site, removed, strength, p IS NOT NULL AS found, CASE WHEN p IS NULL THEN {canonical_sql("label")} ELSE coalesce(hit, '(none)') END AS section,
  CASE WHEN p IS NULL THEN NULL WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^([-*•–]|\d+[.)]|[a-z][.)])\s') OR (len(string_split_regex(line, '\s+')) <= 12 AND NOT regexp_matches(line, '[.!?]$')) OR (contains(line, ':') AND len(string_split_regex(line, '\s+')) <= 14 AND NOT ends_with(line, '.')) THEN 'list' ELSE 'prose' END AS form FROM sb)"""
LOCATED_SQL = SITED_SQL + f""", rk AS (SELECT *, CASE strength WHEN 'explicit' THEN 3 WHEN 'paraphrase' THEN 2 ELSE 1 END AS rank FROM ls),
rs AS (SELECT *, NOT removed AND rank = max(rank) FILTER (NOT removed) OVER (PARTITION BY conv_id) AS strong FROM rk),
rl AS (SELECT conv_id, max(section) FILTER (removed) AS removed_section, coalesce(list_sort(list_distinct(list(section) FILTER (strong))), []) AS sections, count(*) FILTER (strong) AS n_residual, count(*) FILTER (strong AND NOT found) AS n_fallback, bool_or(form = 'list') FILTER (strong) AS has_list, bool_or(form IS NOT NULL) FILTER (strong) AS has_form FROM rs GROUP BY conv_id),
lo AS (SELECT conv_id, removed_section, array_to_string(sections, '|') AS residual_sections, n_residual, n_fallback, CASE WHEN removed_section IS NOT NULL AND n_residual > 0 THEN CASE WHEN list_contains(sections, removed_section) THEN 'same_section' ELSE 'different_section' END END AS location,
  {role_sql("removed_section")} AS removed_role, CASE WHEN n_residual > 0 THEN list_contains(list_transform(sections, lambda s: {role_sql("s")}), 'assessment_plan') END AS residual_in_plan,
  CASE WHEN n_residual > 0 THEN list_contains(list_transform(sections, lambda s: {role_sql("s")}), 'registry_list') END AS residual_in_list, CASE WHEN n_residual > 0 THEN CASE WHEN has_list THEN 'list' WHEN has_form THEN 'prose' END END AS residual_form FROM rl)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.labelled_sites(sited_notes(spark, sf_dir), "conv_id")


@query(f"WITH {SITED_SQL} SELECT conv_id, site, removed, found, section, {role_sql('section')} AS section_role, form FROM ls")
def site_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section, its role and the form of every removed and kept site."""
    return sites(spark, sf_dir).select("conv_id", "site", "removed", "found", "section", sections.role(F.col("section")).alias("section_role"), "form")


@query(f"WITH {LOCATED_SQL} SELECT * FROM lo")
def residual_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is left of a removed turn stands in its section, in a plan or a list."""
    return sections.residual_locations(sites(spark, sf_dir), "conv_id").withColumn("residual_sections", F.array_join("residual_sections", "|"))


JOINED_SQL = f"{TWINS_SQL}, {LOCATED_SQL}, jt AS (SELECT tw.*, coalesce(lo.location, 'unassigned') AS location FROM tw JOIN lo ON lo.conv_id = tw.user_id WHERE pair_type = 'omit')"


def located_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omission judgements of consultations whose note has sites, with its residual's location."""
    place = sections.residual_locations(sites(spark, sf_dir), "conv_id").select(F.col("conv_id").alias("user_id"), F.coalesce("location", F.lit("unassigned")).alias("location"))
    return pairs(spark, sf_dir).where("pair_type = 'omit'").join(place, "user_id")


@query(f"""WITH {JOINED_SQL}, v AS (SELECT *, CASE WHEN parse_failure OR clean_failure THEN 0.0 WHEN score < clean_score THEN 1.0 WHEN score = clean_score THEN 0.5 ELSE 0.0 END AS v, CAST(flagged AS INT) AS f FROM jt),
rn AS (SELECT location, replicate, avg(v) AS v, avg(f) AS f FROM v GROUP BY ALL), pr AS (SELECT location, avg(v) AS paired_mean, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(v) END, 0.0) AS paired_sd, string_agg(printf('%.4f', round(v, 4)), ' ' ORDER BY replicate) AS per_run, avg(f) AS flag_mean FROM rn GROUP BY location),
ea AS (SELECT location, user_id, event_type, sum(f) AS k, count(*) AS n FROM v GROUP BY ALL), mj AS (SELECT location, count(*) AS n_pairs, count(DISTINCT user_id) AS n_consultations, count(*) FILTER (k * 2 > n) AS majority_k FROM ea GROUP BY location)
SELECT location, n_pairs, n_consultations, round(paired_mean, 9) AS paired_mean, round(paired_sd, 9) AS paired_sd, per_run, round(flag_mean, 9) AS flag_mean, majority_k, round(majority_k / CAST(n_pairs AS DOUBLE), 9) AS majority_rate,
  round(greatest(0, (p + z / (2 * n_pairs) - sqrt(z) * sqrt(p * (1 - p) / n_pairs + z / (4.0 * n_pairs * n_pairs))) / (1 + z / n_pairs)), 9) AS low, round(least(1, (p + z / (2 * n_pairs) + sqrt(z) * sqrt(p * (1 - p) / n_pairs + z / (4.0 * n_pairs * n_pairs))) / (1 + z / n_pairs)), 9) AS high
FROM (SELECT *, majority_k / CAST(n_pairs AS DOUBLE) AS p, 1.959963984540054 * 1.959963984540054 AS z FROM mj JOIN pr USING (location))""")
def residual_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrimination and flags of omissions by their residual's location."""
    out = sections.cell_statistics(located_twins(spark, sf_dir), "location", ["user_id", "event_type"], "user_id")
    return out.withColumns({c: F.round(c, 9) for c in ("paired_mean", "paired_sd", "flag_mean", "majority_rate", "low", "high")})


@query(f"""WITH {JOINED_SQL}, pm AS (SELECT user_id, event_type, avg(CASE WHEN parse_failure OR clean_failure THEN 0.0 WHEN score < clean_score THEN 1.0 WHEN score = clean_score THEN 0.5 ELSE 0.0 END) AS v FROM jt WHERE location = 'same_section' GROUP BY ALL),
{draws_sql("SELECT user_id AS c, sum(v) AS num, count(*) AS den FROM pm GROUP BY user_id")}""")
def residual_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over pairs whose residual is in the removed section, with the interval over consultations."""
    value = F.when(F.col("parse_failure") | F.col("clean_failure"), 0.0).when(F.col("score") < F.col("clean_score"), 1.0).when(F.col("score") == F.col("clean_score"), 0.5).otherwise(0.0)
    each = located_twins(spark, sf_dir).where("location = 'same_section'").groupBy("user_id", "event_type").agg(F.avg(value).alias("v"))
    clusters = each.groupBy("user_id").agg(F.sum("v").alias("num"), F.count(F.lit(1)).cast("double").alias("den"))
    return bootstrap(clusters, "user_id", "num", "den").withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high")})
