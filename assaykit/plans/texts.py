"""Replies, notes and documents as text: parsing, normal forms, overlap, TF-IDF, leakage, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.functions import text
from assaykit.plans.registry import query
from assaykit.sources.tables import judgements, read

REPLIES_SQL = """r AS (SELECT event_id, CAST(least(10, floor(value / 10)) AS INTEGER) AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
p AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 'Score: 3 at first, then Score: ' || score || '. Verdict: pass. Verdict: ' || CASE WHEN score > 7 THEN 'PASS' ELSE 'FAIL' END
  WHEN 1 THEN 'Here: {"score": ' || score || ', "ok": true} done' WHEN 2 THEN '{"score": ' || score || ', "ok": true, "ok": true' WHEN 3 THEN '{"score": 99, "ok": false} Score: ' || score ELSE 'no reading "ok": true "ok": false' END AS reply FROM r)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up replies with a judgement's score: lines, JSON, cut JSON, out of range, unreadable."""
    score, kind = F.col("score").cast("string"), F.col("k") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("Score: 3 at first, then Score: "), score, F.lit(". Verdict: pass. Verdict: "), F.when(F.col("score") > 7, "PASS").otherwise("FAIL")))
        .when(kind == 1, F.concat(F.lit('Here: {"score": '), score, F.lit(', "ok": true} done')))
        .when(kind == 2, F.concat(F.lit('{"score": '), score, F.lit(', "ok": true, "ok": true')))
        .when(kind == 3, F.concat(F.lit('{"score": 99, "ok": false} Score: '), score))
        .otherwise('no reading "ok": true "ok": false')
    )
    return judgements(read(spark, sf_dir, "events")).select("event_id", reply.alias("reply"))


BLOB = r"regexp_extract(reply, '(?s)(\{.*\}|\[.*\])', 1)"


@query(f"""WITH {REPLIES_SQL}, m AS (SELECT event_id, reply, regexp_extract_all(reply, '(?i)score:\\s*(\\d{{1,4}})', 1) AS s, regexp_extract_all(reply, '(?i)verdict:\\s*(PASS|FAIL)\\b', 1) AS v,
  regexp_extract_all(reply, '(?i)"ok"\\s*:\\s*(true|false)', 1) AS o, CASE WHEN {BLOB} <> '' AND json_valid({BLOB}) THEN {BLOB} END AS blob FROM p),
n AS (SELECT *, CASE WHEN len(s) > 0 AND CAST(s[-1] AS INT) BETWEEN 0 AND 10 THEN CAST(s[-1] AS INT) END AS line, TRY_CAST(json_extract_string(blob, '$.score') AS INT) AS js FROM m)
SELECT event_id, line AS score, upper(CASE WHEN len(v) > 0 THEN v[-1] END) AS verdict, blob, CASE WHEN blob IS NOT NULL THEN CASE WHEN js BETWEEN 0 AND 10 THEN js END ELSE line END AS json_score, CASE WHEN len(list_distinct(o)) = 1 THEN lower(o[1]) = 'true' END AS ok FROM n""")
def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reply")
    return replies(spark, sf_dir).select("event_id", text.score(r).alias("score"), text.verdict(r).alias("verdict"), text.json_blob(r).alias("blob"), text.json_score(r).alias("json_score"), text.agreed_boolean(r, "ok").alias("ok"))


@query(r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' '))) AS flat, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' ')) AS assertion FROM documents""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.flat(t)).alias("flat"), F.md5(text.assertion_key(t)).alias("assertion"))


WORDS = "list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {n} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) END"


@query(f"""WITH d AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, {SHINGLES.format(n=8)} AS s FROM d), bs AS (SELECT item_id, {SHINGLES.format(n=8)} AS s FROM b),
dx AS (SELECT doc_id, CAST(len(s) AS INTEGER) AS n_left, unnest(s) AS g FROM ds), bx AS (SELECT item_id, CAST(len(s) AS INTEGER) AS n_right, unnest(s) AS g FROM bs)
SELECT doc_id, item_id, n_left, n_right, count(*) AS shared, CAST(count(*) AS DOUBLE) / (n_left + n_right - count(*)) AS jaccard FROM dx JOIN bx USING (g) GROUP BY doc_id, item_id, n_left, n_right""")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.containment(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")


@query(f"""WITH d AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
dx AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM (SELECT doc_id, {SHINGLES.format(n=8)} AS s FROM d)), bx AS (SELECT item_id, unnest(s) AS g, len(s) AS m FROM (SELECT item_id, {SHINGLES.format(n=8)} AS s FROM b)),
o AS (SELECT doc_id, item_id, CAST(count(*) AS DOUBLE) / least(any_value(n), any_value(m)) AS containment FROM dx JOIN bx USING (g) GROUP BY ALL)
SELECT doc_id, item_id, containment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, item_id) AS r FROM o) WHERE r = 1 AND containment > 0.5""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item that a document holds most of, above one half."""
    o = text.containment(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")
    share = o.select("doc_id", "item_id", (F.col("shared") / F.least("n_left", "n_right")).alias("containment"))
    ranked = share.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("containment"), "item_id")))
    return ranked.where("_r = 1 AND containment > 0.5").drop("_r")


@query(f"""WITH t AS (SELECT item_id, unnest({WORDS.format(t="text")}) AS word FROM benchmark WHERE text IS NOT NULL), f AS (SELECT item_id, word, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT word, ln(CAST(any_value(n) AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM f, n GROUP BY word)
SELECT item_id, word, tf, round(idf, 9) AS idf, round(tf * idf, 8) AS weight FROM f JOIN d USING (word)""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tfidf(read(spark, sf_dir, "benchmark"), "item_id", "text").withColumns({"idf": F.round("idf", 9), "weight": F.round("weight", 8)})


TALK_SQL = "t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript, max_by(text, turn) FILTER (role = 'assistant') AS note FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns in order, and its last assistant turn as the note."""
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return turns.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("transcript"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("note"))


@query(f"""WITH {TALK_SQL}, n AS (SELECT *, length(note) AS n FROM t WHERE note IS NOT NULL) SELECT conv_id, n >= 120 AND (contains(transcript, substr(note, 1, 120)) OR contains(transcript, substr(note, greatest(1, CAST(floor((n - 120) / 2) AS BIGINT) + 1), 120)) OR contains(transcript, substr(note, greatest(1, n - 119), 120))) AS leaks FROM n""")
def leakage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).where("note is not null").select("conv_id", text.leaks(F.col("note"), F.col("transcript")).alias("leaks"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(nfc_normalize(text), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0b]+', ' ', 'g'), ' ')) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, list_filter(flatten(list_transform(l, lambda x: CASE WHEN ends_with(x, ':') THEN [x] ELSE string_split(regexp_replace(x, '([.!?]) ([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)) END)), lambda x: x <> '') AS u FROM l) SELECT doc_id, CAST(len(u) AS BIGINT) AS n_units, md5(array_to_string(u, '|')) AS digest FROM u""")
def unit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = text.units(text.composed(F.col("text")))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(u).cast("long").alias("n_units"), F.md5(F.array_join(u, "|")).alias("digest"))


@query("""WITH t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN turn || ' ' || text ELSE text END, chr(10) ORDER BY turn) AS body FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM t), g AS (SELECT *, sum(CAST(regexp_matches(line, '^\\s*\\d+\\s') AS INT)) OVER (PARTITION BY conv_id ORDER BY i) AS sentence FROM l)
SELECT conv_id, CAST(sentence AS BIGINT) AS sentence, md5(string_agg(trim(line, ' '), ' ' ORDER BY i)) AS body FROM g WHERE sentence > 0 GROUP BY ALL""")
def numbered_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text is not null").withColumn("_t", F.when(F.col("role") == "user", F.concat_ws(" ", F.col("turn").cast("string"), "text")).otherwise(F.col("text")))
    joined = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_t"))), lambda s: s["_t"]), "\n").alias("body"))
    return text.numbered_sentences(joined, "conv_id", "body").withColumn("body", F.md5("body"))


@query("""SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 2147483647 AS seed FROM documents""")
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring(F.sha2("text", 256), 1, 16).alias("short"), text.keyed_seed(F.col("doc_id").cast("string")).alias("seed"))


@query("""WITH h AS (SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, digest, copies FROM h""")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each distinct text."""
    return read(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"""WITH {TALK_SQL}, a AS (SELECT conv_id, unnest({WORDS.format(t="note")}) AS w FROM t WHERE note IS NOT NULL), b AS (SELECT conv_id, unnest({WORDS.format(t="left(transcript, length(transcript) // 2)")}) AS w FROM t WHERE note IS NOT NULL),
x AS (SELECT conv_id, w, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT conv_id, w, count(*) AS m FROM b GROUP BY ALL)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS words, CAST(sum(greatest(0, n - coalesce(m, 0))) AS BIGINT) AS new_words FROM x LEFT JOIN y USING (conv_id, w) GROUP BY conv_id""")
def new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference: words of the note beyond those of the first half of its transcript."""
    t = talks(spark, sf_dir).where("note is not null")
    x = t.select("conv_id", F.explode(text.words(F.col("note"))).alias("w")).groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("n"))
    y = t.select("conv_id", F.explode(text.words(F.substr("transcript", F.lit(1), F.floor(F.length("transcript") / 2).cast("int")))).alias("w")).groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("m"))
    return x.join(y, ["conv_id", "w"], "left").groupBy("conv_id").agg(F.sum("n").alias("words"), F.sum(F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0)))).alias("new_words"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CASE WHEN regexp_matches(url, '/(fr|de|es)/') THEN regexp_extract(url, '/(fr|de|es)/', 1) WHEN contains(url, '/en/') THEN 'en' ELSE 'unmapped' END AS family, replace('page {id} of {host}', '{id}', CAST(page_id AS VARCHAR)) AS rendered FROM pages""")
def placement_and_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered placement rules, first match wins; a template's slot filled literally."""
    url = F.col("url")
    family = F.when(url.rlike("/(fr|de|es)/"), F.regexp_extract(url, "/(fr|de|es)/", 1)).when(F.contains(url, F.lit("/en/")), "en").otherwise("unmapped")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host"), family.alias("family"), F.replace(F.lit("page {id} of {host}"), F.lit("{id}"), F.col("page_id").cast("string")).alias("rendered"))
