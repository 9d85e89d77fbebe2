"""Queries of the numbered operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm import alignment, ann, audit, bpe, htmltext, jaccardjoin, langid, lmscore, maxscore, packing, records, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Whether a document is kept from learning."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those that are not held out and have one. A null doc_id has a null held_out and is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product found for each vec_id divisible by 20."""
    return ann.search_tree(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)[0]


#: Labelled ids that are broadcast at most; beyond it they meet the documents by a shuffle.
FEW = 2_000_000


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document under models of good and of all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id", F.lit(True).alias("target")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sides = docs.join(F.broadcast(good) if good.count() <= FEW else good, "doc_id", "left")
    return lmscore.differences(sides, "target")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; fingerprints link at four or fewer differing bits."""
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, and its number of code points."""
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products for each vec_id divisible by 100."""
    return maxscore.search_exact(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and whether it is 0.7 or more; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' tokens read back from record files, with where each starts and a checksum."""
    read = records.token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast(T.ArrayType(T.StringType()))), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by language."""
    labels = table(spark, sf_dir, "labels")
    return audit.audit(table(spark, sf_dir, "documents"), labels, good_lost=F.col("quality") == 1, toxic_lost=F.col("toxic") == 1)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 in 100 of their four-word shingles."""
    return jaccardjoin.jaccard_groups(table(spark, sf_dir, "documents"), words=4, share=85)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of a byte-level and a sentencepiece vocabulary in every text."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


OP12 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM words
), nodes AS (
  SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT node, n, unnest(s) AS g FROM nodes
), common AS (
  SELECT a.node AS u, b.node AS v, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node
), links AS (
  SELECT u, v FROM common WHERE 100 * c >= 85 * (m + n - c) UNION ALL SELECT v, u FROM common WHERE 100 * c >= 85 * (m + n - c)
), reach AS (
  WITH RECURSIVE r(node, label) AS (SELECT node, node FROM nodes UNION SELECT links.v, r.label FROM r JOIN links ON links.u = r.node) SELECT node, min(label) AS label FROM r GROUP BY node
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(reach.label, sets.doc_id) AS component_id
FROM sets LEFT JOIN nodes ON sets.s = nodes.s LEFT JOIN reach ON reach.node = nodes.node
"""

OP11 = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT doc_id, part,
    CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM words
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), counters AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counters, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_ann_search, op3_lm_score, op4_simhash_groups, op5_html_extract, op6_maxscore_topk, op7_toxicity, op8_pack_sequences, op9_token_records, op10_bpe_codec, op11_filter_audit, op12_jaccard_join, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op6_maxscore_topk": OP6, "op11_filter_audit": OP11, "op12_jaccard_join": OP12}
