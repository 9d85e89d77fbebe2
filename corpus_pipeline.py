"""A corpus pipeline: language ID, toxicity, near-duplicates, packing, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import langid, nearcopies, packing, toxicity
from assaykit.llm._text import unused

#: SQL can express none of the four stages: naive Bayes, a learned lexicon, softly decoded Golay keys with components, and subset sums.
ORACLE_SQL = None

#: A document stays if its language is known and likelier than all others together.
LEAST_SURE = 0.5
#: A document goes if it is toxic with at least this probability.
TOXIC = 0.7


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is a guess. Learns from the documents that have ``lang``."""
    lang, score = unused(docs, "lang_found"), unused(docs, "lang_score")
    judged = langid.predict(docs, langid.fit(docs), lang=lang, score=score)
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SURE)).drop(lang, score)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents. Learns from ``labels`` on the documents at hand."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "toxic_score")
    return toxicity.attach(docs, lexicon, out=score).where(F.col(score) < TOXIC).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return nearcopies.drop_near_copies(docs, words=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", known_language), ("toxicity", not_toxic), ("SimHash near-dedup", one_of_each), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
