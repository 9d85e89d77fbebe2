"""Loaders over files that are first written from the driver's tables, in the forms in which releases arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.plans.registry import query
from assaykit.plans.texts import TALK_SQL, talks
from assaykit.sources import files
from assaykit.sources.tables import read
from assaykit.streaming.latest import work_folder

TURN = T.StructType([T.StructField("conv_id", T.LongType(), False), T.StructField("turn", T.LongType(), False), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one JSON list, by conversation bare or in one of two wrappers."""
    turns = read(spark, sf_dir, "conversations")
    listed = turns.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct(*TURN.names))).alias("body"))
    kind = F.col("conv_id") % 3
    return listed.select(F.when(kind == 0, F.col("body")).when(kind == 1, F.concat(F.lit('{"pairs": '), "body", F.lit("}"))).otherwise(F.concat(F.lit('{"version": 2, "items": '), "body", F.lit("}"))).alias("value"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of JSON documents in three forms."""
    folder = work_folder(spark, "json")
    _items(spark, sf_dir).write.text(folder)
    return files.documents_in(spark.read.text(folder), TURN)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 7 <> 0")
def json_lines_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of compressed logs; blank and torn ones are left out."""
    folder = work_folder(spark, "lines")
    line = F.to_json(F.struct(*TURN.names))
    torn = F.when(F.col("conv_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    read(spark, sf_dir, "conversations").select(F.explode(F.array(torn, F.lit("  "))).alias("value")).write.text(folder, compression="gzip")
    return files.json_lines(spark, folder, TURN)[0]


@query("SELECT count(*) FILTER (conv_id % 7 <> 0) AS whole, count(*) FILTER (conv_id % 7 = 0) AS torn FROM conversations")
def json_lines_torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a log were whole, and how many torn."""
    folder = work_folder(spark, "torn")
    line = F.to_json(F.struct(*TURN.names))
    read(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line).alias("value")).write.text(folder)
    rows, torn = files.json_lines(spark, folder, TURN)
    both = rows.select(F.lit(True).alias("ok")).unionByName(torn.select(F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("whole"), F.count_if(~F.col("ok")).alias("torn"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def csv_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with fields of several lines, from folders by role."""
    folder = work_folder(spark, "csv")
    rows = read(spark, sf_dir, "conversations").select(*TURN.names, F.col("role").alias("part"))
    rows.write.partitionBy("part").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return files.csv_release(spark, folder, TURN, "*.csv")


@query(f"WITH {TALK_SQL} SELECT 'talk' AS source, CAST(conv_id AS VARCHAR) AS id, md5(transcript) AS digest FROM t WHERE conv_id % 4 <> 0")
def text_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts whose names say source and id; variants are left out."""
    kind = F.when(F.col("conv_id") % 4 == 0, "__short").otherwise("")
    named = talks(spark, sf_dir).select(F.concat(F.lit("talk__"), F.col("conv_id").cast("string"), kind).alias("name"), F.col("transcript").alias("value"))
    folder = work_folder(spark, "texts")
    named.repartition("name").write.partitionBy("name").option("lineSep", "\n").text(folder)  # a file for each name
    return files.named_folders(spark, folder).select("source", "id", F.md5("text").alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, coalesce(lang, 'none') AS value FROM documents UNION ALL SELECT 'id', 'lang'")
def report_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two cells of the table rows of a report."""
    folder = work_folder(spark, "report")
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), F.coalesce("lang", F.lit("none")), F.lit(" | x |")).alias("value"))
    head = spark.createDataFrame([("# Documents",), ("| id | lang | source |",), ("|---|---|---|",)], "value string")
    head.coalesce(1).union(docs).write.text(folder)
    return files.report_rows(spark, folder).select("name", "value")


@query("""WITH a AS (SELECT event_id % 997 AS item, CASE event_id % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE '?' END AS answer, event_id FROM events), n AS (SELECT item, count(*) AS n FROM a WHERE event_id % 10 <> 0 GROUP BY item)
SELECT CASE WHEN event_id % 10 <> 0 THEN item END AS item, CASE WHEN event_id % 10 <> 0 THEN answer END AS answer, CASE WHEN event_id % 10 = 0 THEN 'unreadable' WHEN n > 1 THEN 'answered twice' END AS problem, count(*) AS n FROM a LEFT JOIN n USING (item) GROUP BY ALL""")
def answer_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers read from sheets; lines of another form and items answered twice are problems."""
    folder = work_folder(spark, "sheets")
    item, word = (F.col("event_id") % 997).cast("string"), F.element_at(F.array(*map(F.lit, "Yn?")), (F.col("event_id") % 3 + 1).cast("int"))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(item, F.lit(" maybe"))).otherwise(F.concat(item, F.element_at(F.array(*map(F.lit, (". ", ") ", ": "))), (F.col("event_id") % 3 + 1).cast("int")), word, F.lit(" noted")))
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    found = files.answers(spark.read.text(folder))
    return found.groupBy("item", F.when(F.col("item").isNotNull(), F.col("answer")).alias("answer"), "problem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l.doc_id, l.quality, md5(d.text) AS digest FROM labels l JOIN documents d USING (doc_id)""")
def side_table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled items with the texts that a side table holds for them."""
    side = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return read(spark, sf_dir, "labels").join(side, "doc_id").select("doc_id", "quality", "digest")
