"""Loaders: JSON in several wrappers, JSON lines with torn ends, CSV with large fields, text files keyed by name, reports.

Each takes an explicit schema; rows that don't fit come back as problems and are not guessed at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def json_documents(spark: SparkSession, path: str, item: T.StructType, wrappers: tuple[str, ...] = ("pairs", "items")) -> DataFrame:
    """Items of JSON files that are an array of items, an object with such an array under one of ``wrappers``, or one item."""
    return documents_in(spark.read.text(path, wholetext=True), item, wrappers)


def documents_in(raw: DataFrame, item: T.StructType, wrappers: tuple[str, ...] = ("pairs", "items")) -> DataFrame:
    """The same for JSON documents in a column ``value``, such as one document a line."""
    many = T.ArrayType(item)
    tries = [F.from_json(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")), many)]
    tries += [F.from_json(F.get_json_object("value", f"$.{w}"), many) for w in wrappers]
    single = F.from_json("value", item)
    required = [f.name for f in item.fields if not f.nullable]
    lone = F.when(F.forall(F.array(*(single[n].cast("string") for n in required)), lambda x: x.isNotNull()) if required else single.isNotNull(), F.array(single))
    return raw.select(F.explode(F.coalesce(*tries, lone)).alias("_i")).select("_i.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, torn lines) of JSON-lines files, compressed or not; blank lines are neither."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("_r"))
    broken = F.col("_r").isNull() | F.col(f"_r.{BAD}").isNotNull()
    return parsed.where(~broken).select("_r.*").drop(BAD), parsed.where(broken).select("value")


def csv_release(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """CSV with a header and quoted fields of any length and several lines, from a folder and those below it."""
    reader = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, recursiveFileLookup=True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path)


def named_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, id, text) of files ``<source>__<id>.txt``; names with a third part are variants and left out."""
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.txt$", "").alias("_n"))
    return named(files.withColumn("_n", F.url_decode("_n")), "_n", "value")


def named_folders(spark: SparkSession, path: str) -> DataFrame:
    """(source, id, text) of text files in folders ``name=<source>__<id>``; the line end that a writer puts last is no text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.url_decode(F.regexp_extract("_metadata.file_path", r"/name=([^/]*)/[^/]*$", 1))
    return named(files.select(name.alias("_n"), F.regexp_replace("value", r"\n\z", "").alias("value")), "_n", "value")


def named(df: DataFrame, name: str, text: str) -> DataFrame:
    """(source, id, text) of rows named ``<source>__<id>``; names with more or fewer parts are left out."""
    parts = F.split(name, "__")
    return df.where(F.size(parts) == 2).select(parts[0].alias("source"), parts[1].alias("id"), F.col(text).alias("text"))


def report_rows(spark: SparkSession, path: str, pattern: str = r"(?m)^\|\s*([^|\n]+?)\s*\|\s*([^|\n]+?)\s*\|") -> DataFrame:
    """(file, place, name, value): the first two cells of each table line of markdown reports; rules and empty cells are left out."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    both = text.select("file", F.posexplode(F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), 1).alias("name"), F.regexp_extract_all("value", F.lit(pattern), 2).alias("value"))).alias("place", "c"))
    return both.select("file", "place", "c.name", "c.value").where(~F.col("name").rlike(r"^:?-+:?$"))


def answers(lines: DataFrame, column: str = "value", pattern: str = r"^\s*(\d+)\s*[.:)]\s*([YyNn?])\s*(.*)$") -> DataFrame:
    """(item, answer, note, problem) of answer-sheet lines; an item answered twice, or a line of another form, is a problem."""
    item = F.regexp_extract(column, pattern, 1)
    found = lines.where(F.trim(column) != "").select(F.when(item != "", item.cast("long")).alias("item"), F.upper(F.regexp_extract(column, pattern, 2)).alias("answer"), F.regexp_extract(column, pattern, 3).alias("note"))
    n = found.where("item is not null").groupBy(F.col("item").alias("_item")).agg(F.count(F.lit(1)).alias("_n"))
    joined = found.join(n, F.col("item") == F.col("_item"), "left")
    return joined.select("item", F.when(F.col("item").isNotNull(), F.col("answer")).alias("answer"), "note", F.when(F.col("item").isNull(), "unreadable").when(F.col("_n") > 1, "answered twice").alias("problem"))


def long_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and measure, for tab-separated output."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in rest))).alias("_m")).select(*keys, "_m.measure", "_m.value")


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, place) of every line: (file, block, place) rises in the order of lines in files taken by name.

    A file that is cut into splits has one block for each, by where it starts; place counts on within a task, which reads its
    splits from start to end.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("place", F.monotonically_increasing_id())


def last_lines(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last sound JSON line of each key in file order; torn and blank lines are passed over."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = lines_in_order(spark, path).where(F.trim("value") != "")
    rows = rows.withColumn("_r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    sound = rows.where(F.col("_r").isNotNull() & F.col(f"_r.{BAD}").isNull()).select("_r.*", F.struct("file", "block", "place").alias("_at")).drop(BAD)
    rest = [f.name for f in schema.fields if f.name not in keys]
    last = sound.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_l"))
    return last.select(*keys, "_l.*").select(*(f.name for f in schema.fields))


def newest_release(spark: SparkSession, path: str, schema: str, pattern: str = r"/(\d+(?:\.\d+)*)/") -> DataFrame:
    """Rows of the CSV files below ``path`` whose folder has the highest version; numbers count as numbers, a longer version after its beginning."""
    files = spark.read.options(header=True, multiLine=True, quote='"', escape='"', recursiveFileLookup=True).schema(schema).csv(path)
    version = F.transform(F.split(F.regexp_extract(F.substring_index("_metadata.file_path", path.rstrip("/").rsplit("/", 1)[-1], -1), pattern, 1), r"\."), lambda x: x.try_cast("long"))
    names = [f.name for f in files.schema.fields]
    rows = files.select(*names, version.alias("_v"))
    last = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    top = last.select(F.max(F.transform(F.split(F.regexp_extract(F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1], -1), pattern, 1), r"\."), lambda x: x.try_cast("long"))).alias("_top"))
    return rows.join(F.broadcast(top), F.col("_v") == F.col("_top")).select(*names)
