"""Text as column expressions: parsers of replies, normal forms, shingles, segments."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """What the last match of a pattern captured; null without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def score(text: Column, top: int = 10) -> Column:
    """The last ``Score: n`` of a reply, if 0 to ``top``."""
    n = last_match(text, r"(?i)score:\s*(\d{1,4})").cast("int")
    return F.when(n.between(0, top), n)


def verdict(text: Column, allowed: str = "PASS|FAIL") -> Column:
    """The last ``Verdict: X`` of a reply, in capitals."""
    return F.upper(last_match(text, rf"(?i)verdict:\s*({allowed})\b"))


def json_blob(text: Column) -> Column:
    """The outermost braces or brackets of a reply (greedy), if they hold sound JSON."""
    blob = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when((blob != "") & F.try_parse_json(blob).isNotNull(), blob)


def json_score(text: Column, top: int = 10) -> Column:
    """``score`` of the JSON reply; a line ``Score: n`` counts only where there is no JSON. A bad JSON score is null."""
    blob = json_blob(text)
    n = F.get_json_object(blob, "$.score").try_cast("int")
    return F.when(blob.isNotNull(), F.when(n.between(0, top), n)).otherwise(score(text, top))


def agreed_boolean(text: Column, field: str) -> Column:
    """A field's boolean where broken JSON repeats it, if every occurrence agrees."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf'(?i)"{field}"\s*:\s*(true|false)'), 1), F.lower))
    return F.when(F.size(found) == 1, F.element_at(found, 1) == "true")


def flat(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " ")))


def assertion_key(text: Column) -> Column:
    """Only a-z, 0-9 and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), " +", " "))


def words(text: Column) -> Column:
    """Lower-case words of letters a-z and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def shingles(text: Column, n: int = 8) -> Column:
    """Distinct word n-grams; a shorter text is one shingle; none without words."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    # bound to a lambda's variable, so that the words are found once and not again for each shingle
    return F.element_at(F.transform(F.array(words(text)), of), 1)


def numbered_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentence, body): lines ``n ...`` start a sentence, other lines go on with it; lines before the first are dropped."""
    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_i", "_line"))
    starts = F.col("_line").rlike(r"^\s*\d+\s")
    group = F.sum(starts.cast("int")).over(Window.partitionBy(key).orderBy("_i"))
    body = lines.withColumn("sentence", group).where("sentence > 0").groupBy(key, "sentence").agg(F.array_sort(F.collect_list(F.struct("_i", "_line"))).alias("_l"))
    return body.select(key, F.col("sentence").cast("long").alias("sentence"), F.array_join(F.transform("_l", lambda s: F.trim(s["_line"])), " ").alias("body"))


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, tf, idf, weight) with idf = ln(n / (1 + df)) + 1."""
    n = df.groupBy().agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    tf = df.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    seen = tf.groupBy("word").agg(F.count(F.lit(1)).alias("_df")).withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")  # one row
    idf = seen.select("word", (F.log(F.col("_n") / (1 + F.col("_df"))) + 1).alias("idf"))
    return tf.join(idf, "word").select(key, "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


#: Hashes that are broadcast at most.
FEW = 2_000_000


def having(rows: DataFrame, others: DataFrame, hash: str) -> DataFrame:
    """The rows whose hash the others have, or all rows where the others have too many hashes to broadcast."""
    known = others.select(hash).distinct()
    return rows.join(F.broadcast(known), hash, "left_semi") if known.count() <= FEW else rows


def containment(left: DataFrame, right: DataFrame, lkey: str, rkey: str, text: str, n: int = 8) -> DataFrame:
    """(lkey, rkey, shared, n_left, n_right, jaccard) for texts of both sides that share a word n-gram.

    ``right`` is the smaller side. Shingles of ``left`` whose hash it lacks go before the shuffle, as long as its hashes are at most
    ``FEW``; what is left meets by hash and text in an equi join, which adaptive execution splits where many rows of both
    sides share a shingle. Counts are formed before the last shuffle.
    """

    def exploded(df: DataFrame, key: str, size: str) -> DataFrame:
        s = df.select(F.col(key), shingles(F.col(text), n).alias("_s"))
        return s.select(key, F.size("_s").alias(size), F.explode("_s").alias("_g")).withColumn("_h", F.xxhash64("_g"))

    a, b = exploded(left, lkey, "n_left"), exploded(right, rkey, "n_right")
    out = having(a, b, "_h").join(b, ["_h", "_g"]).groupBy(lkey, rkey, "n_left", "n_right").agg(F.count(F.lit(1)).alias("shared"))
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared")))


def probes(text: Column, width: int = 120) -> Column:
    """Slices of a text from its start, middle and end."""
    n = F.length(text)
    mid = F.greatest(F.lit(1), F.floor((n - width) / 2).cast("int") + 1)
    return F.array(F.substring(text, 1, width), F.substr(text, mid, F.lit(width)), F.substr(text, F.greatest(F.lit(1), n - width + 1), F.lit(width)))


def leaks(text: Column, other: Column, width: int = 120) -> Column:
    """Whether any probe of a text (longer than a probe) stands in another."""
    return (F.length(text) >= width) & F.exists(probes(text, width), lambda p: F.contains(other, p))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Normal form C, which built-in functions can't give."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def units(text: Column) -> Column:
    """Lines with single blanks; a line that ends in a colon is one unit, others are cut after sentences."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0b]+", " ")))
    parts = F.transform(lines, lambda x: F.when(F.endswith(x, F.lit(":")), F.array(x)).otherwise(F.split(x, r"(?<=[.!?]) (?=[A-Z0-9(])", -1)))
    return F.filter(F.flatten(parts), lambda u: u != "")


def keyed_seed(key: Column) -> Column:
    """A seed below 2**31 - 1 from the first eight hex digits of a key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % (2**31 - 1)
