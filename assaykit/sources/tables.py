"""The driver's tables, and judgement records made from its event log.

An event is one judgement of a note: the user is the consultation, the event type says which note was judged (``view`` is the
clean one, the others are altered in some way), and the value gives the score. The rules are in FIXTURES.md, section 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each event type stands for.
ORDINAL = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
PAIR_TYPE = {"click": "omit", "error": "omit", "purchase": "add", "signup": "change"}
RESIDUAL = {"click": "complete", "error": "partial-weak"}
SEVERITY = ("critical", "supporting", "peripheral")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: Column, values: dict) -> Column:
    """The value for each key of a small fixed mapping; null for other keys."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def judgements(events: DataFrame) -> DataFrame:
    """One row for each event: (event_id, t, user_id, stratum, event_type, role, pair_type, level, severity, replicate, k, score, parse_failure, flagged)."""
    kind = F.col("event_type")
    ordinal = mapped(kind, ORDINAL)
    k = F.get_json_object("props", "$.k").cast("long")
    score = F.least(F.lit(10), F.floor(F.col("value") / 10)).cast("int")
    return events.select(
        "event_id",
        F.col("ts").alias("t"),
        "user_id",
        (F.col("user_id") % 4).alias("stratum"),
        "event_type",
        F.when(kind == "view", "clean").otherwise("errored").alias("role"),
        mapped(kind, PAIR_TYPE).alias("pair_type"),
        mapped(kind, RESIDUAL).alias("level"),
        F.element_at(F.array(*map(F.lit, SEVERITY)), ((F.col("user_id") + ordinal) % 3 + 1).cast("int")).alias("severity"),
        (F.col("event_id") % 3 + 1).alias("replicate"),
        k.alias("k"),
        score.alias("score"),
        (k % 20 == 0).alias("parse_failure"),
        (score <= 7).alias("flagged"),
    )


#: The same rows for DuckDB.
JUDGEMENTS_SQL = """raw AS (
  SELECT event_id, ts AS t, user_id, user_id % 4 AS stratum, event_type,
    CASE WHEN event_type = 'view' THEN 'clean' ELSE 'errored' END AS role,
    CASE event_type WHEN 'click' THEN 'omit' WHEN 'error' THEN 'omit' WHEN 'purchase' THEN 'add' WHEN 'signup' THEN 'change' END AS pair_type,
    CASE event_type WHEN 'click' THEN 'complete' WHEN 'error' THEN 'partial-weak' END AS level,
    CASE (user_id + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END) % 3
      WHEN 0 THEN 'critical' WHEN 1 THEN 'supporting' WHEN 2 THEN 'peripheral' END AS severity,
    event_id % 3 + 1 AS replicate,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(least(10, floor(value / 10)) AS INTEGER) AS score,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 = 0 AS parse_failure,
    CAST(least(10, floor(value / 10)) AS INTEGER) <= 7 AS flagged
  FROM events
)"""
#: Current judgements, and errored ones beside their own clean twins.
NEWEST_SQL = JUDGEMENTS_SQL + """, j AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type, replicate ORDER BY t DESC, event_id DESC) AS n FROM raw
  ) WHERE n = 1
)"""
TWINS_SQL = NEWEST_SQL + """, tw AS (
  SELECT e.*, c.score AS clean_score, c.parse_failure AS clean_failure, c.flagged AS clean_flagged
  FROM j e JOIN j c ON c.role = 'clean' AND e.role = 'errored' AND c.user_id = e.user_id AND c.replicate = e.replicate
)"""
