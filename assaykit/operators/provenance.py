"""Provenance: manifests, prompt drift, guards on published numbers, complete arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, problem): one row for each rule that a row breaks; a rule that can't be decided counts as broken."""
    found = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(*key, F.explode(found).alias("problem"))


def drift(recorded: DataFrame, present: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, state): changed, untracked or missing prompts; unchanged ones are left out."""
    a, b = recorded.select(name, F.col(digest).alias("_a")), present.select(name, F.col(digest).alias("_b"))
    state = F.when(F.col("_a").isNull(), "untracked").when(F.col("_b").isNull(), "missing").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, name, "full").select(name, state.alias("state")).where("state is not null")


def guards(expected: DataFrame, measured: DataFrame, name: str, tolerance: str) -> DataFrame:
    """(name, expected, measured, ok): published values beside measured ones; an absent measurement is not ok."""
    joined = expected.select(name, F.col("value").alias("expected"), tolerance).join(measured.select(name, F.col("value").alias("measured")), name, "left")
    return joined.select(name, "expected", "measured", F.coalesce(F.abs(F.col("expected") - F.col("measured")) <= F.col(tolerance), F.lit(False)).alias("ok"))


def complete_arms(df: DataFrame, arm: list[str], replicate: str, item: str, expected: int) -> DataFrame:
    """(arm, replicates, complete): replicates of an arm that hold every item exactly once, and whether at least three do."""
    per = df.groupBy(*arm, replicate).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(item).alias("_d"))
    whole = (F.col("_n") == expected) & (F.col("_d") == expected)
    return per.groupBy(*arm).agg(F.count_if(whole).alias("replicates")).withColumn("complete", F.col("replicates") >= 3)
