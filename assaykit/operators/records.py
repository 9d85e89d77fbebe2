"""Records: supersession, twin joins, first-source merges, anti-joins and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.rounds import kept


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (which should be total)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def current(judgements: DataFrame) -> DataFrame:
    """The newest judgement per note and replicate; equal times go to the later record."""
    return newest(judgements, ["user_id", "event_type", "replicate"], [F.desc("t"), F.desc("event_id")])


def superseded(judgements: DataFrame, keys: list[str], store: str) -> DataFrame:
    """Records read, kept and dropped per store."""
    per = judgements.groupBy(store, *keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(store).agg(F.sum("_n").alias("n_read"), F.count(F.lit(1)).alias("n_kept"), (F.sum("_n") - F.count(F.lit(1))).alias("n_dropped"))


def twins(judgements: DataFrame, by: tuple[str, ...] = ("user_id", "replicate")) -> DataFrame:
    """Errored judgements with the score of their own clean twin; those without a twin are dropped."""
    clean = judgements.where(F.col("role") == "clean").select(*by, F.col("score").alias("clean_score"), F.col("parse_failure").alias("clean_failure"), F.col("flagged").alias("clean_flagged"))
    return judgements.where(F.col("role") == "errored").join(clean, list(by))


def last_clean(judgements: DataFrame) -> DataFrame:
    """One clean judgement per consultation and replicate: the last inserted."""
    clean = judgements.where(F.col("role") == "clean")
    return newest(clean, ["stratum", "user_id", "replicate"], [F.desc("event_id")])


def first_source(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in which the first source that has a key gives its row."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    union = ranked[0]
    for f in ranked[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    return newest(union, keys, [F.asc("source_rank")])


def allowed(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on the list. Names on the list that df lacks are found by ``missing``."""
    return df.join(names.select(key).distinct(), key, "left_semi")


def missing(names: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return names.select(key).distinct().join(df, key, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drift(drawn: DataFrame, scored: DataFrame, key: str, verdict: str) -> DataFrame:
    """Problems between what was drawn and what was scored: undrawn, unscored, or another verdict."""
    a, b = drawn.select(key, F.col(verdict).alias("_drawn"), F.lit(1).alias("_a")), scored.select(key, F.col(verdict).alias("_scored"), F.lit(1).alias("_b"))
    problem = F.when(F.col("_a").isNull(), "undrawn").when(F.col("_b").isNull(), "unscored").when(~F.col("_drawn").eqNullSafe(F.col("_scored")), "drift")
    return a.join(b, key, "full").withColumn("problem", problem).where("problem is not null").select(key, "problem")


def by_content(ours: DataFrame, theirs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ours whose content hash theirs lacks."""

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))

    return hashed(ours).join(hashed(theirs).select("_hash").distinct(), "_hash", "left_anti").drop("_hash")


def hashed_then_unique(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """left with ``value`` found by the exact key, else by the loose key where that names one row alone; ``via`` says how."""
    sure = newest(right, exact, [F.asc(value)]).select(*exact, F.col(value).alias("_sure"))
    lone = right.groupBy(*loose).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lone")).where("_n = 1").drop("_n")
    joined = left.join(sure, exact, "left").join(lone, loose, "left")
    return joined.withColumn(value, F.coalesce("_sure", "_lone")).withColumn("via", F.when(F.col("_sure").isNotNull(), "key").when(F.col("_lone").isNotNull(), "count")).drop("_sure", "_lone")


def coinciding(df: DataFrame, keys: list[str], vendor: str, least: int = 2) -> DataFrame:
    """Keys that at least so many vendors share, with the vendors in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(vendor)).alias("vendors")).where(F.size("vendors") >= least)


def any_by_cluster(df: DataFrame, cluster: str, arm: str, hit: Column, arms: tuple[str, str]) -> DataFrame:
    """2x2 table of clusters in which either arm has any hit; clusters that both arms saw."""
    a, b = (F.max(F.when(F.col(arm) == x, hit)) for x in arms)
    per = df.groupBy(cluster).agg(a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null")
    return per.agg(*(F.count_if((F.col("_a") == x) & (F.col("_b") == y)).alias(n) for n, x, y in (("both", True, True), ("first_only", True, False), ("second_only", False, True), ("neither", False, False))))


def outstanding(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is planned and not yet stored."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def depths(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth): how far each key is below its outermost ancestor, in rounds that double the distance looked up.

    A key whose parent is null, itself or not there is a root. Keys on or below a ring of parents have no root and are left out.
    """
    every = kept(df.select(F.col(key).alias("id"), F.col(parent).alias("up")).where("id is not null").dropDuplicates(["id"]))
    known = every.select(F.col("id").alias("up"), F.lit(True).alias("_known"))
    up = every.join(known, "up", "left").select("id", F.when(F.col("_known") & (F.col("up") != F.col("id")), F.col("up")).alias("up"))
    up = kept(up.select("id", "up", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("int").alias("depth")))
    total, rounds = up.count(), 0
    while 2**rounds <= total and not up.where("up is not null").isEmpty():
        above = up.toDF("up", "_up", "_root", "_depth")
        up = kept(up.join(above, "up", "left").select("id", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).cast("int").alias("depth")))
        rounds += 1
    return up.where("up is null").select(F.col("id").alias(key), "root", "depth")
