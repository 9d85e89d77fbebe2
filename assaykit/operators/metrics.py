"""Discrimination, thresholds and curves. Scores are pre-aggregated before any window runs over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_adjusted(errored: Column, clean: Column) -> Column:
    """1 if the errored note scores lower, one half for a tie, else 0."""
    return F.when(errored < clean, 1.0).when(errored == clean, 0.5).otherwise(0.0)


def paired(twins: DataFrame, groups: list[str]) -> DataFrame:
    """Pairs, wins, ties and tie-adjusted discrimination per group."""
    e, c = F.col("score"), F.col("clean_score")
    out = twins.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(e < c).alias("wins"), F.count_if(e == c).alias("ties"))
    return out.withColumn("paired", (2 * F.col("wins") + F.col("ties")) / (2 * F.col("n")))


def paired_with_failures(twins: DataFrame, groups: list[str], failures: str) -> DataFrame:
    """``paired`` where pairs of which a reply could not be read count as a ``tie`` or a ``loss``, or are left ``out``."""
    if failures not in ("tie", "loss", "out"):
        raise ValueError("failures must be tie, loss or out")
    bad = F.col("parse_failure") | F.col("clean_failure")
    e, c = F.col("score"), F.col("clean_score")
    rows = twins.where(~bad) if failures == "out" else twins
    ties = ~bad & (e == c) | (bad if failures == "tie" else F.lit(False))
    out = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(~bad & (e < c)).alias("wins"), F.count_if(ties).alias("ties"))
    return out.withColumn("paired", (2 * F.col("wins") + F.col("ties")) / (2 * F.col("n")))


def paired_over_replicates(twins: DataFrame, groups: list[str], replicate: str = "replicate") -> DataFrame:
    """Mean over replicates of each replicate's discrimination."""
    return paired(twins, [*groups, replicate]).groupBy(*groups).agg(F.count(F.lit(1)).alias("replicates"), F.sum("n").alias("n"), F.avg("paired").alias("paired"))


def paired_by_pair(twins: DataFrame, groups: list[str], pair: list[str]) -> DataFrame:
    """Mean over pairs of each pair's mean over its replicates."""
    each = twins.groupBy(*groups, *pair).agg(F.avg(tie_adjusted(F.col("score"), F.col("clean_score"))).alias("_p"))
    return each.groupBy(*groups).agg(F.count(F.lit(1)).alias("pairs"), F.avg("_p").alias("paired"))


def strict(twins: DataFrame, groups: list[str]) -> DataFrame:
    """Strict discrimination, in which a failed reply discriminates nothing, and the mean gap of what was read."""
    failed = F.col("parse_failure") | F.col("clean_failure")
    gap = F.col("clean_score") - F.col("score")
    out = twins.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"), F.count_if(~failed & (gap > 0)).alias("strict_wins"), F.sum(F.when(~failed, gap)).alias("_gap"))
    return out.select(*groups, "n", "failed", "strict_wins", (F.col("strict_wins") / F.col("n")).alias("strict"), (F.col("_gap") / F.nullif(F.col("n") - F.col("failed"), F.lit(0))).alias("mean_gap"))


def score_counts(df: DataFrame, groups: list[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives at each score: all that AUC and sweeps need."""
    return df.where(F.col(score).isNotNull()).groupBy(*groups, F.col(score).alias("s")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def auc(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Area under the curve where lower scores are positive and ties count half."""
    above = F.coalesce(F.sum("neg").over(Window.partitionBy(*groups).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counts.withColumn("_won", 2 * F.col("pos") * above + F.col("pos") * F.col("neg"))
    out = each.groupBy(*groups).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("_won").alias("_won"))
    return out.select(*groups, "n_pos", "n_neg", (F.col("_won") / F.nullif(2 * F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def sweep(counts: DataFrame, groups: list[str], rule: str = "strict") -> DataFrame:
    """(groups, threshold, side, det, fa and their counts) at every threshold.

    rule: ``strict`` flags s < t at observed scores and one past the largest; ``both`` takes t at each score and just above it;
    ``inclusive`` flags s <= t at observed scores.
    """
    w = Window.partitionBy(*groups)
    up = w.orderBy("s")
    total = counts.withColumn("_pos", F.sum("pos").over(w)).withColumn("_neg", F.sum("neg").over(w)).withColumn("_hit", F.sum("pos").over(up)).withColumn("_false", F.sum("neg").over(up)).withColumn("_last", F.lead("s").over(up).isNull())
    at = F.struct(F.col("s").cast("double").alias("threshold"), F.lit("at").alias("side"), (F.col("_hit") - F.col("pos")).alias("hits"), (F.col("_false") - F.col("neg")).alias("false_alarms"))
    past = F.struct((F.col("s") + 1).cast("double").alias("threshold"), F.lit("past").alias("side"), F.col("_hit").alias("hits"), F.col("_false").alias("false_alarms"))
    above = F.struct(F.col("s").cast("double").alias("threshold"), F.lit("above").alias("side"), F.col("_hit").alias("hits"), F.col("_false").alias("false_alarms"))
    points = {"strict": F.when(F.col("_last"), F.array(at, past)).otherwise(F.array(at)), "both": F.array(at, above), "inclusive": F.array(above)}[rule]
    out = total.select(*groups, "_pos", "_neg", F.explode(points).alias("p")).select(*groups, "p.*", "_pos", "_neg")
    det, fa = F.col("hits") / F.nullif(F.col("_pos"), F.lit(0)), F.col("false_alarms") / F.nullif(F.col("_neg"), F.lit(0))
    return out.select(*groups, "threshold", "side", "hits", "false_alarms", F.col("_pos").alias("n_pos"), F.col("_neg").alias("n_neg"), det.alias("det"), fa.alias("fa"))


def best_at(curve: DataFrame, groups: list[str], cap: float, prefer: str = "detection") -> DataFrame:
    """The point of each curve with the best detection among those with false alarms at most ``cap``.

    prefer: of equal detection ``detection`` takes fewer false alarms, then the higher threshold; ``first`` the lowest
    threshold; ``largest`` takes the largest feasible threshold whatever it detects, and minus infinity, which flags nothing, for
    curves without one.
    """
    if prefer == "largest":
        point = ["threshold", "side", "hits", "false_alarms", "det", "fa"]
        best = F.max(F.when(F.col("fa") <= cap + 1e-12, F.struct(*point)))
        zero = F.lit(0).cast("long")
        none = F.struct(F.lit(float("-inf")).alias("threshold"), F.lit("below").alias("side"), zero.alias("hits"), zero.alias("false_alarms"), F.lit(0.0).alias("det"), F.lit(0.0).alias("fa"))
        per = curve.where("n_pos > 0 and n_neg > 0").groupBy(*groups, "n_pos", "n_neg").agg(F.coalesce(best, none).alias("_p"))
        return per.select(*groups, *(f"_p.{c}" for c in point[:4]), "n_pos", "n_neg", "_p.det", "_p.fa")
    order = {"detection": [F.desc("det"), F.asc("fa"), F.desc("threshold"), F.desc("side")], "first": [F.desc("det"), F.asc("threshold"), F.asc("side")]}[prefer]
    ranked = curve.where(F.col("fa") <= cap).withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def youden_midpoints(means: DataFrame, groups: list[str], score: str, positive: Column) -> DataFrame:
    """First best Youden J over thresholds halfway between neighbouring mean scores, and half a point outside both ends."""
    counts = score_counts(means, groups, score, positive)
    w = Window.partitionBy(*groups)
    up = w.orderBy("s")
    c = counts.withColumn("_pos", F.sum("pos").over(w)).withColumn("_neg", F.sum("neg").over(w)).withColumn("hits", F.sum("pos").over(up)).withColumn("false_alarms", F.sum("neg").over(up)).withColumn("_next", F.lead("s").over(up)).withColumn("_first", F.lag("s").over(up).isNull())
    after = F.struct(F.when(F.col("_next").isNull(), F.col("s") + 0.5).otherwise((F.col("s") + F.col("_next")) / 2).alias("threshold"), F.col("hits"), F.col("false_alarms"))
    start = F.struct((F.col("s") - 0.5).alias("threshold"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("false_alarms"))
    points = c.select(*groups, "_pos", "_neg", F.explode(F.when(F.col("_first"), F.array(start, after)).otherwise(F.array(after))).alias("p")).select(*groups, "p.*", "_pos", "_neg")
    j = points.withColumn("j", F.col("hits") / F.col("_pos") - F.col("false_alarms") / F.col("_neg"))
    ranked = j.withColumn("_n", F.row_number().over(w.orderBy(F.desc("j"), "threshold")))
    return ranked.where("_n = 1").select(*groups, "threshold", "hits", "false_alarms", "j")
