"""Releases behind gates: what is left out and why is counted in the pass that writes, and nothing is published if a gate fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class GateError(ValueError):
    """A release that was not written: the gates that failed, with the counts."""

    def __init__(self, failed: list[str], counts: dict[str, int]):
        super().__init__(f"gates failed: {', '.join(failed)}")
        self.failed, self.counts = failed, counts


def with_cause(df: DataFrame, causes: dict[str, Column], out: str = "cause") -> DataFrame:
    """df with the first cause whose condition holds; null for rows that stay. A condition that is null doesn't hold."""
    cause = F.lit(None).cast("string")
    for name, holds in reversed(causes.items()):
        cause = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(cause)
    return df.withColumn(out, cause)


def cause_report(df: DataFrame, causes: dict[str, dict[str, Column]]) -> DataFrame:
    """(version, cause, n, all_failing): rows that each version of the rules leaves out, by their first cause, and rows that fail that
    cause at all; cause ``kept`` for rows that stay. One pass over df for all versions, causes without rows included."""
    sums, rows = [], []
    for v, (version, conditions) in enumerate(causes.items()):
        before = F.lit(False)
        for i, (cause, holds) in enumerate(conditions.items()):
            holds = F.coalesce(holds, F.lit(False))
            sums += [F.count_if(holds & ~before).alias(f"n{v}_{i}"), F.count_if(holds).alias(f"a{v}_{i}")]
            rows.append(F.struct(F.lit(version).alias("version"), F.lit(cause).alias("cause"), F.col(f"n{v}_{i}").alias("n"), F.col(f"a{v}_{i}").alias("all_failing")))
            before = before | holds
        sums.append(F.count_if(~before).alias(f"k{v}"))
        rows.append(F.struct(F.lit(version).alias("version"), F.lit("kept").alias("cause"), F.col(f"k{v}").alias("n"), F.lit(0).cast("long").alias("all_failing")))
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def release(df: DataFrame, causes: dict[str, Column], gates: dict[str, Callable[[dict[str, int]], bool]], folder: str) -> dict[str, int]:
    """Writes the rows that no cause leaves out to ``folder``, if all gates hold for the counts, and returns these.

    The counts (``read``, ``kept`` and each cause) are observed while the rows are written beside the folder; only then is it put
    in its place. If a gate fails or the write does, what was written goes and ``folder`` is as before; an existing one is an error.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, aside = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(f"{folder}.unchecked")
    store = target.getFileSystem(conf)
    if store.exists(target):
        raise FileExistsError(folder)
    seen = Observation("release")
    marked = with_cause(df, causes, "_cause")
    numbers = [F.count(F.lit(1)).alias("read"), F.count_if(F.col("_cause").isNull()).alias("kept"), *(F.count_if(F.col("_cause") == c).alias(c) for c in causes)]
    try:
        marked.observe(seen, *numbers).where("_cause is null").drop("_cause").write.mode("overwrite").parquet(aside.toString())
        counts = {k: int(v or 0) for k, v in seen.get.items()}
        failed = [name for name, holds in gates.items() if not holds(counts)]
        if failed:
            raise GateError(failed, counts)
        if not store.rename(aside, target):
            raise OSError(f"{folder} could not be put in its place")
    finally:
        if store.exists(aside):
            store.delete(aside, True)
    return counts
