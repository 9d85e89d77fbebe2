"""Append-only logs as streams: the newest record of each key, and running spend.

``dropDuplicates`` within a watermark keeps the first record of a key; here the newest must win, so each micro-batch is merged
into a table of newest records. ``upsert_newest`` keeps that table in buckets of the keys' hashes: a batch rewrites the buckets that its keys
fall into and leaves the others as they are, and a manifest for each batch says which version of each bucket counts. A batch
that is run again after a failure writes the same versions again from its predecessor's manifest, whose files stay until the batch after
it is done. ``merge_newest`` writes the whole table for each batch.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.records import newest


def merge_newest(stream: DataFrame, folder: str, keys: list[str], order: list[Column]) -> int:
    """Runs the stream over all that is there; returns the number of the last version written, -1 without any.

    folder: below it ``version=<batch>`` and the stream's own checkpoint are kept.
    """
    spark = stream.sparkSession
    last = [-1]

    def merge(batch: DataFrame, number: int) -> None:
        state = batch
        if number > 0:
            state = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/version={number - 1}"))
        newest(state, keys, order).write.mode("overwrite").parquet(f"{folder}/version={number}")
        last[0] = number

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return last[0]


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of whatever store holds it; none where it is not there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, int]:
    """The version of each bucket in the newest manifest, or the newest one before a batch; at most one row for each bucket."""
    known = [int(n.split("=")[1]) for n in _listed(spark, f"{folder}/manifest") if n.startswith("batch=")]
    known = [n for n in known if below is None or n < below]
    if not known:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/manifest/batch={max(known)}").collect()}


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _bucket_rows(spark: SparkSession, folder: str, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_newest(stream: DataFrame, folder: str, keys: list[str], order: list[Column], buckets: int = 64) -> int:
    """Runs the stream over all that is there; returns the number of the last batch, -1 without any.

    ``order`` must be total, so that late and repeated records change nothing. ``buckets`` belongs to the folder: it can't change later.
    """
    spark, last = stream.sparkSession, [-1]

    def merge(batch: DataFrame, number: int) -> None:
        current = _versions(spark, folder, number)
        batch = batch.persist()
        touched = [r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect()]  # at most ``buckets``
        if touched:
            before = _bucket_rows(spark, folder, batch.schema, {b: v for b, v in current.items() if b in set(touched)})
            state = newest(batch.unionByName(before), keys, order).withColumn("bucket", _bucket(keys, buckets))
            state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/version={number}")
        batch.unpersist()
        now = current | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")
        wanted = {(v, b) for m in (current, now) for b, v in m.items()}
        for version in _listed(spark, f"{folder}/data"):
            own = [n for n in _listed(spark, f"{folder}/data/{version}") if n.startswith("bucket=")]
            stale = [n for n in own if (int(version.split("=")[1]), int(n.split("=")[1])) not in wanted]
            for n in stale if len(stale) < len(own) else []:
                _deleted(spark, f"{folder}/data/{version}/{n}")
            if len(stale) == len(own):
                _deleted(spark, f"{folder}/data/{version}")
        for n in _listed(spark, f"{folder}/manifest"):
            if n.startswith("batch=") and int(n.split("=")[1]) < number - 1:
                _deleted(spark, f"{folder}/manifest/{n}")
        last[0] = number

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return last[0]


def newest_state(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The records that ``upsert_newest`` keeps in a folder; none before its first batch."""
    return _bucket_rows(spark, folder, schema, _versions(spark, folder))


def running_total(stream: DataFrame, key: str, amount: str) -> DataFrame:
    """Streaming sum per key, to be written in complete or update mode."""
    return stream.groupBy(key).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names for checkpoints; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="assaykit-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
