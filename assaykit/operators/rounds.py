"""Work in rounds: results that later rounds stand on are kept in the shared folder, not on executors' own disks."""

from __future__ import annotations

from pyspark.sql import DataFrame



def kept(df: DataFrame) -> DataFrame:
    """df, computed and written once to the folder in spark.checkpoint.dir; its lineage ends there."""
    from assaykit.streaming.latest import work_folder  # which stands on the records that stand on this

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or work_folder(df.sparkSession, "rounds"))
    return df.checkpoint(eager=True)
