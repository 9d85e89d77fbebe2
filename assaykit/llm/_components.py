"""Connected components of a table of links, by contraction to local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm._cluster import keep


def label_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node in (u, v): label is the smallest node reachable.

    In each round a node goes to that of itself and its neighbours whose hash is smallest, and on to where that one goes. Links are
    drawn anew between the nodes gone to, so that each round has only what is still apart: a large group costs about its links,
    not its links times the rounds. Hashes keep chains short whatever the ids, so rounds grow with the logarithm of the longest
    path. Minima are formed before the shuffle, joins stand directly on exchanges, so that adaptive execution can split a node
    with very many links, and each round is checkpointed.
    """
    links, ends = keep(edges.select("u", "v").where("u <> v").distinct()), None
    while True:
        both = links.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("near")))
        least = F.min(F.struct(F.xxhash64("near").alias("hash"), "near"))
        low = both.groupBy("node").agg(F.least(least, F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("near")))["near"].alias("to"))
        low = keep(low)
        step = keep(low.join(low.toDF("to", "_on"), "to").select("node", F.col("_on").alias("to")))
        ends = step if ends is None else keep(ends.join(step.toDF("to", "_on"), "to", "left").select("node", F.coalesce("_on", "to").alias("to")))
        apart = links.join(step.toDF("u", "_u"), "u").join(step.toDF("v", "_v"), "v").where("_u <> _v")
        links = keep(apart.select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
        if links.isEmpty():
            names = keep(ends.groupBy("to").agg(F.min("node").alias("label")))
            return ends.join(names, "to").select("node", "label")
