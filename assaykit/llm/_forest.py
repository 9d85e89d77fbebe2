"""Links among rows that share a key, handed on as spanning forests: never all pairs of a group, whatever its size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm._cluster import keep

#: Rows of one key that a task compares with each other at once.
BLOCK = 2048
#: Keys with more rows than BLOCK, up to this many, are broadcast; beyond it they are joined by a shuffle.
HOT_KEYS = 100_000
#: Rows that a task compares between two hand-overs.
HELD = 200_000
#: (columns from node on, positions, positions) -> whether the rows at both positions link.
Near = Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each item's component, for links between items 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of_sorted(group: np.ndarray, columns: list[np.ndarray], near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest of its component) among rows with equal groups, which are neighbours; no link twice."""
    node = columns[0]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, k = np.flatnonzero(np.repeat(sizes < 64, sizes)), 1
    while True:
        at = at[at + k < len(group)]
        at = at[group[at] == group[at + k]]
        if not len(at):
            break
        hit = at[near(columns, at, at + k)]
        left.append(hit)
        right.append(hit + k)
        k += 1
    for s, n in zip(starts[sizes >= 64].tolist(), sizes[sizes >= 64].tolist(), strict=True):
        for a in range(s, s + n, 256):
            i = np.repeat(np.arange(a, min(a + 256, s + n)), s + n - a)
            j = np.tile(np.arange(a, s + n), min(256, s + n - a))
            i, j = i[i < j], j[i < j]
            hit = near(columns, i, j)
            left.append(i[hit])
            right.append(j[hit])
    # rows of one node link all its groups of this batch
    order = np.argsort(node, kind="stable")
    same = order[1:][node[order[1:]] == node[order[:-1]]], order[:-1][node[order[1:]] == node[order[:-1]]]
    label = forest(len(group), np.concatenate([*left, same[0]]), np.concatenate([*right, same[1]]))
    least = node.copy()
    np.minimum.at(least, label, node)
    least = least[label]  # tasks that meet the same group name it alike
    moved = np.flatnonzero(node != least)
    pairs = np.unique(np.stack((node[moved], least[moved])), axis=1)
    return pairs[0], pairs[1]


def forest_links(keyed: DataFrame, near: Near) -> DataFrame:
    """(u, v): links whose components are those of all pairs of rows that share a key and are ``near``.

    keyed: (key long, node long, further numbers); ``near`` gets all but the key as arrays. Keys with more than ``BLOCK`` rows are cut
    into blocks, and each pair of blocks is compared by itself, so that no task holds an unbounded group.
    """
    names = keyed.columns
    hot = keep(keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("blocks")))
    both = keyed.join(F.broadcast(hot) if hot.count() <= HOT_KEYS else hot, "key", "left")
    mine, blocks = F.pmod(F.xxhash64("node"), F.col("blocks")), F.col("blocks")
    others = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(mine, j) * blocks + F.greatest(mine, j))
    dealt = both.select(*names, F.explode(F.when(blocks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)).alias("block"))
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            key, block = columns[0], columns[-1]
            group = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (block[1:] != block[:-1]))))
            stop = len(group) if last else int(np.searchsorted(group, group[-1]))
            if stop < len(group):  # the last group may go on in the next batch
                held.append([c[stop:] for c in columns])
            if stop:
                u, v = links_of_sorted(group[:stop], [c[:stop] for c in columns[1:-1]], near)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if sum(len(x[0]) for x in held) >= HELD:
                yield from flush(False)
        if held:
            yield from flush(True)

    return dealt.mapInArrow(compare, "u long, v long").distinct()
