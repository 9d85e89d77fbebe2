"""Audit of how filters interact in every order (operator 11).

A row's failure mask says which filters it fails. What each filter removes in any order, what it removes alone, and its Shapley
value follow from the number of rows with each mask, so masks are merged into counters of each part, 32 for five filters, and
only these are laid out over orders and steps.

Exact duplicates come from a sort: rows are range-sorted by fingerprint, full text and key, and a row whose predecessor has its
text fails if its key is above the text's smallest. Ranges are drawn on fingerprint and key alone, so that no text takes part
in the sampling and the copies of one text spread over many tasks. Where a text may have begun in an earlier range (it shares
its fingerprint with the range's first row), rows with its smallest key in the range stay open; the first and last texts of all
ranges, a few digests each, then settle them. A text is shuffled once and read by Python once.

Defined cases: a null text is empty, a null part the empty string. A row without a key is no duplicate and makes none. Repeated
rows of one key are not duplicates of each other. A key that is marked twice counts as marked if any of its rows says so. An
empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._cluster import keep
from assaykit.llm._text import project

UPPER, SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: Marked keys that are broadcast at most; beyond it they meet the rows by a shuffle.
FEW = 2_000_000
#: Mask of rows that only carry the smallest key of a range's last texts.
EDGE = -1


def failing(text: str) -> int:
    """Bit 0: under 100 words. 1: under 80 % of them distinct. 2: over 10 % capitals. 3: holds one of #$%&*|."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, UPPER))
    signs = len(raw) != len(raw.translate(None, SIGNS))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * len(text)) << 2 | signs << 3


def masks(df: DataFrame, checks: Callable[[str], int], bits: int, key: str, text: str, part: str) -> DataFrame:
    """(key, part, mask) of every row: the bits of ``checks``, and bit ``bits`` for texts that a smaller key has."""
    rows = project(df, **{key: key, "_text": text, "_part": part})
    rows = rows.select(key, F.coalesce("_text", F.lit("")).alias("_text"), F.coalesce(F.col("_part").cast("string"), F.lit("")).alias("part"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("_fp", F.xxhash64("_text")).repartitionByRange(tasks, "_fp", key).sortWithinPartitions("_fp", "_text", key)
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("part string, mask int, digest binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = fp = last = least = digest = None
        mask, edges = 0, {}  # edges: the smallest key of each text that has the fingerprint at hand
        for b in batches:
            own, found = [], []
            for k, t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if f != fp:
                    fp, edges = f, {}
                    head = f if head is None else head
                if t != last or not edges:
                    last, least, mask = t, None, checks(t)
                    digest = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() if f == head else None
                if least is None and k is not None:
                    least = k
                edges[t] = least
                same = k is not None and k > least
                own.append(mask | same << bits)
                found.append(digest if k is not None and not same else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own, pa.int32()), pa.array(found, pa.binary())], names=[key, "part", "mask", "digest"])
        ends = [] if fp == head else [(k, hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()) for t, k in edges.items() if k is not None]
        if ends:
            keys, digests = zip(*ends, strict=True)
            kind = b.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.nulls(len(ends), pa.string()), pa.array([EDGE] * len(ends), pa.int32()), pa.array(digests, pa.binary())], names=[key, "part", "mask", "digest"])

    found = keep(ordered.mapInArrow(run, schema))
    first = found.where("digest is not null").groupBy("digest").agg(F.min(key).alias("_least"))
    settled = found.where((F.col("mask") != EDGE) & F.col("digest").isNotNull()).join(first, "digest")
    settled = settled.select(key, "part", F.when(F.col("_least") < F.col(key), F.col("mask").bitwiseOR(1 << bits)).otherwise(F.col("mask")).alias("mask"))
    return found.where("digest is null").select(key, "part", "mask").unionByName(settled)


def marked(marks: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """(key, one boolean column for each condition): keys that any row marks."""
    rows = marks.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conditions.items()))
    rows = keep(rows.where(" or ".join(conditions)))
    return F.broadcast(rows) if rows.count() <= FEW else rows


def layouts(letters: str) -> tuple[list[tuple[str, int]], np.ndarray, dict[str, np.ndarray]]:
    """Orders with steps; the filter of each; for each number, whether a mask counts in it, by order and step."""
    size = len(letters)
    mask = np.arange(1 << size)
    names, bit, before = [], [], []
    for order in permutations(range(size)):
        for step, i in enumerate(order):
            names.append(("".join(letters[j] for j in order), step + 1))
            bit.append(1 << i)
            before.append(sum(1 << j for j in order[:step]))
    bit, before = np.array(bit)[:, None], np.array(before)[:, None]
    fails, gone = mask & bit != 0, mask & before != 0
    return names, bit[:, 0], {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit}


def audit(df: DataFrame, marks: DataFrame, checks: Callable[[str], int] = failing, letters: str = "ABCDE", key: str = "doc_id", text: str = "text", part: str = "lang", **conditions: Column) -> DataFrame:
    """Numbers of every part, order of filters and step, zeros included.

    ``letters`` names the bits of ``checks`` and, last, exact duplicates. conditions: columns of ``marks``, by the name under which
    removed keys that have them are counted. shapley sums what a step's filter removes over all orders.
    """
    rows = masks(df, checks, len(letters) - 1, key, text, part)
    flags = marked(marks, key, **conditions) if conditions else None
    both = rows if flags is None else rows.join(flags, rows[key] == flags["_key"], "left")
    counters = both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c)).alias(c) for c in conditions))
    grouped = counters.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", *conditions))).alias("counters"))  # at most 2 ** len(letters)
    names, bit, counted = layouts(letters)
    lost = list(conditions)
    columns = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(1 << len(letters))
        rank = np.bitwise_count(every).astype(np.int64)
        for b in batches:
            for own, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums = np.zeros((1 + len(lost), len(every)), np.int64)
                for x in items:
                    sums[:, x["mask"]] = [x["n"], *(x[c] for c in lost)]
                values = [counted[c] @ sums[0] for c in columns[:4]] + [counted["removed"] @ s for s in sums[1:]]
                orders = len(names) // len(letters)
                share = np.where(rank > 0, sums[0] * (orders // np.maximum(rank, 1)), 0)  # each failed filter comes first equally often
                values.append(((every & bit[:, None]) != 0) @ share)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(names)), pa.array([o for o, _ in names]), pa.array([s for _, s in names], pa.int32()), *map(pa.array, values)], names=["part", "filter_order", "step", *columns])

    return grouped.mapInArrow(lay_out, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in columns)}")
