"""Exact top-k search by MaxScore over shards of postings (operator 6).

A vector's components, as integers, are the impacts of its terms (dimensions); a query's components weigh them. Each shard
holds its postings by term with the largest and smallest impact of each, so the most and least that a term can add to any
score of the shard is known. For a query, terms are ordered by the span between the two. With the k-th best score found so
far as threshold, the essential terms are those without which no row could reach it: all but the longest tail of terms whose
spans together can't make up the difference. Essential postings are traversed for all rows; the others are probed, term group
by term group, only for rows whose score so far plus the most that the remaining terms can add still competes. Shards give
their best, and these are merged. Sums are exact: where a query's largest possible sum in a shard is below 2**52, they are integers in double
precision; else that query's scores in the shard are summed in integers of any size.

Defined cases: a score beyond the range of long counts as that range's end; vectors that are null, empty or hold null or non-finite components, and rows with null ids, take no part; zero
vectors do; a vector shorter than the longest has zeros in the components that it lacks; ties go to the smaller id; repeated ids
are candidates each; fewer candidates than k give that many rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm._cluster import keep
from assaykit.llm._shards import VECTOR, padded, search, usable
from assaykit.llm._text import project
from assaykit.llm.ann import ranked

SHARD = 4096
#: Rows that give the first threshold, and terms probed between two looks at the threshold.
SEED, STEP = 256, 8


#: Largest sum that double precision holds with all that is added to it, and the largest score.
EXACT, MOST = 2.0**52, 2**63 - 1


def quantize(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of each component x, in double precision; numbers from 2**52 on have no fraction."""
    x = F.col(vector).cast(VECTOR)
    return F.transform(x, lambda c: F.when(F.abs(c * scale) < EXACT, F.floor(c * scale).cast("double")).otherwise(c * scale))


def large_rows(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``top_rows`` for sums of any size."""
    mine = np.flatnonzero(ids != own)
    q = [int(x) for x in query.tolist()]
    score = np.array([max(-MOST, min(MOST, sum(a * int(b) for a, b in zip(q, row, strict=True) if a and b))) for row in rows[mine].tolist()], np.int64)
    pick = np.lexsort((ids[mine], -score))[:k]
    return mine[pick], score[pick]


def top_rows(ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows of a shard; postings are terms x rows, high and low the impacts' bounds."""
    most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(least - most, kind="stable")  # widest span first
    best_rest = np.concatenate((np.cumsum(most[order][::-1])[::-1], [0.0]))  # the most that terms from here on can add
    n = postings.shape[1]
    seed = query @ postings[:, : min(SEED, n)]
    seed = seed[ids[: len(seed)] != own]
    threshold = np.partition(seed, len(seed) - k)[len(seed) - k] if len(seed) >= k else -np.inf
    spans = (most - least)[order]
    tail = np.cumsum(spans[::-1])[::-1]  # what terms from here on can make up over their least
    floor_all = least.sum()
    essential = int(np.searchsorted(-tail, -(threshold - floor_all), side="right")) if np.isfinite(threshold) else len(order)
    essential = min(len(order), max(STEP, essential))
    rows = np.arange(n)
    done = min(len(order), -(-essential // STEP) * STEP)
    head = order[:done]
    score = query[head] @ postings[head]
    while True:
        alive = score + best_rest[done] >= threshold
        rows, score = rows[alive], score[alive]
        if done >= len(order) or not len(rows):
            break
        step = order[done : done + STEP]
        score = score + query[step] @ postings[step][:, rows]
        done += len(step)
        sure = score + least[order[done:]].sum()  # what each row has for certain
        sure = sure[ids[rows] != own]
        if len(sure) >= k:
            threshold = max(threshold, np.partition(sure, len(sure) - k)[len(sure) - k])
    mine = ids[rows] != own
    rows, score = rows[mine], score[mine]
    pick = np.lexsort((ids[rows], -score))[:k]
    return rows[pick], score[pick].astype(np.int64)


def search_exact(df: DataFrame, asks: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long) for the rows where ``asks`` holds (an expression over vec_id)."""
    spark = df.sparkSession
    rows = project(df, vec_id=key, vector=vector).select(F.col("vec_id").cast("long"), "vector")
    rows = keep(rows.where(F.col("vec_id").isNotNull() & usable("vector")).select("vec_id", quantize("vector", scale).alias("vector")))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    rows = rows.withColumn("vector", padded("vector", dims or 0, rows.schema["vector"].dataType))
    shards = max(1, -(-n // SHARD))
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).alias("shard"), "vec_id", "vector")
    asked = rows.where(asks).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "vec_id", "vector")

    def score(ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        postings = np.ascontiguousarray(x.T)
        high, low = postings.max(axis=1), postings.min(axis=1)
        with np.errstate(over="ignore"):
            fits = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)) < EXACT
        out = [top_rows(ids, postings, high, low, v, own, k) if small else large_rows(ids, x, v, own, k) for own, v, small in zip(asking.tolist(), q, fits.tolist(), strict=True)]
        return np.repeat(np.arange(len(q)), [len(c) for c, _ in out]), np.concatenate([c for c, _ in out]), np.concatenate([s for _, s in out])

    return ranked(search(dealt, asked, tasks, score, "long"), k, "long")
