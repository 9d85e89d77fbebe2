"""Queries meet shards of candidates: one shuffle brings both together, and each task goes through them in bounded parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = "array<double>"


def usable(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def padded(vector: str, dims: int, kind: T.ArrayType) -> Column:
    """The vector with zeros up to ``dims`` components."""
    zero = F.lit(0).cast(kind.elementType)
    return F.when(F.size(vector) < dims, F.concat(vector, F.array_repeat(zero, F.lit(dims) - F.size(vector)))).otherwise(F.col(vector))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of equal length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(
    shards: DataFrame, asked: DataFrame, tasks: int, score: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str, part: int = 1024
) -> DataFrame:
    """(query_id, vec_id, score): what ``score`` finds for the queries of each shard among its candidates.

    shards: (shard, vec_id, vector), a bounded number of rows in each shard. asked: (shard, vec_id, vector), any number in
    each: a task holds a shard's candidates and ``part`` of its queries at a time. score(candidates' ids, candidates, queries'
    ids, queries) returns positions of queries, positions of candidates, and scores.
    """
    both = shards.select("shard", F.lit(0).alias("side"), "vec_id", "vector").unionByName(asked.select("shard", F.lit(1).alias("side"), "vec_id", "vector"))
    dealt = both.repartition(tasks, "shard").sortWithinPartitions("shard", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []
        for b in batches:
            shard, side, vec = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (side[1:] != side[:-1])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if shard[a] != now:
                    now, ids, rows = shard[a], [], []
                own = matrix(b.column(3).slice(a, z - a))
                if side[a] == 0:
                    ids.append(vec[a:z])
                    rows.append(own)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                for k in range(0, z - a, part):
                    q, c, s = score(ids[0], rows[0], vec[a:z][k : k + part], own[k : k + part])
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(vec[a:z][k : k + part][q]), pa.array(ids[0][c]), pa.array(s)], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each row, ties to smaller ids; -inf never counts. Pads with -1."""
    n = scores.shape[1]
    if n > 4 * k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        out = np.full((len(scores), k), -1)
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        order = np.lexsort((ids[col], -scores[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, np.arange(len(scores)))
        place = np.arange(len(row)) - first[row]
        keep = place < k
        out[row[keep], place[keep]] = col[keep]
        return out
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return np.where(np.isfinite(np.take_along_axis(scores, order, axis=1)), order, -1)
