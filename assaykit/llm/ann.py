"""Approximate nearest neighbours with a hierarchical k-means tree (operator 2).

Largest inner products become smallest distances by one more dimension that brings every vector to the length of the longest
one. ``Tree.fit`` splits a bounded sample by k-means, again and again, until nodes are small; every vector then goes down to a
leaf. A query visits leaves best bin first: a priority queue holds the nodes met so far by their centres' distance, and the
nearest is opened next. How many leaves are visited is calibrated: for a bounded sample of queries the exact neighbours among
all vectors are found by brute force, and visits are widened until the wanted share of these lies in the leaves visited.

Each leaf's vectors are dealt over shards of bounded size; a query goes to all shards of the leaves that it visits, and the
shards' best are merged. A query whose leaves hold too few vectors for its answer opens further ones. Only the tree and the calibration queries are broadcast; both are bounded by parameters.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and rows with null ids, take no
part; a vector shorter than the longest has zeros in the components that it lacks; ties go to the smaller id; repeated ids are
candidates each; fewer candidates than asked for give that many rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm._cluster import keep
from assaykit.llm._shards import best, matrix, padded, search, usable
from assaykit.llm._text import project

#: Bounds: vectors that the tree is fitted on, queries that calibrate, branches of a node, and the share of the sample in a leaf.
SAMPLE, CALIBRATION, BRANCHES, LEAF = 16_384, 128, 8, 1 / 16
#: Rows of a shard.
SHARD = 2048


class Tree:
    """Nodes in one array: centres, and the children of inner nodes; leaves have numbers from 0."""

    def __init__(self, sample: np.ndarray, longest: float, branches: int = BRANCHES, leaf: float = LEAF, seed: int = 7):
        self.longest = longest
        self.centres: list[np.ndarray] = [np.zeros(sample.shape[1] + 1)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self._split(0, self.lift(sample), branches, max(2 * branches, int(leaf * len(sample))))
        self.points = np.array(self.centres)
        del self.rng

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one more component that makes all as long as the longest."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def _split(self, node: int, x: np.ndarray, branches: int, small: int) -> None:
        groups = self._kmeans(x, branches) if len(x) > small else []
        if len(groups) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return
        first = len(self.centres)
        for g in groups:
            self.centres.append(x[g].mean(axis=0))
            self.children.append([])
            self.leaf.append(-1)
        self.children[node] = list(range(first, first + len(groups)))
        for child, g in zip(self.children[node], groups, strict=True):
            self._split(child, x[g], branches, small)

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 8) -> list[np.ndarray]:
        centre = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        near = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        return [g for i in range(k) if len(g := np.flatnonzero(near == i))]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node to the nearest child."""
        lifted, out = self.lift(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            centre = self.points[kids]
            near = kids[(lifted[rows] @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)]
            todo += [(kid, rows[near == kid]) for kid in kids.tolist()]
        return out

    def visit(self, queries: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first, and more until their ``sizes`` add up to ``least``; a query is lifted by 0."""
        far = ((self.points**2).sum(axis=1) / 2 - np.concatenate((queries, np.zeros((len(queries), 1))), axis=1) @ self.points.T).tolist()
        out = []
        for d in far:
            queue, found, held = [(0.0, 0)], [], 0
            while queue and (len(found) < most or held < least):
                node = heapq.heappop(queue)[1]
                if self.leaf[node] >= 0:
                    found.append(self.leaf[node])
                    held += 0 if sizes is None else int(sizes[self.leaf[node]])
                for kid in self.children[node]:
                    heapq.heappush(queue, (d[kid], kid))
            out.append(found)
        return out


def prepare(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part; components keep their type, and are computed with as doubles."""
    rows = project(df, vec_id=key, vector=vector).select(F.col("vec_id").cast("long"), "vector")
    return rows.where(F.col("vec_id").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0))


def hashed_sample(rows: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id."""
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))


def search_tree(df: DataFrame, asks: Column, k: int = 20, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score) for the rows where ``asks`` holds (an expression over vec_id), and what was calibrated."""
    spark = df.sparkSession
    rows = prepare(df, key, vector)
    n, longest, dims = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.max(F.size("vector"))).first()
    if not n:
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return empty, {"rows": 0, "leaves": 0, "visits": 0, "recall": 1.0}
    rows = rows.withColumn("vector", padded("vector", dims, rows.schema["vector"].dataType))
    kind = rows.schema["vector"].dataType.simpleString()
    sample = np.array([r["vector"] for r in hashed_sample(rows, n, SAMPLE, "tree").collect()] or [rows.first()["vector"]])
    tree = Tree(sample, float(np.sqrt(longest)))
    shared = spark.sparkContext.broadcast(tree)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(matrix(b.column(1)))), *b.columns], names=["leaf", "vec_id", "vector"])

    placed = keep(rows.mapInArrow(to_leaf, f"leaf long, vec_id long, vector {kind}"))
    queries = placed.where(asks).select("vec_id", "vector")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    visits, reached = _calibrate(placed, queries, tree, k, recall, n)

    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # bounded by the tree
    held = np.array([sizes.get(i, 0) for i in range(tree.leaves)])
    own = queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1  # rows of a query's own id are no candidates
    parts = np.maximum(1, -(-held // SHARD))
    first = np.cumsum(parts) - parts
    base = F.element_at(F.array(*map(F.lit, first.tolist())), F.col("leaf").cast("int") + 1)
    of = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("leaf").cast("int") + 1)
    shards = placed.select((base + F.pmod(F.xxhash64("vec_id", "vector"), of)).alias("shard"), "vec_id", "vector")

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                leaves = shared.value.visit(matrix(part.column(1)), visits, held, k + own)
                row = np.repeat(np.arange(part.num_rows), [parts[own_leaves].sum() for own_leaves in leaves])
                shard = np.concatenate([np.arange(first[i], first[i] + parts[i]) for own_leaves in leaves for i in own_leaves])
                yield pa.RecordBatch.from_arrays([pa.array(shard), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["shard", "vec_id", "vector"])

    asked = queries.mapInArrow(to_shards, f"shard long, vec_id long, vector {kind}")

    def score(ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return finalists(ids, x, asking, q, k)

    found = search(shards, asked, tasks, score, "double")
    return ranked(found, k, "double"), {"rows": n, "leaves": tree.leaves, "visits": visits, "recall": reached}


def finalists(ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and of their k best candidates, and scores: sums in the order of components, so that equal vectors score equally.

    A matrix product's last bits depend on where a vector stands, so it only says which candidates can be among the best. Sums that
    overflow count as infinite, those without a value as least.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        other = asking[:, None] != ids[None, :]
        s[~other] = -np.inf
        n = s.shape[1]
        least = np.partition(s, n - min(k, n), axis=1)[:, n - min(k, n)]
        slack = 4 * q.shape[1] * np.finfo(float).eps * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        least = np.where(np.isfinite(least), least - np.where(np.isfinite(slack), slack, np.inf), least)
        row, col = np.nonzero((s >= least[:, None]) & other)
        score = np.zeros(len(row))
        for d in range(q.shape[1]):
            score += q[row, d] * x[col, d]
    score = np.nan_to_num(score, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first], score[first]


def ranked(found: DataFrame, k: int, kind: str) -> DataFrame:
    """The k best of each query over all shards."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast(kind))


def _calibrate(placed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, n: int) -> tuple[int, float]:
    """The number of leaves to visit, and the share of true neighbours in them, by brute force for a sample of queries."""
    total = queries.count()
    some = hashed_sample(queries, total, CALIBRATION, "calibration").collect() or queries.limit(CALIBRATION).collect()
    if not some:
        return 1, 1.0
    ids, vectors = np.array([r["vec_id"] for r in some]), np.array([r["vector"] for r in some])
    shared = placed.sparkSession.sparkContext.broadcast((ids, vectors))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        held: list[tuple] = []
        for b in batches:
            leaf, vec = b.column(0).to_numpy(), b.column(1).to_numpy()
            s = q @ matrix(b.column(2)).T
            s[own[:, None] == vec[None, :]] = -np.inf
            top = best(s, vec, min(k, len(vec)))
            row, place = np.nonzero(top >= 0)
            held.append((row, leaf[top[row, place]], vec[top[row, place]], s[row, top[row, place]]))
            row, leaf, vec, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((vec, -s, row))
            row, leaf, vec, s = row[order], leaf[order], vec[order], s[order]
            good = np.arange(len(row)) - np.searchsorted(row, row) < k
            held = [(row[good], leaf[good], vec[good], s[good])]
        for row, leaf, vec, s in held:
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(leaf), pa.array(vec), pa.array(s)], names=["row", "leaf", "vec_id", "score"])

    near = placed.mapInArrow(exact, "row long, leaf long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    truth = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("row", "leaf").collect()
    if not truth:
        return 1, 1.0
    visited = np.array(tree.visit(vectors, tree.leaves))
    place = np.argsort(visited, axis=1)  # at each leaf, when it is visited
    when = np.array([place[r["row"], r["leaf"]] for r in truth])
    share = np.cumsum(np.bincount(when, minlength=tree.leaves)) / len(when)
    visits = int(np.searchsorted(share, min(recall, share[-1]))) + 1
    return min(visits, tree.leaves), float(share[min(visits, tree.leaves) - 1])
