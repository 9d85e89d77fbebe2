"""Density clusters: nearest neighbours, mutual reachability, a spanning tree, and the condensed tree with noise.

A point's core distance is that to its ``min_samples``-th neighbour; two neighbours' reachability is the largest of both core distances
and their own distance. Edges of a spanning tree, shortest first, merge points into components; one of at least
``min_cluster_size`` points is a cluster, two such that merge give way to a new one, and smaller ones that join it
are points which leave it at that density. A cluster is chosen if its points' excess of density is at least that of the chosen ones
inside it; points in no chosen cluster are noise. A cluster is named by its smallest point.

One tree serves every cluster size. Trees, of any numbers of neighbours and samples or any projection, are rows of the same tables
(``tree``), so that a grid of parameters costs one run.

At scale: neighbours are exact, so their cost is quadratic in the points. A task holds at most ``BLOCK`` points and goes through all others as
they come; sums in single precision, with room for their error, tell which pairs are measured in double (``Nearest``). A spanning
forest of some of the edges holds all of theirs that a forest of the whole can have, so that tasks thin what they have before it meets (``thinned``,
``spanning_trees``); above ``SPAN`` edges that thinning doesn't reduce, rounds halve the components. The merges are gone through in slices of
``SLICE`` edges by rank, each in one task with the components it meets, whose state is their size, the clusters they are in, and their points
only while there are too few for a cluster.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Of rows with one key any one counts.
Distances are those of unit vectors, to nine digits, and count as 1e-9 at least; ties go to smaller keys. Points whose
neighbours do not connect stay apart at every density. The whole pool is no cluster, unless it falls into several by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import stats
from assaykit.operators.numbering import ranked
from assaykit.operators.rounds import kept

#: Points whose neighbours one task finds, at most and (if there are cores) at least; their numbers at most.
BLOCK, LEAST, NUMBERS = 131_072, 2048, 1 << 24
#: Points of a tile, and others it is held against at once.
ROWS, WIDE = 512, 1024
#: Edges that one task takes in: for a spanning forest, for merges; points whose core distances are broadcast.
SPAN, SLICE, FEW = 4_000_000, 200_000, 1_000_000
CLOSEST = 1e-9


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(node, v): vectors of length one."""
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            x, size = matrix(batch["v"], int(max(long, default=0))), np.zeros(len(long))
            with np.errstate(over="ignore", invalid="ignore"):
                for c in range(x.shape[1]):  # in this order, which no library's choice of kernel changes
                    size += x[:, c] ** 2
            size = np.sqrt(size)
            keep = (size > 0) & np.isfinite(size)  # nulls come as nan
            held = np.arange(x.shape[1]) < long[keep, None]
            ends = pa.array(np.concatenate([[0], np.cumsum(long[keep])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["node"].filter(pa.array(keep)), pa.ListArray.from_arrays(ends, pa.array((x[keep] / size[keep, None])[held]))], names=["node", "v"])

    return rows.mapInArrow(unit, "node long, v array<double>").dropDuplicates(["node"])


def projected(vectors: DataFrame, dims: int, seed: int) -> DataFrame:
    """(node, v): unit vectors of ``dims`` components by random directions that the seed fixes, or as they are if they have no more."""
    long = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if long <= dims:
        return vectors
    directions = np.random.RandomState(seed).standard_normal((dims, long))

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = matrix(batch["v"], long), np.zeros((batch.num_rows, dims))
            for c in range(long):  # in this order, which no library's choice of kernel changes
                out += x[:, c : c + 1] * directions[:, c]
            size = np.sqrt(sum((out[:, c] ** 2 for c in range(dims)), np.zeros(len(out))))
            keep = (size > 0) & np.isfinite(size)
            unit = pa.ListArray.from_arrays(pa.array(np.arange(keep.sum() + 1) * dims, pa.int32()), pa.array((out[keep] / size[keep, None]).ravel()))
            yield pa.RecordBatch.from_arrays([batch["node"].filter(pa.array(keep)), unit], names=["node", "v"])

    return vectors.select("node", "v").mapInArrow(low, "node long, v array<double>")


class Nearest:
    """The k nearest of points that come in any order, for each of a task's own points: distances, and ties to smaller keys."""

    def __init__(self, node: np.ndarray, x: np.ndarray, k: int) -> None:
        self.node, self.x, self.low, self.k = node, x, x.astype(np.float32), k
        self.d, self.v = np.full((len(node), k), np.inf), np.full((len(node), k), np.iinfo(np.int64).max)
        self.room = x.shape[1] * 2.0**-22 + 2.0**-20  # more than a sum of products errs by in single precision
        self.waiting: list[list[tuple]] = [[] for _ in range(0, len(node), ROWS)]

    def add(self, node: np.ndarray, x: np.ndarray) -> None:
        low = x.astype(np.float32)
        for t, s in enumerate(range(0, len(self.node), ROWS)):
            own = self.low[s : s + ROWS]
            for c in range(0, len(node), WIDE):
                bound = self.d[s : s + ROWS, -1]
                least = (1 - bound**2 / 2 - self.room).astype(np.float32)
                near = own @ low[c : c + WIDE].T
                if len(least) and least.min() == -np.inf and near.shape[1] > self.k + 1:  # k others of these alone, and perhaps itself
                    kth = near.shape[1] - self.k - 1
                    least = np.maximum(least, np.partition(near, kth, axis=1)[:, kth] - np.float32(2 * self.room))
                hit = (near >= least[:, None]).ravel()
                if len(hit) % 8:
                    at = np.flatnonzero(hit)
                else:  # few are: eight at once first
                    some = np.flatnonzero(hit.view(np.int64))
                    at = (some[:, None] * 8 + np.arange(8))[hit.reshape(-1, 8)[some]]
                i, j = np.divmod(at, near.shape[1])
                if len(i):
                    self._measure(t, s, i, node[c + j], x[c + j])

    def _measure(self, t: int, s: int, i: np.ndarray, v: np.ndarray, y: np.ndarray) -> None:
        d = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", self.x[s + i], y))), 9)
        most, last = self.d[s + i, -1], self.v[s + i, -1]
        nearer = ((d < most) | (d == most) & (v < last)) & (v != self.node[s + i])
        self.waiting[t].append((i[nearer], d[nearer], v[nearer]))
        if sum(len(w[0]) for w in self.waiting[t]) >= min(ROWS, len(self.node) - s) * self.k:
            self._settle(t)

    def _settle(self, t: int) -> None:
        own = slice(t * ROWS, min((t + 1) * ROWS, len(self.node)))
        n = own.stop - own.start
        i, d, v = (np.concatenate([first, *rest]) for first, *rest in zip((np.repeat(np.arange(n), self.k), self.d[own].ravel(), self.v[own].ravel()), *self.waiting[t], strict=True))
        order = np.lexsort((v, d, i))
        first = np.searchsorted(i[order], np.arange(n))
        best = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.d[own], self.v[own], self.waiting[t] = d[best].reshape(n, self.k), v[best].reshape(n, self.k), []

    def found(self) -> Iterator[pa.RecordBatch]:
        for t, waiting in enumerate(self.waiting):
            if waiting:
                self._settle(t)
        for s in range(0, len(self.node), 10_000):
            d, v = self.d[s : s + 10_000], self.v[s : s + 10_000]
            real = np.isfinite(d)
            ends = pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(self.node[s : s + 10_000]), *(pa.ListArray.from_arrays(ends, pa.array(x[real])) for x in (v, d))], names=["u", "v", "d"])


def matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    held, long = vectors.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (long == dims).all():
        return held.reshape(len(long), dims)
    out = np.zeros((len(long), dims))
    out[np.arange(dims) < long[:, None]] = held
    return out


def nearest(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(u, v, d): of each of (node, v) the k nearest other points, nearest first, and their distances."""
    n, dims = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tasks = max(1, -(-n // min(block, max(1, NUMBERS // max(dims, 1)))), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
    own = F.pmod(F.xxhash64("node"), F.lit(tasks))
    dealt = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), own.alias("own"), "node", "v")
    dealt = dealt.select("task", (F.col("task") != F.col("own")).alias("other"), "node", "v")

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, near = None, [], None  # the task, its own points, and what is found for them

        def begun() -> Nearest:
            own = Nearest(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            own.add(own.node, own.x)
            return own

        for batch in batches:
            task, other = (batch[c].to_numpy(zero_copy_only=False) for c in ("task", "other"))
            ends = [*(np.flatnonzero((np.diff(task) != 0) | (np.diff(other.astype(int)) != 0)) + 1), len(task)]
            for s, e in zip([0, *ends], ends, strict=False):
                if s == e:
                    continue
                if task[s] != at:
                    if held:
                        yield from (near or begun()).found()
                    at, held, near = task[s], [], None
                rows = batch["node"].slice(s, e - s).to_numpy(), matrix(batch["v"].slice(s, e - s), dims)
                if not other[s]:
                    held.append(rows)
                elif held:
                    near = near or begun()
                    near.add(*rows)
        if held:
            yield from (near or begun()).found()

    rows = dealt.repartitionByRange(tasks, "task").sortWithinPartitions("task", "other")  # a task's own points first
    return kept(rows.mapInArrow(closest, "u long, v array<long>, d array<double>"))


def neighbours(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(u, v, d, rank): the k nearest other points of each of (node, v)."""
    near = nearest(vectors, k, block).select("u", F.posexplode(F.arrays_zip(F.col("v"), F.col("d"))).alias("place", "n"))
    return near.select("u", "n.v", "n.d", (F.col("place") + 1).alias("rank"))


def reachability(near: DataFrame, trees: list[tuple[int, int, int]]) -> DataFrame:
    """(tree, u, v, w) for each (tree, neighbours, min_samples): edges u < v with their mutual reachability, perhaps twice."""
    samples = sorted({m for _, _, m in trees})
    core = kept(near.where(F.col("rank").isin(samples)).groupBy("u").agg(*(F.max(F.when(F.col("rank") == m, F.col("d"))).alias(f"c{m}") for m in samples)))
    known = F.broadcast(core) if core.count() <= FEW else core
    ends = [known.select(F.col("u").alias(end), F.struct(*(f"c{m}" for m in samples)).alias(f"core_{end}")) for end in "uv"]
    both = near.where(F.col("rank") <= max(k for _, k, _ in trees)).join(ends[0], "u").join(ends[1], "v")

    def weight(m: int):
        cores = [F.col(f"core_{end}.c{m}") for end in "uv"]
        return F.when(cores[0].isNotNull() & cores[1].isNotNull(), F.greatest("d", *cores))

    each = F.array(*(F.struct(F.lit(t).alias("tree"), F.when(F.col("rank") <= k, weight(m)).alias("w")) for t, k, m in trees))
    edges = both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.explode(each).alias("e"))
    return edges.select("e.tree", "u", "v", "e.w").where("w is not null")


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the edges of a least spanning forest of the components a and b that edges join; equal weights in the order of u, v."""
    order = np.lexsort((v, u, w))
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q, left, every, taken = place[: len(a)][order], place[len(a) :][order], order, np.arange(len(names)), [order[:0]]
    while (apart := p != q).any():
        p, q, left = p[apart], q[apart], left[apart]
        least = np.full((2, len(names)), len(left))
        for ends, first in zip((p, q), least, strict=True):
            first[ends[::-1]] = np.arange(len(left))[::-1]  # the last that is written stays: the least
        least = least.min(axis=0)
        some = np.flatnonzero(least < len(left))
        up = every.copy()
        up[some] = p[least[some]] + q[least[some]] - some
        up = np.where((up[up] == every) & (every < up), every, up)
        taken.append(left[np.unique(least[some])])
        while not np.array_equal(further := up[up], up):
            up = further
        p, q = up[p], up[q]
    return np.concatenate(taken)


EDGES = "tree int, u long, v long, w double, a long, b long"


def thinned(few: int):
    """A function that goes through edges of any trees and hands on a least spanning forest of those it holds, at most about ``few`` a tree.

    Edges without a, b join their points themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        sizes: dict[int, int] = {}

        def thin(tree: int) -> tuple:
            u, v, w, a, b = (np.concatenate(x) for x in zip(*held.pop(tree), strict=True))
            keep = forest(a, b, w, u, v)
            return tuple(x[keep] for x in (u, v, w, a, b))

        def told(tree: int, edges: tuple) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(edges[0]), 100_000):
                part = [x[s : s + 100_000] for x in edges]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), tree, np.int32)), *map(pa.array, part)], names=["tree", "u", "v", "w", "a", "b"])

        for batch in batches:
            of = batch["tree"].to_numpy()
            columns = [batch[c].to_numpy() for c in ("u", "v", "w", *(("a", "b") if "a" in batch.schema.names else ("u", "v")))]
            for tree in np.unique(of).tolist():
                own = of == tree
                held.setdefault(tree, []).append(tuple(x[own] for x in columns))
                sizes[tree] = sizes.get(tree, 0) + int(own.sum())
                if sizes[tree] >= few:
                    edges = thin(tree)
                    sizes[tree] = len(edges[0])
                    if 2 * sizes[tree] > few:
                        yield from told(tree, edges)
                        sizes[tree] = 0
                    else:
                        held[tree] = [edges]
        for tree in list(held):
            yield from told(tree, thin(tree))

    return run


def spanning_trees(edges: DataFrame, few: int = SPAN, most: int | None = None) -> DataFrame:
    """(tree, u, v, w): the edges of a least spanning forest of each tree; equal weights in the order of u, v. ``most``: edges of a tree at most.

    Tasks thin the edges they have before they meet in parts of about ``few``. Where more are left of a tree, parts are thinned again as long as
    that halves them, and else every component takes its least edge, and components that are joined so become one: at least half of them go. What
    is left is thinned to the least edge between two components. Below ``few`` edges a tree is finished in one task.
    """
    order = F.struct("w", "u", "v")
    taken = None

    def forests(df: DataFrame, parts: int) -> DataFrame:
        run = thinned(few if parts > 1 else 1 << 62)

        def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(batches)

        return kept(df.groupBy("tree", F.pmod(F.xxhash64("u", "v"), F.lit(parts)).alias("part")).applyInArrow(of_group, EDGES))

    def counts(df: DataFrame) -> tuple[int, int]:
        """Edges of the tree with the most, and of all."""
        each = df.groupBy("tree").count().agg(F.max("count"), F.sum("count")).first()
        return each[0] or 0, each[1] or 0

    left = edges.where("u <> v").select("tree", "u", "v", "w")
    most = counts(left)[0] if most is None else most
    left = forests(left.mapInArrow(thinned(few // 2 or 1), EDGES).drop("a", "b"), max(1, -(-most // few)))
    most, every = counts(left)
    while most > few:
        left = forests(left, -(-2 * most // few))
        before, (most, every) = every, counts(left)
        if most <= few or 2 * every <= before:
            continue
        both = left.unionByName(left.select("tree", "u", "v", "w", F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("tree", "a").agg(F.min(F.struct("w", "u", "v", F.col("b").alias("to"))).alias("e")).select("tree", "a", "e.*"))
        chosen = least.select("tree", "u", "v", "w").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        met = least.join(least.select("tree", F.col("a").alias("to"), F.col("to").alias("back")), ["tree", "to"])
        up = kept(met.select("tree", "a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("to")))
        while True:
            jump = kept(up.join(up.select("tree", F.col("a").alias("to"), F.col("to").alias("next")), ["tree", "to"]).select("tree", "a", "to", "next"))
            up = jump.select("tree", "a", F.col("next").alias("to"))
            if jump.where("to <> next").isEmpty():
                break
        moved = left.join(up.withColumnRenamed("to", "x"), ["tree", "a"]).join(up.toDF("tree", "b", "y"), ["tree", "b"]).where("x <> y")
        thin = moved.groupBy("tree", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(order).alias("e"))
        left = kept(thin.select("tree", "e.u", "e.v", "e.w", "a", "b"))
        most, every = counts(left)
    rest = forests(left, 1).select("tree", "u", "v", "w")
    return rest if taken is None else kept(taken.unionByName(rest))


class Union:
    """Disjoint sets of numbers, each named by its smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (t := self.up.get(top, top)) != top:
            top = t
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def put(self, a: int, b: int) -> int:
        """Joins two sets; returns the name of both."""
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return min(a, b)


STATE = "comp long, to long, points long, members array<long>, cluster array<long>, mass array<double>, inner array<double>"
EVENTS = f"tree int, kind string, size int, nodes array<long>, cluster long, parent long, own boolean, {STATE}"


def merged_slice(sizes: list[int]):
    """A function that goes through one tree's edges of a slice with the components they meet, and tells what happens.

    kind ``points``: nodes leave cluster; ``cluster``: a cluster gave way to parent, own says whether its excess is at least that
    chosen inside it; ``state``: component comp is part of to, whose state goes with the row where both are the same.
    """

    def run(edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(edges):
            return pd.DataFrame(columns=[c.split()[0] for c in EVENTS.split(", ")])
        tree, out, join, top = int(edges["tree"].iloc[0]), [], Union(), max(sizes)
        comps, gone = {}, {}
        for r in states.itertuples():  # nulls in arrays come as nan
            cluster, inner = ([None if x is None or x != x else kind(x) for x in own] for own, kind in ((r.cluster, int), (r.inner, float)))
            comps[r.comp] = [r.points, None if r.members is None else [int(x) for x in r.members], cluster, list(r.mass), inner]
        for r in edges.sort_values("rank").itertuples():
            for x in (r.a, r.b):
                if x not in comps:
                    comps[x] = [1, [x], [None] * len(sizes), [0.0] * len(sizes), [None] * len(sizes)]
            a, b = join.find(r.a), join.find(r.b)
            (na, ma, ca, xa, ia), (nb, mb, cb, xb, ib) = comps[a], comps[b]
            density, n = 1 / max(r.w, CLOSEST), na + nb
            cluster, mass, inner = [None] * len(sizes), [0.0] * len(sizes), [None] * len(sizes)
            for i, least in enumerate(sizes):
                if ca[i] is not None and cb[i] is not None:
                    total = 0.0
                    for c, size, x, inside in ((ca[i], na, xa[i], ia[i]), (cb[i], nb, xb[i], ib[i])):
                        excess = x - size * density
                        own = inside is None or excess >= inside
                        total += excess if own else inside
                        out.append((tree, "cluster", least, None, c, r.rank, own))
                    cluster[i], mass[i], inner[i] = r.rank, n * density, total
                elif ca[i] is not None or cb[i] is not None:
                    big, x, inside, small = (ca[i], xa[i], ia[i], mb) if ca[i] is not None else (cb[i], xb[i], ib[i], ma)
                    gone.setdefault((least, big), []).extend(small)
                    cluster[i], mass[i], inner[i] = big, x + len(small) * density, inside
                elif n >= least:
                    gone.setdefault((least, r.rank), []).extend(ma + mb)
                    cluster[i], mass[i] = r.rank, n * density
            to = join.put(a, b)
            del comps[max(a, b)]
            comps[to] = [n, ma + mb if n < top else None, cluster, mass, inner]
        out += [(tree, "points", least, nodes, cluster, None, None) for (least, cluster), nodes in gone.items()]
        events = [(*e, *[None] * 7) for e in out]
        seen = {*edges["a"].tolist(), *edges["b"].tolist()}
        for x in seen:
            to = join.find(x)
            own = comps[to] if to == x else [None] * 5
            events.append((tree, "state", *[None] * 5, x, to, *own))
        return pd.DataFrame(events, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"size": "Int32", "cluster": "object", "parent": "Int64", "own": "boolean", "comp": "Int64", "to": "Int64", "points": "Int64"})

    return run


def condensed(edges: DataFrame, sizes: list[int], part: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Of spanning trees (tree, u, v, w): (tree, size, nodes, cluster) where points leave, and (tree, size, cluster, parent, own)."""
    events = f"tree int, kind string, size int, nodes array<long>, leaves long, parent long, own boolean, {STATE}"

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return merged_slice(sizes)(e, s).set_axis([c.split()[0] for c in events.split(", ")], axis=1)

    left = kept(ranked(edges.select("tree", "u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")), ["tree"], [F.col("w"), F.col("u"), F.col("v")], F.col("w"), "rank"))
    last = left.agg(F.max("rank")).first()[0] or 0
    spark = edges.sparkSession
    states = spark.createDataFrame([], f"tree int, {STATE}")
    told: DataFrame | None = None
    for first in range(0, last, part):
        own = left.where(F.col("rank").between(first + 1, first + part)).select("tree", "rank", "w", "a", "b")
        ends = own.select("tree", F.explode(F.array("a", "b")).alias("comp")).distinct()
        met = states.join(ends, ["tree", "comp"], "left_semi")
        found = kept(own.groupBy("tree").cogroup(met.groupBy("tree")).applyInPandas(run, events))
        told = found if told is None else told.unionByName(found)
        if first + part >= last:
            states = found.where("kind = 'state' and comp = to").select("tree", *(c.split()[0] for c in STATE.split(", "))).unionByName(states.join(ends, ["tree", "comp"], "left_anti"))
            break
        moved = F.broadcast(found.where("kind = 'state'").select("tree", "comp", "to"))  # at most 2 * part rows a tree
        rest = left.where(F.col("rank") > first + part)
        rest = rest.join(moved.toDF("tree", "a", "x"), ["tree", "a"], "left").join(moved.toDF("tree", "b", "y"), ["tree", "b"], "left")
        left = kept(rest.select("tree", "rank", "u", "v", "w", F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
        kept_on = states.join(ends, ["tree", "comp"], "left_anti").unionByName(found.where("kind = 'state' and comp = to").select("tree", *(c.split()[0] for c in STATE.split(", "))))
        states = kept(kept_on)
    none = spark.createDataFrame([], events)
    told = none if told is None else told
    points = told.where("kind = 'points'").select("tree", "size", "nodes", F.col("leaves").alias("cluster"))
    closed = told.where("kind = 'cluster'").select("tree", "size", F.col("leaves").alias("cluster"), "parent", "own")
    at = F.array(*map(F.lit, sizes))
    each = F.explode(F.arrays_zip(at.alias("size"), F.col("cluster").alias("cluster"), F.col("mass").alias("mass"), F.col("inner").alias("inner")))
    open_ = states.select("tree", each.alias("s")).select("tree", "s.*").where("cluster is not null")
    several = kept(open_.groupBy("tree", "size").agg((F.count(F.lit(1)) > 1).alias("several")))  # the whole pool is none
    open_ = open_.join(several, ["tree", "size"]).select("tree", "size", "cluster", F.lit(None).cast("long").alias("parent"), (F.col("several") & (F.col("inner").isNull() | (F.col("mass") >= F.col("inner")))).alias("own"))
    return points, closed.unionByName(open_)


def chosen(clusters: DataFrame, few: int = SLICE) -> DataFrame:
    """(tree, size, cluster, top): the outermost cluster with ``own`` that holds each cluster; null without any.

    The clusters of one tree and size are gone through in one task if they are at most ``few``, else in rounds that double the reach.
    """
    up = kept(clusters.select("tree", "size", "cluster", F.col("parent").alias("up"), F.when(F.col("own"), F.col("cluster")).alias("top")))

    def reach(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster", ignore_index=True)
        names, above = rows["cluster"].to_numpy(), rows["up"].fillna(-1).to_numpy(np.int64)
        at = np.where(above < 0, -1, np.searchsorted(names, above))
        top = rows["top"].fillna(-1).to_numpy(np.int64)
        while (further := at >= 0).any():
            top = np.where(further & (top[at] >= 0), top[at], top)
            at = np.where(further, at[at], -1)
        return rows[["tree", "size", "cluster"]].assign(top=pd.array(top, dtype="Int64")).assign(top=lambda x: x["top"].mask(x["top"] < 0))

    if (up.groupBy("tree", "size").count().agg(F.max("count")).first()[0] or 0) <= few:
        return up.groupBy("tree", "size").applyInPandas(reach, "tree int, size int, cluster long, top long")
    while not up.where("up is not null").isEmpty():
        above = up.select("tree", "size", F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        up = kept(up.join(above, ["tree", "size", "up"], "left").select("tree", "size", "cluster", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")))
    return up.select("tree", "size", "cluster", "top")


def placed(edges: DataFrame, sizes: list[int], few: int = SLICE, most: int | None = None) -> DataFrame:
    """(tree, size, top, nodes): points that leave within each chosen cluster, in any number of rows; ``few`` bounds tasks below their own bounds."""
    points, clusters = condensed(spanning_trees(edges, SPAN if few == SLICE else few, most), sizes, few)
    return points.join(chosen(clusters, few).where("top is not null"), ["tree", "size", "cluster"]).select("tree", "size", "top", "nodes")


def density_labels(nodes: DataFrame, edges: DataFrame, sizes: list[int], trees: list[int], few: int = SLICE, most: int | None = None) -> DataFrame:
    """(tree, size, node, cluster) of every node under each tree and least cluster size: the smallest node of its cluster; null for noise."""
    held = kept(placed(edges, sizes, few, most))
    named = kept(held.groupBy("tree", "size", "top").agg(F.min(F.array_min("nodes")).alias("cluster")))
    labels = held.join(named, ["tree", "size", "top"]).select("tree", "size", F.explode("nodes").alias("node"), "cluster")
    asked = F.array(*(F.struct(F.lit(t).alias("tree"), F.lit(s).alias("size")) for t in trees for s in sizes))
    return nodes.select("node", F.explode(asked).alias("_q")).select("_q.*", "node").join(labels, ["tree", "size", "node"], "left")


def density_clusters(df: DataFrame, key: str, vector: str, k: int = 10, min_cluster_size: int = 10, min_samples: int = 5, dims: int | None = 15, seed: int = 42) -> DataFrame:
    """(key, cluster) of every usable vector; null for noise. ``dims``: components after a random projection by ``seed``; None for none."""
    vectors = unit_vectors(df, key, vector)
    vectors = kept(vectors if dims is None else projected(vectors, dims, seed))
    edges = reachability(neighbours(vectors, max(k, min_samples)), [(0, k, min_samples)])
    return density_labels(vectors, edges, [min_cluster_size], [0], most=k * vectors.count()).select(F.col("node").alias(key), "cluster")


def cluster_grid(df: DataFrame, key: str, vector: str, k: tuple[int, ...] = (10, 15), sizes: tuple[int, ...] = (10, 8, 6, 5), samples: tuple[int, ...] = (1, 2, 3), dims: int | None = 15, seed: int = 42, few: int = SLICE) -> DataFrame:
    """(n_neighbors, min_cluster_size, min_samples, n_clusters, noise, sizes, good) of every combination; sizes are the twelve largest.

    ``good``: 6 to 16 clusters, none over 45 % of the points.
    """
    vectors = unit_vectors(df, key, vector)
    vectors = kept(vectors if dims is None else projected(vectors, dims, seed))
    trees = [(i, n, m) for i, (n, m) in enumerate((n, m) for n in k for m in samples)]
    edges, n = reachability(neighbours(vectors, max(*k, *samples)), trees), vectors.count()
    held = placed(edges, list(sizes), few, max(k) * n)
    counted = held.groupBy("tree", "size", "top").agg(F.sum(F.size("nodes")).alias("n"))
    # sums of rows to clusters; only the largest twelve sizes are ever listed
    place = F.row_number().over(Window.partitionBy("tree", "size").orderBy(F.desc("n")))
    found = counted.withColumn("_place", place).groupBy("tree", "size").agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum("n").alias("_held"),
        F.reverse(F.array_sort(F.collect_list(F.when(F.col("_place") <= 12, F.col("n"))))).alias("sizes"),
    )
    asked = edges.sparkSession.createDataFrame([(t, s) for t, _, _ in trees for s in sizes if n], "tree int, size int")
    per = asked.join(found, ["tree", "size"], "left").select("tree", "size", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), (n - F.coalesce("_held", F.lit(0))).alias("noise"), F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes"))
    of_tree = F.element_at(F.array(*(F.struct(F.lit(n).alias("n_neighbors"), F.lit(m).alias("min_samples")) for _, n, m in trees)), F.col("tree") + 1)
    good = F.col("n_clusters").between(6, 16) & (F.coalesce(F.get("sizes", F.lit(0)), F.lit(0)) <= n * 0.45)
    return per.select(of_tree.alias("t"), F.col("size").alias("min_cluster_size"), "n_clusters", "noise", "sizes", good.alias("good")).select("t.n_neighbors", "min_cluster_size", "t.min_samples", "n_clusters", "noise", "sizes", "good")


def seed_stability(df: DataFrame, key: str, vector: str, seeds: tuple[int, ...] = (42, 43, 44), k: int = 10, min_cluster_size: int = 10, min_samples: int = 5, dims: int = 15) -> DataFrame:
    """(seed_a, seed_b, clusters_a, clusters_b, ari) of each pair of projections; noise counts as one label."""
    vectors = kept(unit_vectors(df, key, vector))
    edges = None
    for i, seed in enumerate(seeds):
        own = reachability(neighbours(kept(projected(vectors, dims, seed)), max(k, min_samples)), [(i, k, min_samples)])
        edges = own if edges is None else edges.unionByName(own)
    labels = kept(density_labels(vectors, edges, [min_cluster_size], list(range(len(seeds))), most=k * vectors.count()))
    out: DataFrame | None = None
    for i in range(len(seeds)):
        for j in range(i + 1, len(seeds)):
            a, b = (labels.where(F.col("tree") == t).select("node", F.coalesce("cluster", F.lit(-1)).alias(name)) for t, name in ((i, "a"), (j, "b")))
            both = kept(a.join(b, "node"))
            sizes = both.agg(*(F.count_distinct(F.when(F.col(c) >= 0, F.col(c))).alias(f"clusters_{c}") for c in "ab"))
            row = stats.adjusted_rand(both, "a", "b").join(F.broadcast(sizes)).select(F.lit(seeds[i]).alias("seed_a"), F.lit(seeds[j]).alias("seed_b"), "clusters_a", "clusters_b", "ari")
            out = row if out is None else out.unionByName(row)
    return out
