"""Near copies by the Jaccard similarity of their word shingles, found by SimHash and Golay-code fuzzy hashing (operator 4, wide).

Links: two documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. That is about 0.15 differing
bits in each bit of a SimHash, far more than a search for exact distances can cover. So the signed sums behind the bits take
part: a document gets ``SEGMENTS`` segments of 23 sums, and each is decoded softly to the three codewords of the (23, 12) Golay
code that agree best with the sums, not with their signs alone. Near copies at the threshold share one of their three in about
0.73 of all segments, both of two neighbours in about 0.54. Codeword indices of two neighbouring segments make a key, nine a
pair of segments. The search is probabilistic: about 7 of 100,000 links exactly at the threshold have no common key, and fewer
above it (a test counts such links); a link that is missed is still found where both documents fall into one cluster.

1. Documents with a common key that may link by their first ``64 * SKETCH`` bits and their sizes fall into one cluster. Tasks hand
   on spanning forests of such pairs (``_forest``), so a cluster holds every link of its documents, and no pairs are formed.
2. Each cluster's sets of hashes are brought together, one document for each different set, every set once. A task goes through
   a cluster's documents from one to those it links with, and compares a document exactly, by an index of the cluster's
   shingles, only with documents that are not reached yet.
3. Clusters over ``BLOCK`` documents or ``HASHES`` hashes are cut into parts. Parts are gone through alone, then one document of each
   component found so far, in ever fewer parts; this joins a large group of near copies. Where different components are left,
   the largest is compared with all the others, part by part, and the others with each other, so no link is lost.

Exact copies are one node (a 64-bit hash of the set of hashes) from the first aggregation on. Texts are read again only for
documents in clusters.

Defined cases: texts with fewer words than a shingle's have one shingle of them all; null, empty and blank texts have the
empty set and are copies of each other; A-Z count as a-z; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm import simhash
from assaykit.llm._cluster import keep
from assaykit.llm._components import label_components
from assaykit.llm._forest import forest_links
from assaykit.llm._text import bounded, project

#: Segments of 23 sums, decoded in pairs, and codewords kept of each.
SEGMENTS, BEST = 24, 3
#: Words of 64 sums that hold the segments, and those whose bits are compared.
WORDS, SKETCH = -(-SEGMENTS * 23 // 64), 3
#: Differing bits of the sketch up to which documents fall into one cluster: over six deviations more than links at 0.8 have.
#: Sets of fewer than SMALL hashes have ``MORE``, since sums of few hashes are often zero.
FAR, SMALL, MORE = 62, 16, 12
#: Documents, and hashes of documents, that a task goes through at once.
BLOCK, HASHES = 2048, 1_000_000
#: Texts -> the sorted distinct hashes of each.
Sets = Callable[[list[str | None]], list[np.ndarray]]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(simhash.LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), 42)], np.uint64)
    line, at, ends = b" ".join(parts), -1, []
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([digest(line[a:z], 42) for a, z in zip(starts, ends[words - 1 :], strict=False)], np.uint64))


def signed_sums(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS bits: shingles that have it set less those that have not. Further words come from mixing the hash."""
    n, out = len(hashes), np.zeros((WORDS, 64), np.int64)
    for w in range(WORDS):
        x = hashes * np.uint64(xxhash.xxh64_intdigest(b"", w) | 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(xxhash.xxh64_intdigest(b"", w + 1) | 1)
        x ^= x >> np.uint64(29)
        fields = simhash._spread()[x.view(np.uint8).reshape(n, 8)]
        for k in range(0, n, 255):
            out[w] += np.add.reduce(fields[k : k + 255], axis=0, dtype=np.uint64).view(np.uint8)
    return (2 * out - n).ravel()


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """The 4096 codewords of the Golay code as columns of signs."""
    index, word = np.arange(4096), np.zeros(4096, np.int64)
    for i in range(12):
        word ^= np.where(index >> i & 1, simhash.GENERATOR << i, 0)
    return np.ascontiguousarray(((word[:, None] >> np.arange(23) & 1) * 2 - 1).T.astype(np.float32))


def soft_decode(sums: np.ndarray) -> np.ndarray:
    """(documents, SEGMENTS, BEST) indices of the codewords that agree best with each segment's sums; ties to either."""
    out = np.empty((len(sums), SEGMENTS, BEST), np.int16)
    for k in range(0, len(sums), 1024):
        values = sums[k : k + 1024].astype(np.float32)
        for s in range(SEGMENTS):
            score = values[:, 23 * s : 23 * s + 23] @ codewords()
            for b in range(BEST):
                best = score.argmax(axis=1)
                out[k : k + 1024, s, b] = best
                score[np.arange(len(score)), best] = -np.inf
    return out


def described(df: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(key, th, node, n, s0.., codes) of every row; th is a hash of the text as it is, n the number of different shingles."""
    rows = project(df, **{key: key, "_text": text}).select(key, "_text", F.xxhash64("_text").alias("th"))
    bits = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "_text"):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            sums = np.stack([signed_sums(s) for s in sets])
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets], np.uint64).view(np.int64)
            sketch = np.packbits(sums[:, : 64 * SKETCH] > 0, axis=1).view(">i8").astype(np.int64)
            codes = [c.tobytes() for c in soft_decode(sums)]
            columns = [b.column(0), b.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x) for x in sketch.T), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "th", "node", "n", *bits, "codes"])

    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(f"th long, node long, n long, {', '.join(f'{c} long' for c in bits)}, codes binary").fields])
    return rows.mapInArrow(run, schema)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node, n, s0..): nine keys for each pair of neighbouring segments."""
    names = ["node", "n", *(f"s{i}" for i in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = SEGMENTS // 2
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                codes = np.frombuffer(b"".join(b.column(len(names)).to_pylist()), np.int16).reshape(-1, pairs, 2, BEST).astype(np.int64)
                keys = (np.arange(pairs) << 24)[None, :, None, None] | (codes[:, :, 0, :, None] << 12) | codes[:, :, 1, None, :]
                times = pa.array(np.repeat(np.arange(b.num_rows), pairs * BEST * BEST))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(b.column(i).take(times) for i in range(len(names)))], names=["key", *names])

    return nodes.select(*names, "codes").mapInArrow(run, ", ".join(f"{c} long" for c in ["key", *names]))


def may_link(columns: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes and sketches (n, s0, ..) may have that Jaccard similarity."""
    n, *sketch = columns
    less, more = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    apart = sum(np.bitwise_count((s.view(np.uint64))[i] ^ (s.view(np.uint64))[j]).astype(np.int16) for s in sketch)
    return (less / np.maximum(more, 1) >= similarity) & (apart <= FAR + MORE * (less < SMALL))


def reached(label: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(label, the smallest label that it reaches over links of that similarity), for each label that reaches a smaller one.

    Goes from one set to all that it links with, and from these on. An index lists, for each hash, the sets that are not reached
    yet; it is built anew whenever half of them are.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    names, group = np.unique(label, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    hashes, term = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(term, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[order]
    left = np.ones(len(sets), bool)
    ends = np.append(0, np.cumsum(np.bincount(term, minlength=len(hashes))))
    indexed, u, v = len(sets), [], []
    for g in range(len(names)):
        if not left[members[g][0]]:
            continue
        queue = [members[g]]
        left[members[g]] = False
        while queue:
            for d in queue.pop().tolist():
                rest = int(left.sum())
                if not rest:
                    return np.array(u, np.int64), np.array(v, np.int64)
                if 2 * rest <= indexed:
                    stay = left[owner]
                    term, owner, indexed = term[stay], owner[stay], rest
                    ends = np.append(0, np.cumsum(np.bincount(term, minlength=len(hashes))))
                at, n = ends[own[d]], ends[own[d] + 1] - ends[own[d]]
                where = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                common = np.bincount(owner[where], minlength=len(sets))
                hit = np.flatnonzero(left & (common > 0))
                hit = hit[common[hit] / (sizes[d] + sizes[hit] - common[hit]) >= similarity]
                for other in np.unique(group[hit]).tolist():
                    u.append(names[other])
                    v.append(names[g])
                    left[members[other]] = False
                    queue.append(members[other])
    return np.array(u, np.int64), np.array(v, np.int64)


def linked(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v) for each label u in a block that reaches a smaller one over links within the block; v is the smallest of these.

    rows: (cluster, block, label, hashes), a bounded number in each block.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("cluster", "block", "label", "hashes").repartition(tasks, "cluster", "block").sortWithinPartitions("cluster", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, label, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                u, v = reached(np.array(label), sets, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            for cluster, block, own, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (cluster, block) != now:
                    yield from links()
                    now, label, sets = (cluster, block), [], []
                label.append(own)
                sets.append(np.frombuffer(blob, np.int64))
        yield from links()

    return dealt.mapInArrow(run, "u long, v long")


def relabelled(rows: DataFrame, to: DataFrame) -> DataFrame:
    """rows, whose ``label`` is now what ``to``, with two columns, gives for theirs."""
    to = to.toDF("_at", "_to")
    return rows.join(to, rows["label"] == to["_at"], "left").withColumn("label", F.coalesce("_to", "label")).drop("_at", "_to")


def sets_of(clusters: DataFrame, nodes: DataFrame, df: DataFrame, sets: Sets, key: str, text: str) -> DataFrame:
    """(node, cluster, hashes) of the nodes in ``clusters``, from one of each node's texts."""
    wanted = keep(clusters.join(nodes, "node").select("node", "cluster", F.col("doc.key").alias("_key"), F.col("doc.th").alias("_th")))
    few = F.broadcast(wanted) if wanted.count() <= simhash.FEW else wanted
    rows = project(df, **{key: key, "_text": text})
    rows = rows.join(few, rows[key].eqNullSafe(few["_key"]) & (F.xxhash64("_text") == few["_th"])).select("node", "cluster", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "_text"):
            blobs = [x.tobytes() for x in sets(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], names=["node", "cluster", "hashes"])

    return rows.mapInArrow(run, "node long, cluster long, hashes binary")


def dealt_in_parts(rows: DataFrame) -> DataFrame:
    """rows with ``parts`` of their cluster, and the ``block`` that is theirs."""
    size = rows.groupBy("cluster").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("hashes")) / (8 * HASHES))).alias("parts"))
    return rows.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))


def across(rows: DataFrame) -> DataFrame:
    """rows of clusters with several labels, in blocks that hold every pair of nodes with different labels together: the largest
    label's parts against the others' parts, and these against each other."""
    by_label = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("hashes")).alias("bytes"))
    by_cluster = by_label.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    sides = by_label.join(by_cluster.where("labels > 1"), "cluster").groupBy("cluster", "main", (F.col("label") == F.col("main")).alias("large"))
    parts = sides.agg(F.greatest(F.ceil(2 * F.sum("n") / BLOCK), F.ceil(F.sum("bytes") / (4 * HASHES))).alias("p"))
    parts = parts.groupBy("cluster", "main").agg(*(F.max(F.when(side, F.col("p"))).alias(name) for side, name in ((F.col("large"), "of_main"), (~F.col("large"), "of_rest"))))
    met = rows.join(parts, "cluster")
    large = F.col("label") == F.col("main")
    mine = F.pmod(F.xxhash64("node"), F.when(large, F.col("of_main")).otherwise(F.col("of_rest")))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    # block numbers: rest's part times main's parts plus main's part; those of two parts of the rest are below zero
    with_rest = F.transform(upto("of_rest"), lambda o: o * F.col("of_main") + mine)
    with_main = F.transform(upto("of_main"), lambda m: mine * F.col("of_main") + m)
    each_other = F.transform(F.filter(upto("of_rest"), lambda o: o != mine), lambda o: -1 - (F.least(mine, o) * F.col("of_rest") + F.greatest(mine, o)))
    return met.withColumn("block", F.explode(F.when(large, with_rest).otherwise(F.concat(with_main, each_other))))


def within_clusters(clusters: DataFrame, nodes: DataFrame, df: DataFrame, sets: Sets, similarity: float, key: str, text: str) -> DataFrame:
    """(node, label) of the nodes in ``clusters`` (node, cluster): those that links of that similarity join share a label.

    nodes: (node, doc: the key and the hash of one of its texts in df). ``sets`` gives the hashes of texts.
    """
    rows_of = keep(sets_of(clusters, nodes, df, sets, key, text).dropDuplicates(["node"]))
    rows = dealt_in_parts(rows_of.withColumn("label", F.col("node")))
    labels = keep(relabelled(rows, keep(linked(rows, similarity))).select("node", "cluster", "label", "parts"))
    large = labels.where("parts > 1")
    parts, before = large.agg(F.max("parts")).first()[0], None
    if parts:
        hot = keep(large.select("node", "label").join(rows_of, "node"))
        while parts > 1 and (before is None or parts <= before / 2):
            ones = keep(dealt_in_parts(hot.where(F.col("node") == F.col("label"))))
            hot = keep(relabelled(hot, keep(linked(ones, similarity))))
            before, parts = parts, ones.agg(F.max("parts")).first()[0]
        hot = relabelled(hot, label_components(linked(across(hot), similarity)))
        labels = keep(labels.where("parts = 1").select("node", "label").unionByName(hot.select("node", "label")))
    return labels


def near_copy_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node, th, component_id) of every row, th being a hash of its text: documents reachable over links of that similarity share a component, named by
    its smallest key. ``similarity`` of 0.8 or more: the keys are made for that."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("the keys find links of a similarity from 0.8 to 1")
    docs = keep(described(df, words, key, text))
    first = [F.first(c).alias(c) for c in ("n", *(f"s{i}" for i in range(SKETCH)), "codes")]
    nodes = keep(docs.groupBy("node").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "th")).alias("doc"), *first))
    clusters = label_components(forest_links(keyed(nodes), lambda columns, i, j: may_link(columns[1:], i, j, similarity)))
    labels = within_clusters(clusters.withColumnRenamed("label", "cluster"), nodes, df, lambda texts: [shingle_set(t, words) for t in texts], similarity, key, text)
    of_sets = labels.select("node", F.col("label").alias("_label"))
    final = keep(nodes.select("node", "doc").join(of_sets, "node", "left").select("node", F.coalesce("_label", "node").alias("_label"), F.col("doc.key").alias("_least")))
    least = keep(final.groupBy("_label").agg(F.min("_least").alias("component_id")))  # kept: the join then stands on exchanges
    named = keep(final.join(least, "_label").select("node", "component_id"))
    return docs.select(key, "node", "th").join(named, "node").select(key, "node", "th", "component_id")


def drop_near_copies(df: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose key is the smallest of their component; every column stays. Of repeated rows one stays."""
    return simhash.keep_least(df, keep(near_copy_groups(df, words, similarity, key, text)), key, text)
