"""Documents whose sets of word shingles have a high Jaccard similarity, found exactly by pigeonholes (operator 12).

Two linked sets differ in at most ``differing`` shingles, so their sizes say in how many. Sizes are cut into bands such that a set links
only within its own and the next band, and each band has one scheme for the pairs whose smaller set is in it. A scheme hashes the
universe of shingles into segments. Of a pair that differs in ``most`` shingles at most, some segment holds the same subset, or subsets one
shingle apart where the segment also has its one-deletion neighbourhood (the subset, and the subset less each of its shingles): a segment
that does not agree has used up one difference, or two. So with ``near`` neighbourhoods and any number of plain segments, all but
``most - 2 * near`` plain subsets agree, and it is enough that every set gives the ``most - 2 * near + 1`` of its plain subsets that come
first in one order for all sets: larger ones first, since small and empty ones are the ones that strangers share.

How many segments of either kind a scheme has (``allocate``) is what costs least by the number of its sets and the chance that a
shingle of one is in another, both counted over all different sets, the latter on the shingles with one of ``SAMPLED`` hashes.
No allocation loses a pair; they differ in rows moved and in pairs looked at.

1. Keys and sets' ids meet in one shuffle; only keys that different sets share go on. Copies of a set are one from then on.
2. Sets that share a key, whose sizes allow a link and whose odd sketches (a bit for each of 256 classes of hashes: the parity of the
   set's shingles in it) are no further apart than the sets may be, fall into one cluster (``_forest``). The sketch's distance is never above the sets' own.
3. Clusters are gone through exactly, as by operator 4's wide search (``nearcopies.within_clusters``): every set moves once, no pairs are formed.

Defined cases: A-Z count as a-z; with fewer words than a shingle's the whole sequence is the one shingle; null, empty and blank
texts have the empty set and link with nothing, not even each other. Repeated rows are copies. A null key is never a component's
name unless all its keys are null. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm import nearcopies, simhash
from assaykit.llm._bpe import INVERSE, POWER, powers
from assaykit.llm._cluster import keep
from assaykit.llm._components import label_components
from assaykit.llm._forest import forest_links
from assaykit.llm._text import bounded, project

#: One in so many shingles, by hash, is counted to learn how often strangers share them.
SAMPLED = 1024
#: Words of 64 bits of the odd sketch.
SKETCH = 4
#: Sets whose keys a task remembers to have given.
SEEN = 500_000
#: What looking at a pair costs, in rows moved.
PAIR = 2.0
SEPARATOR = np.isin(np.arange(256), [32, *range(9, 14)])


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit numbers without their order."""
    x = (x ^ np.uint64(xxhash.xxh64_intdigest(b"", seed))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def of_byte() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64), 7)


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every text's shingles, sorted, one text after the other, and where each text's begin and end."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    line = np.frombuffer((b" ".join(raw) + b" ").translate(simhash.LOWER), np.uint8)
    inside = ~SEPARATOR[line]
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = 1 << max(10, len(line).bit_length())
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(of_byte()[line] * powers(POWER, n)[: len(line)], dtype=np.uint64)))
    word = mixed((total[stop] - total[first]) * powers(INVERSE, n)[first] + (stop - first).astype(np.uint64), 11)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    owner = np.searchsorted(begins, first, side="right") - 1
    held = np.bincount(owner, minlength=len(texts))
    at = np.cumsum(held) - held
    full = np.flatnonzero(owner[words - 1 :] == owner[: len(owner) - words + 1]) if len(owner) >= words else np.zeros(0, np.int64)

    def joined(start: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(start), size, np.uint64)
        for k in range(size):
            out = mixed(out * np.uint64(POWER) + word[start + k], 13)
        return out

    hashes, owners = [joined(full, words)], [owner[full]]
    for size in range(1, words):
        few = np.flatnonzero(held == size)
        hashes.append(joined(at[few], size))
        owners.append(few)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[fresh], np.searchsorted(o[fresh], np.arange(len(texts) + 1))


def nodes_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each different set."""
    return np.array([xxhash.xxh64_intdigest(hashes[a:z].tobytes(), 1) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def differing(one, other, share: int):
    """Differences that two sets of these sizes have at most if ``share`` in 100 of their union are common."""
    total = one + other
    return total - 2 * (-(-share * total // (100 + share)))


def most_differing(least: int, share: int) -> int:
    """The same for a set of this size and any that is as large or larger."""
    top = 100 * least // share
    return max(differing(least, top, share), differing(least, max(top - 1, least), share))


@lru_cache(maxsize=4)
def bands(share: int) -> tuple[int, ...]:
    """First sizes of bands, from the smallest set that links with another one."""
    at = next((n for n in range(1, 10_000) if most_differing(n, share) > 0), 1 << 40)
    out = [at]
    while out[-1] < 1 << 40:
        out.append(100 * out[-1] // share + 1)
    return tuple(out)


@lru_cache(maxsize=4)
def band_most(share: int) -> tuple[int, ...]:
    """Differences of a band's pairs at most."""
    starts = bands(share)
    return tuple(max(most_differing(z - 1, share), most_differing(max(z - 2, a), share)) for a, z in zip(starts, starts[1:]))


def allocate(most: int, size: float, sets: int, chance: float) -> tuple[int, int]:
    """(plain segments, segments with neighbourhoods) of the least cost.

    Costs are rows moved, and pairs of unrelated sets that agree somewhere; a shingle of one is in the other with that chance.
    """
    options = []
    chance = min(max(chance, 1e-12), 0.5)
    for near in {n for n in (0, 1, 2, (most + 2) // 2 if most <= 3 else 0) if 2 * n <= most + 2}:
        given = max(0, most + 1 - 2 * near)
        for spare in {0} if not given else {0, 1, 2, *(-(-given * k // 8) for k in (1, 2, 3, 4, 6))}:
            plain = given + spare
            mean = size / (plain + near)
            top = int(mean + 8 * math.sqrt(mean) + 12)
            odds = np.exp(np.array([k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(top)]))
            k = np.arange(top)
            agree, left = 0.0, float(given)
            for n in k[::-1]:  # the largest plain subsets are given
                take = min(left, plain * odds[n])
                agree += take * chance**n
                left -= take
            agree += near * float((odds * np.minimum(1, (1 + k) * chance ** np.maximum(k - 1, 0))).sum())
            rows = given + near * (1 + mean)
            options.append((sets * rows + PAIR * sets * max(sets - 1, 0) / 2 * min(1.0, agree), near, plain))
    _, near, plain = min(options)
    return plain, near


def segment_keys(hashes: np.ndarray, at: np.ndarray, schemes: np.ndarray, most: np.ndarray, plain: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, key): keys of sets, each under one scheme. A unit is a set at ``at`` with its scheme and the scheme's numbers."""
    sizes = np.diff(at)
    width = plain + near
    base = np.cumsum(width) - width
    unit = np.repeat(np.arange(len(sizes)), sizes)
    segment = ((mixed(hashes, 17) >> np.uint64(20)) % width[unit].astype(np.uint64)).astype(np.int64)
    group, value = base[unit] + segment, mixed(hashes, 19)
    slots = int(width.sum())
    held = np.bincount(group, minlength=slots)
    low = np.bincount(group, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), slots)  # both sums are exact
    high = np.bincount(group, (value >> np.uint64(32)).astype(np.float64), slots)
    whole = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
    of = np.repeat(np.arange(len(sizes)), width)
    place = np.arange(slots) - base[of]
    salt = mixed(schemes[of].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64), 23)
    wide = place < near[of]  # the first segments of a scheme have neighbourhoods
    keys = mixed(whole ^ salt, 29)
    some = np.flatnonzero(~wide)
    order = some[np.lexsort((keys[some], -held[some], of[some]))]
    before = np.searchsorted(of[order], np.arange(len(sizes)))
    given = order[np.arange(len(order)) - before[of[order]] < np.maximum(0, most + 1 - 2 * near)[of[order]]]
    less = np.flatnonzero(wide[group])
    shorter = mixed((whole[group[less]] - value[less]) ^ salt[group[less]], 29)
    every = np.flatnonzero(wide)
    return np.concatenate((of[given], of[every], unit[less])), np.concatenate((keys[given], keys[every], shorter)).view(np.int64)


def described(df: DataFrame, words: int, share: int, key: str, text: str) -> DataFrame:
    """(key, th, node, n, band, s0.., sampled) of every row; th is a hash of the text as it is, n the size of its set."""
    rows = project(df, **{key: key, "_text": text}).select(key, "_text", F.xxhash64("_text").alias("th"))
    bits = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(bands(share))
        for b in bounded(batches, "_text"):
            hashes, at = shingle_sets(b.column(1).to_pylist(), words)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n)), n)
            odd = np.bincount(owner * (64 * SKETCH) + (hashes >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=len(n) * 64 * SKETCH) & 1
            sketch = np.packbits(odd.astype(np.uint8).reshape(len(n), -1), axis=1).view(">i8").astype(np.int64)
            some = np.flatnonzero(mixed(hashes, 31) % np.uint64(SAMPLED) == 0)
            sampled = pa.ListArray.from_arrays(np.searchsorted(owner[some], np.arange(len(n) + 1)).astype(np.int32), pa.array(hashes[some].view(np.int64)))
            band = np.searchsorted(starts, n, side="right").astype(np.int32) - 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes_of(hashes, at)), pa.array(n), pa.array(band), *(pa.array(x) for x in sketch.T), sampled], names=[key, "th", "node", "n", "band", *bits, "sampled"])

    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(f"th long, node long, n long, band int, {', '.join(f'{c} long' for c in bits)}, sampled array<long>").fields])
    return rows.mapInArrow(run, schema)


def allocations(nodes: DataFrame, share: int) -> dict[int, tuple[int, int]]:
    """(plain, near) of each band's scheme, from counts over all different sets; the driver gets one row for each band."""
    sized = nodes.where("band >= 0").groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.avg("n").alias("size"))
    met = nodes.where("band >= 0").select("band", F.explode("sampled").alias("shingle")).groupBy("band", "shingle").agg(F.count(F.lit(1)).cast("double").alias("c"))
    met = met.groupBy("band").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("twice"))
    out = {}
    for r in sized.join(met, "band", "left").collect():
        pairs = max(1.0, r["sets"] * (r["sets"] - 1.0)) * r["size"]
        out[r["band"]] = allocate(band_most(share)[r["band"]], r["size"], r["sets"], SAMPLED * (r["twice"] or 0.0) / pairs)
    return out


def keyed(df: DataFrame, schemes: dict[int, tuple[int, int]], words: int, share: int, text: str) -> DataFrame:
    """(key, node) of all rows' sets under their own band's scheme and, where they can be a pair's larger set, the band before's."""
    rows = project(df, _text=text).where("_text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, limit, seen = np.array(bands(share)), np.array(band_most(share)), set()
        plain, near = np.ones(len(limit), np.int64), np.zeros(len(limit), np.int64)
        used = np.zeros(len(limit), bool)
        for k, (p, w) in schemes.items():
            plain[k], near[k], used[k] = p, w, True
        for b in bounded(batches, "_text"):
            hashes, at = shingle_sets(b.column(0).to_pylist(), words)
            n, node = np.diff(at), nodes_of(hashes, at)
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.array([not (x in seen or seen.add(x)) for x in node.tolist()], bool)  # copies in a task give their keys once
            band = np.searchsorted(starts, n, side="right") - 1
            own = np.flatnonzero(fresh & (band >= 0))
            larger = own[(band[own] > 0) & (share * n[own] <= 100 * (starts[band[own]] - 1))]
            larger = larger[used[band[larger] - 1]]
            sets, scheme = np.concatenate((own, larger)), np.concatenate((band[own], band[larger] - 1))
            if not len(sets):
                continue
            size = n[sets]
            to = np.concatenate(([0], np.cumsum(size)))
            flat = hashes[np.arange(to[-1]) - np.repeat(to[:-1] - at[sets], size)]
            unit, key = segment_keys(flat, to, scheme, limit[scheme], plain[scheme], near[scheme])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[sets][unit])], names=["key", "node"])

    return rows.mapInArrow(run, "key long, node long")


def shared(rows: DataFrame) -> DataFrame:
    """The different rows of (key, node) whose key has several nodes."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None  # the last row so far, and whether it has been given

        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last is not None:
                key, node = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], node))
            same = key[1:] == key[:-1]
            fresh = np.concatenate(([True], ~same | (node[1:] != node[:-1])))
            key, node = key[fresh], node[fresh]
            same = key[1:] == key[:-1]
            give = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            given = last is not None and last[2]
            if given:
                give[0] = False
            now = bool(give[-1]) or (len(key) == 1 and given)
            last = (int(key[-1]), int(node[-1]), now)
            yield pa.RecordBatch.from_arrays([pa.array(key[give]), pa.array(node[give])], names=["key", "node"])

    return dealt.mapInArrow(run, "key long, node long")


def may_link(columns: list[np.ndarray], i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
    """Whether sets of these sizes and odd sketches (n, s0, ..) can have that similarity; never says no to sets that have it."""
    n, *sketch = columns
    apart = sum(np.bitwise_count(s.view(np.uint64)[i] ^ s.view(np.uint64)[j]).astype(np.int64) for s in sketch)
    return (100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])) & (apart <= differing(n[i], n[j], share))


def jaccard_groups(df: DataFrame, words: int = 4, share: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: rows reachable over links share a component, named by its smallest key.

    Two sets link if at least ``share`` in 100 of their union's shingles are common; share is from 50 to 100.
    """
    if not 50 <= share <= 100:
        raise ValueError("share must be from 50 to 100")
    docs = keep(described(df, words, share, key, text))
    first = [F.first(c).alias(c) for c in ("n", "band", *(f"s{i}" for i in range(SKETCH)), "sampled")]
    doc = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "th")).alias("doc")
    nodes = keep(docs.where("n > 0").groupBy("node").agg(doc, *first))
    labels = None
    if share < 100:
        met = keep(shared(keyed(df, allocations(nodes, share), words, share, text)))
        rows = met.join(nodes.select("node", "n", *(f"s{i}" for i in range(SKETCH))), "node").select("key", "node", "n", *(f"s{i}" for i in range(SKETCH)))
        clusters = label_components(forest_links(rows, lambda columns, i, j: may_link(columns[1:], i, j, share)))

        def sets(texts: list[str | None]) -> list[np.ndarray]:
            hashes, at = shingle_sets(texts, words)
            return np.split(hashes, at[1:-1])

        labels = nearcopies.within_clusters(clusters.withColumnRenamed("label", "cluster"), nodes, df, sets, share / 100, key, text)
    named = nodes.select("node", F.col("doc.key").alias("_least"))
    named = named.withColumn("_label", F.col("node")) if labels is None else named.join(labels.select("node", F.col("label").alias("_label")), "node", "left").withColumn("_label", F.coalesce("_label", "node"))
    named = keep(named)
    least = keep(named.groupBy("_label").agg(F.min("_least").alias("component_id")))  # kept: the joins then stand on exchanges
    named = keep(named.join(least, "_label").select("node", "component_id"))
    linked = docs.where("n > 0").select(key, "node", "n").join(named, "node").select(key, F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(docs.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))
