"""SimHash near-duplicate groups by Golay-code fuzzy hashing (operator 4).

A document's fingerprint has bit i set if more than half of its word shingles' 64-bit hashes have it set. Two fingerprints
link if at most ``bits`` (4) bits differ; documents are grouped by what is reachable over links.

Finding all links: the 64 bits are cut into three segments, each padded to a word of the perfect (23, 12) Golay code. Of four
differing bits at most two fall outside the segment that has most of them, so some pair of segments differs in two bits
altogether. Two words that differ in up to two bits share a codeword at distance four or less, and a word has one (nearest at
distance 0 to 2) or six such codewords (nearest at distance 3). So each fingerprint gets keys from the codeword indices of
each pair of segments, and linked fingerprints share at least one. Fingerprints that share a key are compared bit by bit; each
task gives a spanning forest of the links it finds, never all pairs of a group (``_forest``).

Work is done on distinct fingerprints: exact copies meet in an aggregation. Labels spread over links by minima and pointer
jumping, with each round checkpointed in the shared folder; nothing of all documents comes to the driver.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; fewer words than a shingle's give one
shingle of them all; repeated rows link; a component's id is the smallest key in it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._cluster import keep
from assaykit.llm._components import label_components
from assaykit.llm._forest import forest_links
from assaykit.llm._text import bounded, project

#: The Golay code's generator polynomial, and the width of the segments of a fingerprint.
GENERATOR = 0b101011100011
WIDTHS = (21, 21, 22)
#: Keys of dropped rows that are broadcast at most.
FEW = 2_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=1)
def _spread() -> np.ndarray:
    """For each byte, a number with its bits in eight fields of eight bits each, highest first."""
    return np.array([sum((b >> (7 - i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) <= words:
        h = xxhash.xxh64_intdigest(b" ".join(parts), 42)
        return h - (1 << 64) if h >> 63 else h
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:z], 42) for a, z in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)])
    n = len(hashes) // 8
    fields = _spread()[np.frombuffer(hashes, np.uint8).reshape(n, 8)]
    total = np.zeros(64, np.int64)
    for k in range(0, n, 255):  # fields of eight bits hold 255 at most
        total += np.add.reduce(fields[k : k + 255], axis=0, dtype=np.uint64).view(np.uint8).reshape(8, 8).ravel()
    return int(np.packbits(2 * total > n).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """(key, fp long) of every whole text; ``hashed`` adds th, a hash of the text as it is."""
    rows = project(df, **{key: key, "_text": text})
    more = ["th"] if hashed else []
    if hashed:
        rows = rows.withColumn("th", F.xxhash64("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64()), *b.columns[2:]], names=[key, "fp", *more])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], *(T.StructField(n, T.LongType(), False) for n in ("fp", *more))]))


def remainder(word: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words."""
    word = word.copy()
    for i in range(22, 10, -1):
        word ^= np.where(word >> i & 1, GENERATOR << (i - 11), 0)
    return word


@lru_cache(maxsize=1)
def nearby() -> np.ndarray:
    """For each syndrome, what to flip in a word's index to get those of its codewords at distance four or less; -1: none."""
    out = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(remainder(errors).tolist(), (errors >> 11).tolist(), strict=True):
            out[s, used[s]] = e
            used[s] += 1
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, and the number of the fingerprint that each belongs to; no key twice for one."""
    table, at, found = nearby(), 0, []
    for width in WIDTHS:
        word = (fps.astype(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
        flips = table[remainder(word)]
        found.append(np.where(flips >= 0, (word >> 11)[:, None] ^ flips, -1))
        at += width
    keys, rows = [], []
    for family, (a, b) in enumerate(combinations(range(len(WIDTHS)), 2)):
        x, y = found[a][:, :, None], found[b][:, None, :]
        row, i, j = np.nonzero((x >= 0) & (y >= 0))
        keys.append(family << 24 | found[a][row, i] << 12 | found[b][row, j])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(u, v): links whose components are those of all pairs of fingerprints that differ in at most ``bits`` (4 at most) bits."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys find all pairs for up to four differing bits")

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for k in range(0, len(fps), 4096):
                keys, rows = golay_keys(fps[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[k : k + 4096][rows])], names=["key", "node"])

    def near(columns: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fps = columns[0].view(np.uint64)
        return np.bitwise_count(fps[i] ^ fps[j]) <= bits

    keyed = distinct.select("fp").mapInArrow(to_keys, "key long, node long")
    return forest_links(keyed, near)


def near_duplicate_groups(df: DataFrame, bits: int = 4, words: int = 4, key: str = "doc_id", text: str = "text", hashed: bool = False) -> DataFrame:
    """(key, fp long, component_id) of every row; ``hashed`` adds th, a hash of its text."""
    docs = keep(fingerprints(df, words, key, text, hashed))
    nodes = keep(docs.groupBy("fp").agg(F.min(key).alias("_least")))
    edges = keep(links(nodes, bits))
    labels = label_components(edges)  # only fingerprints with links
    named = nodes.join(labels.withColumnsRenamed({"node": "fp"}), "fp", "left").select("fp", "_least", F.coalesce("label", "fp").alias("_label"))
    named = keep(named)
    least = keep(named.groupBy("_label").agg(F.min("_least").alias("component_id")))
    by_fp = keep(named.join(least, "_label").select("fp", "component_id"))
    return docs.join(by_fp, "fp").select(key, "fp", *(["th"] if hashed else []), "component_id")


def drop_near_duplicates(df: DataFrame, bits: int = 4, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose key is the smallest of their group; every column stays.

    Only keys and fingerprints take part in the grouping. The keys that go are broadcast up to ``FEW`` of them; beyond that
    they meet the rows by a shuffle. Of repeated rows (same key, or no key, and same text) one stays.
    """
    return keep_least(df, keep(near_duplicate_groups(df, bits, words, key, text, hashed=True)), key, text)


def keep_least(df: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of df whose key is their component_id in ``groups``, which has a row for each of them, with th, a hash of its text:
    different texts may share a key, and only those go that have a copy."""
    gone = keep(groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone"), F.col("th").alias("_th")).distinct())
    same = (df[key] == gone["_gone"]) & (F.xxhash64(df[text]) == gone["_th"])
    kept = df.join(F.broadcast(gone) if gone.count() <= FEW else gone, same, "left_anti")
    lost = groups.where(F.col(key).isNull() & F.col("component_id").isNotNull()).count()
    again = keep(groups.groupBy(key).count().where("count > 1").select(F.col(key).alias("_again")))
    if again.count() + lost == 0:
        return kept
    some = F.broadcast(again) if again.count() <= FEW else again
    same = kept[key].eqNullSafe(again["_again"])
    return kept.join(some, same, "left_anti").unionByName(kept.join(some, same, "left_semi").dropDuplicates([key, text]))
