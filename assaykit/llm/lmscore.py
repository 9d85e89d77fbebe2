"""Cross-entropy difference of two matched n-gram models (operator 3).

A target model and a background model, both interpolated bigram models with the same vocabulary, order and weights, give each
token of a document its loss; the document's score is the mean difference, target less background: the lower, the more it
reads like the target texts. The vocabulary is every word of both sides; only a word that no text of the fit has is unknown.
Every bigram that one side has ``LEAST`` times or more is kept, at every size; the rest is left to unigrams.

What is counted grows with the corpus and is never gathered in one place. Each occurrence of a bigram is shuffled once, with its
document, to a bucket that counts it and adds its term to the document's sums (`differences`; `score` sends the occurrences of
the fit and those of the scored rows to the same buckets). Words with at least a share ``WORD_SHARE`` of all tokens are common:
their counts are broadcast, and they take small numbers. The bucket is that of the bigram if both of its words are common, and
that of the other word if one is, so that all counts which a term needs meet there. With two rare words it is that of the second;
a kept one then goes on to the bucket of the first, for its count. Bigrams of two words with a share ``PAIR_SHARE`` each are
counted first and never shuffled, so that no bucket has a hot key; both shares bound what is broadcast, not what is counted.

Occurrences travel in blocks: the columns of one chunk of a task's texts that go to one bucket, in the order of keys, compressed.
Rare words are named by 64-bit hashes; two of 10^9 meet with a chance of about 0.03.

Defined cases: a null, empty or blank text has no token and scores 0; with no text on one side its model is uniform over the
vocabulary; repeated rows count as often as they occur; a row whose flag is null is background.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._cluster import new_dir
from assaykit.llm._text import bounded, project

WORD_SHARE, PAIR_SHARE = 2.0**-16, 2.0**-10
#: Times that one side must have a bigram.
LEAST = 2
#: Weight of bigrams against unigrams, and what is added to each unigram count.
BIGRAM, ADDED = 0.6, 0.1
#: Different words whose hashes a task keeps.
HELD = 400_000
#: Tokens of a chunk; occurrences of a bucket, and documents' sums that a task holds, on average at most.
CHUNK, BUCKET, OWED = 1 << 20, 1_500_000, 1_000_000
#: What stands before a text's first word.
START = -1
#: Documents of a chunk, as bits of a row's number.
LINES = 20
#: Kinds of rows: documents; counts of rare words; bigrams of two rare words on their way to the first; sums of a chunk's documents; occurrences, whose key is the bigram, the second word, the first word.
DOCUMENT, COUNTS, PENDING, SUMS, COMMON, SECOND, FIRST = range(7)


@dataclass
class Tables:
    """What every task has: hashes of common words, frequent ones first; side x word counts; bigrams' losses among the first ``top`` of them; denominators of unigrams."""

    names: np.ndarray
    counts: np.ndarray
    top: int
    pairs: np.ndarray  # side x (top * before + word)
    whole: np.ndarray

    def unigram(self, n: np.ndarray, side: int) -> np.ndarray:
        return (1 - BIGRAM) * (n + ADDED) / self.whole[side]

    def loss(self, pair: np.ndarray, before: np.ndarray, word: np.ndarray, side: int) -> np.ndarray:
        """What a bigram adds to its word's loss, by the counts of one side."""
        return -np.log1p(BIGRAM * pair / np.maximum(before, 1) / self.unigram(word, side))


@dataclass
class Models:
    """Both models: the texts and their sides, counts of words, and what tasks share. Bigrams are counted where they are used."""

    rows: DataFrame  # _key, _text, _side
    counts: DataFrame  # id, n0, n1: words by hash
    tables: Tables
    tokens: int

    @property
    def words(self) -> list[str]:
        """The whole vocabulary, for looking at small models."""

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bounded(batches, "_text"):
                yield pa.RecordBatch.from_arrays([pa.array({w for t in b.column(0).to_pylist() for w in tokens(t)}, pa.string())], names=["item"])

        return [r["item"] for r in self.rows.select("_text").mapInArrow(found, "item string").distinct().orderBy("item").collect()]


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Ids(dict):
    """Numbers of common words, 64-bit hashes of the others."""

    def __init__(self, names: np.ndarray | None = None) -> None:
        self.common = {} if names is None else {int(h): i for i, h in enumerate(names)}

    def __missing__(self, w: str) -> int:
        if len(self) >= HELD:
            self.clear()
        h = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        self[w] = n = self.common.get(h, h)
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits of each number."""
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def placed(number: Callable, start: int, texts: list[str | None], *more: Iterator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts' words, the number before each, and each text's length."""
    parts = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    word = np.fromiter(map(number, chain.from_iterable(parts), *more), np.int64, int(sizes.sum()))
    before = np.concatenate(([np.int64(start)], word[:-1])) if len(word) else word
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    return word, before, sizes


def numbers(ids: Ids, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return placed(ids.__getitem__, ids.common.get(START, START), texts)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def spans(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Where each run starts and ends."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=False))


def totals(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else x[:0]


def packed(x: np.ndarray) -> bytes:
    """Integers, byte by byte, so that small ones take little room."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view(np.int64).reshape(n)


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.int64(0)))


def unpacked_sorted(x: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(x, n))


def flagged(df: DataFrame, target: str, key: str, text: str) -> DataFrame:
    return project(df, _key=key, _text=text, _target=target).select("_text", F.coalesce(F.col("_target").cast("boolean"), F.lit(False)).cast("int").alias("_side"), "_key")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n0, n1) of words; the number of texts stands at START. Rows with an item and no count spell words that are frequent in some batch, as each that is frequent in all texts must be."""
    ids, held, spelt = Ids(), [], {}

    def flush() -> pa.RecordBatch:
        word, side = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(word)
        word, side = word[order], side[order]
        at = runs(word)
        n, n1 = np.diff(np.append(at, len(word))), totals(side, at)
        return pa.RecordBatch.from_arrays([pa.array(word[at]), pa.nulls(len(at), pa.string()), pa.array(n - n1), pa.array(n1)], names=["id", "item", "n0", "n1"])

    def spell(word: np.ndarray, texts: list[str | None], sizes: np.ndarray) -> None:
        unique, first, n = np.unique(word, return_index=True, return_counts=True)
        ends = np.cumsum(sizes)
        for h, at in zip(*(x[n >= len(word) * PAIR_SHARE].tolist() for x in (unique, first)), strict=True):
            if h not in spelt:
                line = int(np.searchsorted(ends, at, side="right"))
                spelt[h] = tokens(texts[line])[at - int(ends[line] - sizes[line])]

    size = 0
    for b in bounded(batches, "_text"):
        word, _, sizes = numbers(ids, texts := b.column(0).to_pylist())
        spell(word, texts, sizes)
        side = b.column(1).to_numpy().astype(np.int64)
        held.append((np.concatenate((word, np.full(len(sizes), START))), np.concatenate((np.repeat(side, sizes), side))))
        size += len(held[-1][0])
        if size >= 2 * CHUNK:
            yield flush()
            size = 0
    if held:
        yield flush()
    none = pa.array(np.zeros(len(spelt), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(spelt.keys(), pa.int64()), pa.array(spelt.values(), pa.string()), none, none], names=["id", "item", "n0", "n1"])


def fit(df: DataFrame, target: str, key: str = "doc_id", text: str = "text") -> Models:
    """Counts every row of df; ``target`` is a boolean column that tells the two sides apart."""
    rows, spark = flagged(df, target, key, text), df.sparkSession
    path = new_dir(spark, "words")
    found = rows.select("_text", "_side").mapInArrow(_count_words, "id long, item string, n0 long, n1 long")
    found.groupBy("id", "item").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).write.parquet(path)
    found = spark.read.schema("id long, item string, n0 long, n1 long").parquet(path)
    counts = found.where("item is null").select("id", "n0", "n1")
    starts, counts = counts.where(F.col("id") == START), counts.where(F.col("id") != START)
    vocabulary, *total = counts.agg(F.count("*"), *(F.coalesce(F.sum(n), F.lit(0)) for n in ("n0", "n1"))).first()
    often = counts.where(F.col("n0") + F.col("n1") >= F.lit(float(sum(total)) * WORD_SHARE)).union(starts).collect()  # at most 1 / WORD_SHARE rows and START's
    often = [tuple(map(int, r)) for r in often] or [(START, 0, 0)]
    frequent = {r[0] for r in often if r[1] + r[2] >= max(1.0, sum(total) * PAIR_SHARE)}  # at most 1 / PAIR_SHARE and START
    spelt = {r["id"]: r["item"] for r in found.where(F.col("item").isNotNull() & F.col("id").isin(sorted(frequent))).select("id", "item").collect()}
    frequent &= spelt.keys() | {START}
    named = np.array(sorted(often, key=lambda r: (r[0] not in frequent, -r[1] - r[2], r[0])), np.int64).T
    top = len(frequent)
    tables = Tables(named[0], named[1:].astype(float), top, np.zeros((2, top * top)), np.array(total, float) + ADDED * (vocabulary + 1))
    if top:
        places = {h: i for i, h in enumerate(named[0, :top].tolist())}
        start, places = places.get(START, -1), {w: places[h] for h, w in spelt.items()}

        def count_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, top * top), np.int64)
            for b in bounded(batches, "_text"):
                word, before, sizes = placed(places.get, start, b.column(0).to_pylist(), repeat(-1))
                hit = (word >= 0) & (before >= 0)
                at, side = before[hit] * top + word[hit], np.repeat(b.column(1).to_numpy(), sizes)[hit]
                for s in (0, 1):
                    np.add.at(n[s], at[side == s], 1)
            some = np.flatnonzero(n.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[0][some], n[1][some])], names=["at", "n0", "n1"])

        pairs = rows.select("_text", "_side").mapInArrow(count_top, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        at, *n = pairs.where((F.col("n0") >= LEAST) | (F.col("n1") >= LEAST)).toPandas().to_numpy(np.int64).T  # at most top ** 2 rows
        for s in (0, 1):
            tables.pairs[s, at] = tables.loss(n[s], tables.counts[s, at // top], tables.counts[s, at % top], s)
    return Models(rows, counts, tables, sum(total))


def _schema(key: T.DataType) -> T.StructType:
    """A document's row has its key, number, size and sums; a block's row has its bucket, kind, chunk, length and columns."""
    kinds = {"doc": key, "row": T.LongType(), "size": T.LongType(), "l0": T.DoubleType(), "l1": T.DoubleType(), "part": T.LongType(), "kind": T.IntegerType(), "chunk": T.LongType(), "n": T.LongType(), "counted": T.BooleanType(), "scored": T.BooleanType(), "a": T.BinaryType(), "b": T.BinaryType(), "c": T.BinaryType()}
    return T.StructType([T.StructField(f"_{k}", t) for k, t in kinds.items()])


def _batch(key: pa.DataType, **columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows with the given columns; the others are null."""
    kinds = {"doc": key, "row": pa.int64(), "size": pa.int64(), "l0": pa.float64(), "l1": pa.float64(), "part": pa.int64(), "kind": pa.int32(), "chunk": pa.int64(), "n": pa.int64(), "counted": pa.bool_(), "scored": pa.bool_(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns.get(k), pa.Array) else pa.nulls(n, t) if x is None else pa.array(x, t) for k, t in kinds.items()], names=[f"_{k}" for k in kinds])


def _blocks(key: pa.DataType, kind: int, part: np.ndarray, ordered: np.ndarray, other: np.ndarray, owner: np.ndarray, **more) -> pa.RecordBatch:
    """A row for each part, with its rows in the order of ``ordered``; ``other`` may have none or several of them, packed one after another."""
    order = np.argsort(ordered)
    order = order[np.argsort(part[order].astype(np.uint16 if int(part.max(initial=0)) < 1 << 16 else np.int64), kind="stable")]
    part, ordered, other, owner = part[order], ordered[order], other[..., order], owner[order]
    at = runs(part)
    cuts = spans(at, len(part))
    return _batch(
        key, part=part[at], kind=[kind] * len(at), n=[z - a for a, z in cuts],
        a=[packed_sorted(ordered[a:z]) for a, z in cuts], b=[packed(other[..., a:z].reshape(-1)) for a, z in cuts], c=[packed(owner[a:z]) for a, z in cuts],
        **{k: [v] * len(at) for k, v in more.items()},
    )


def _occurrences(rows: DataFrame, shared: Broadcast, buckets: int, counted: bool, scored: bool) -> DataFrame:
    """Blocks of all occurrences that are not served here, and, if they are scored, a row of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        many, ids, chunk = len(t.names), Ids(t.names), TaskContext.get().partitionId() << 43 - LINES
        held, size, lines, key = [], 0, 0, None
        single = np.array([-np.log(t.unigram(t.counts[s], s)) for s in (0, 1)])

        def flush() -> Iterator[pa.RecordBatch]:
            word, before, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            rare, first = (word < 0) | (word >= many), (before < 0) | (before >= many)
            served = ~rare & ~first & (word < t.top) & (before < t.top)
            for kind, chosen, ordered, other in (
                (COMMON, ~rare & ~first & ~served, lambda x: before[x] * many + word[x], lambda x: np.zeros((0, len(x)), np.int64)),
                (SECOND, rare, lambda x: word[x], lambda x: before[x]),
                (FIRST, ~rare & first, lambda x: before[x], lambda x: word[x]),
            ):
                at = np.flatnonzero(chosen)
                k = ordered(at)
                yield _blocks(key, kind, _bucket(k, buckets), k, other(at), owner[at], chunk=chunk, counted=counted, scored=scored)

        # however many rows a batch has, a chunk's lines have their bits
        for b in (b.slice(k, 1 << LINES - 2) for b in bounded(batches, "_text") for k in range(0, b.num_rows, 1 << LINES - 2)):
            key = b.schema.field(2).type
            word, before, sizes = numbers(ids, b.column(0).to_pylist())
            line = np.arange(lines, lines + len(sizes))
            held.append((word, before, np.repeat(line * 2 + b.column(1).to_numpy(), sizes)))
            if scored:
                own = np.repeat(np.arange(len(sizes)), sizes)
                known = (word >= 0) & (word < many)
                pair = (word >= 0) & (word < t.top) & (before >= 0) & (before < t.top)
                sums = [np.bincount(own[known], single[s][word[known]], len(sizes)) + np.bincount(own[pair], t.pairs[s][before[pair] * t.top + word[pair]], len(sizes)) for s in (0, 1)]
                yield _batch(key, doc=b.column(2), row=(chunk << LINES) + line, size=sizes, l0=sums[0], l1=sums[1], part=line % buckets, kind=np.full(len(sizes), DOCUMENT))
            lines, size = lines + len(sizes), size + len(word)
            if size >= CHUNK or lines >= 1 << LINES - 1:
                yield from flush()
                held.clear()
                chunk, size, lines = chunk + 1, 0, 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, _schema(rows.schema["_key"].dataType))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int | None, list[dict]]]:
    """Documents' rows as they come (no part), and the blocks of each part beside some batch."""
    now, blocks, b = None, [], None
    for b in batches:
        kind = b.column(6).to_numpy()
        whole = np.flatnonzero(kind == DOCUMENT)
        if len(whole):
            yield b.take(pa.array(whole)), None, []
        for r in b.take(pa.array(np.flatnonzero(kind != DOCUMENT))).select([f"_{k}" for k in ("part", "kind", "chunk", "n", "counted", "scored", "a", "b", "c")]).to_pylist():
            if r["_part"] != now and blocks:
                yield b, now, blocks
                blocks = []
            now = r["_part"]
            blocks.append(r)
    if blocks:
        yield b, now, blocks


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(x) % np.uint64(buckets)).astype(np.int64)


def _home(chunk: np.ndarray, buckets: int) -> np.ndarray:
    """The part where a chunk's sums meet: tasks and their chunks in turn."""
    return ((chunk >> 43 - LINES) + (chunk & (1 << 43 - LINES) - 1)) % buckets


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Each row's number once, with its sums."""
    rows, l0, l1 = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows, at = np.unique(rows, return_inverse=True)
    return rows, np.bincount(at, l0, len(rows)), np.bincount(at, l1, len(rows))


def _met(shared: Broadcast, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts what meets in each bucket; hands on sums of documents, bigrams whose first word's count is elsewhere, and the counts of rare words."""

    def read(blocks: list[dict], kind: int) -> tuple[np.ndarray, ...]:
        """Ordered column, the other, row number, side that it counts for (-1: none), whether it is scored."""
        own = [r for r in blocks if r["_kind"] == kind]
        n = [r["_n"] for r in own]
        owner = _joined([unpacked(r["_c"], r["_n"]) for r in own])
        rows = (np.repeat(np.array([r["_chunk"] for r in own], np.int64), n) << LINES) + (owner >> 1)
        counted, scored = (np.repeat(np.array([r[k] for r in own], bool), n) for k in ("_counted", "_scored"))
        side = np.where(counted, owner & 1, -1).astype(np.int8)
        other = _joined([unpacked(r["_b"], r["_n"]) for r in own if kind != COMMON])
        return _joined([unpacked_sorted(r["_a"], r["_n"]) for r in own]), other, rows, side, scored

    def by_side(side: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.array([totals((side == s).astype(np.int64), starts) for s in (0, 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        many, key, owed = len(t.names), None, []

        def flush() -> pa.RecordBatch:
            rows, l0, l1 = owed.pop()
            at = runs(rows >> LINES)
            cuts = spans(at, len(rows))
            chunk = rows[at] >> LINES
            return _batch(key, part=_home(chunk, buckets), kind=[SUMS] * len(at), chunk=chunk, n=[z - a for a, z in cuts], a=[packed_sorted(rows[a:z]) for a, z in cuts], b=[l0[a:z].tobytes() for a, z in cuts], c=[l1[a:z].tobytes() for a, z in cuts])

        for b, part, blocks in _by_part(batches):
            key = b.schema.field(0).type
            if part is None:
                yield b
                continue
            keys, count = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
            for kind in (SECOND, FIRST, COMMON):
                ordered, other, rows, side, scored = read(blocks, kind)
                if not len(ordered):
                    continue
                order = np.argsort(ordered) if kind == COMMON else np.lexsort((other, ordered))
                ordered, rows, side, scored = (x[order] for x in (ordered, rows, side, scored))
                starts = runs(ordered)
                if kind == COMMON:
                    before, word = ordered[starts] // many, ordered[starts] % many
                    g, u, pending = t.counts[:, before], t.counts[:, word], np.zeros(len(starts), bool)
                else:
                    other = other[order]
                    if kind == SECOND:
                        keys, count = ordered[starts], by_side(side, starts)
                        sized = np.diff(np.append(starts, len(ordered)))
                        owed.append((rows[scored], *(np.repeat(-np.log(t.unigram(count[s], s)), sized)[scored] for s in (0, 1))))
                    starts = runs(ordered, other)
                    mine, near = np.zeros((2, len(starts)), np.int64), other[starts]
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, ordered[starts]), len(keys) - 1)
                        mine = np.where(keys[at] == ordered[starts], count[:, at], 0)
                    pending = (near < 0) | (near >= many)
                    theirs = t.counts[:, np.where(pending, 0, near)]
                    g, u = (theirs, mine) if kind == SECOND else (mine, theirs)
                n, sized = by_side(side, starts), np.diff(np.append(starts, len(ordered)))
                kept = (n >= LEAST).any(axis=0)
                done = np.repeat(kept & ~pending, sized) & scored
                owed.append((rows[done], *(np.repeat(t.loss(n[s], g[s], u[s], s), sized)[done] for s in (0, 1))))
                on = np.flatnonzero(np.repeat(kept & pending, sized) & scored)
                if len(on):
                    pair = np.repeat(np.arange(len(starts)), sized)[on]
                    yield _blocks(key, PENDING, _bucket(near[pair], buckets), near[pair], np.concatenate((n, u))[:, pair], rows[on])
            often = (count >= LEAST).any(axis=0)  # what comes before a kept bigram
            if often.any():
                yield _blocks(key, COUNTS, np.full(often.sum(), part), keys[often], count[:, often], np.zeros(often.sum(), np.int64))
            owed = [_summed(owed)]
            if len(owed[0][0]) > OWED:
                yield flush()
        if owed:
            yield flush()

    return run


def _ended(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ends the bigrams that are on their way, and adds up what each chunk's documents get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = shared.value
        for b, part, blocks in _by_part(batches):
            if part is None:
                yield b.select(OUT)
                continue
            keys, g, sums = np.zeros(0, np.int64), np.zeros((2, 0), np.int64), []
            for r in blocks:
                n, ordered = r["_n"], unpacked_sorted(r["_a"], r["_n"])
                if r["_kind"] == COUNTS:
                    keys, g = ordered, unpacked(r["_b"], 2 * n).reshape(2, n)
                elif r["_kind"] == PENDING:
                    x, at = unpacked(r["_b"], 4 * n).reshape(2, 2, n), np.searchsorted(keys, ordered)
                    sums.append((unpacked(r["_c"], n), *(t.loss(x[0, s], g[s, at], x[1, s], s) for s in (0, 1))))
                else:
                    sums.append((ordered, np.frombuffer(r["_b"]), np.frombuffer(r["_c"])))
            if sums:
                rows, l0, l1 = _summed(sums)
                yield _batch(b.schema.field(0).type, row=rows, l0=l0, l1=l1).select(OUT)

    return run


OUT = ["_doc", "_row", "_size", "_l0", "_l1"]


def _losses(occurrences: DataFrame, shared: Broadcast, buckets: int, tasks: int, key: str) -> DataFrame:
    schema = occurrences.schema

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(tasks, F.pmod("_part", F.lit(tasks)).cast("int")).sortWithinPartitions("_part", "_kind", "_chunk")

    met = dealt(occurrences).mapInArrow(_met(shared, buckets), schema)
    ended = dealt(met).mapInArrow(_ended(shared), T.StructType([schema[c] for c in OUT]))
    by_row = ended.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias(key), F.max("_size").alias("n_tokens"), *(F.sum(f"_l{s}").alias(f"_l{s}") for s in (0, 1)))
    out = by_row.select(key, "n_tokens", *((F.col(f"_l{s}") / F.greatest("n_tokens", F.lit(1))).alias(n) for s, n in ((1, "h_target"), (0, "h_background"))))
    return out.withColumn("score", F.col("h_target") - F.col("h_background"))


def _plan(models: Models, scored: DataFrame | None, key: str) -> DataFrame:
    """Losses of the scored rows, or of the rows of the fit."""
    spark = models.rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * max(1, -(-models.tokens // (BUCKET * tasks)))
    shared = spark.sparkContext.broadcast(models.tables)
    if scored is None:
        return _losses(_occurrences(models.rows, shared, buckets, True, True), shared, buckets, tasks, key)
    counted = models.rows.select("_text", "_side", F.lit(None).cast(scored.schema["_key"].dataType).alias("_key"))
    both = _occurrences(counted, shared, buckets, True, False).union(_occurrences(scored, shared, buckets, False, True))
    return _losses(both, shared, buckets, tasks, key)


def score(df: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, h_target, h_background, score) of every row's whole text."""
    return _plan(models, project(df, _key=key, _text=text).select("_text", F.lit(0).alias("_side"), "_key"), key)


def differences(df: DataFrame, target: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`score` of the rows on which the models are fitted: every occurrence is shuffled once for both."""
    return _plan(fit(df, target, key, text), None, key)
