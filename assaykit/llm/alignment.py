"""Alignment of two tokenizers' tokens over the bytes they share (operator 13).

Both token sequences of a text spell the same bytes. Repeating each token's number once for each of its bytes gives two owner arrays
of equal length: a place where either owner changes starts another pair of overlapping tokens, a link, and a place where both
change cuts the text into groups. All texts of a batch lie in one array, where the ends of texts are cuts like any other.

``links`` counts each pair of ids over all texts, summed within tasks before the shuffle. ``align`` encodes the texts again
and looks the pairs up; the pairs' counts are broadcast in slices of at most ``PAIRS``, and each slice adds its share to the
sums of a text, so that any number of different pairs is met by the same bounded tables.

Side A is a byte-level vocabulary, encoded by ``_bpe`` without special tokens; its tokens always spell the text. Side B is a sentencepiece model with byte fallback
and a space mark before the text. No piece of it goes on behind a space mark after another character, so each run of spaces with
what follows is encoded by the library by itself, each distinct one once.

Defined cases: null and empty texts, and texts that a side does not spell back exactly (as one with U+2581), have no tokens: zeros
and an empty digest. Repeated rows count each time, null keys are passed through, an empty table gives an empty result.
Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._bpe import Encoder, byte_characters, take_runs, vocabulary
from assaykit.llm._cluster import keep
from assaykit.llm._text import bounded, project

#: Counted pairs of ids in one broadcast table.
PAIRS = 4_000_000
#: Different pairs that a task sums before it hands them on.
HELD = 2_000_000
#: A run of spaces and what follows up to the next.
#: Different pre-tokens and chunks that a task remembers.
KEPT = 400_000
CHUNK = re.compile(" +[^ ]*")
MARK = "▁"


def runs_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each piece starts and ends."""
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)


@lru_cache(maxsize=2)
def bytes_of_a(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each id of a byte-level vocabulary."""
    v, byte = vocabulary(path), {c: b for b, c in enumerate(byte_characters())}
    return runs_of([bytes(byte[c] for c in v.tokens.get(i, "") if c in byte) for i in range(v.size)])


@lru_cache(maxsize=2)
def pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def bytes_of_b(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each id of a sentencepiece model."""
    m = pieces(path)
    named = (m.id_to_piece(i) for i in range(m.vocab_size()))
    return runs_of([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(named)])


@lru_cache(maxsize=1)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, each with one byte behind it."""
    return runs_of([b"%d," % i for i in range(n)])


class Numbers(dict):
    """0, 1, .. in the order in which keys are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class PieceEncoder:
    """Ids of a sentencepiece model for batches of texts, each distinct chunk once; keeps about ``limit`` of them between batches."""

    def __init__(self, path: str, limit: int = KEPT):
        self.model, self.limit = pieces(path), limit
        self.mark = self.model.piece_to_id(MARK)
        self.values, self.at = bytes_of_b(path)
        self.clear()

    def clear(self) -> None:
        self.rows = Numbers()
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)
        self.same = np.zeros(0, bool)

    def learn(self, new: list[str]) -> None:
        made = self.model.encode([c[1:] for c in new], num_threads=1)  # the library sets one mark before each
        if " " in new:
            made[new.index(" ")] = [self.mark]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))))
        ids = np.fromiter(chain.from_iterable(made), np.int32, int(ends[-1]))
        spelled = take_runs(self.values, self.at, ids).tobytes()
        stops = np.concatenate(([0], np.cumsum(self.at[ids + 1] - self.at[ids])))[ends]
        whole = "".join(new)
        lengths = np.fromiter((len(c) if whole.isascii() else len(c.encode("utf-8", "surrogatepass")) for c in new), np.int64, len(new))
        same = np.diff(stops) == lengths
        if not same.all() or spelled != whole.encode("utf-8", "surrogatepass"):
            at = stops.tolist()
            same = np.array([spelled[x:y] == c.encode("utf-8", "surrogatepass") for x, y, c in zip(at, at[1:], new, strict=False)], bool)
        self.ids = np.concatenate((self.ids, ids))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + ends[1:]))
        self.same = np.concatenate((self.same, same))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, which are not empty, in one array, the number of ids of each, and whether they spell the text."""
        if len(self.rows) > self.limit:
            self.clear()
        before = len(self.rows)
        chunks = [CHUNK.findall(f" {t}") for t in texts]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        if len(self.rows) > before:
            self.learn(list(islice(self.rows, before, None)))
        sizes = np.concatenate(([0], np.cumsum(self.offsets[rows + 1] - self.offsets[rows])))
        ends = np.concatenate(([0], np.cumsum(counts)))
        wrong = np.concatenate(([0], np.cumsum(~self.same[rows])))
        return take_runs(self.ids, self.offsets, rows), np.diff(sizes[ends]), np.diff(wrong[ends]) == 0


class Aligned:
    """Tokens, links and groups of a batch of texts."""

    def __init__(self, texts: list[str | None], a: Encoder, b: PieceEncoder, of_a: tuple[np.ndarray, np.ndarray], of_b: tuple[np.ndarray, np.ndarray]):
        own = [i for i, t in enumerate(texts) if t]
        whole = [f" {texts[i]}" for i in own]
        ids_a, n_a = a.texts(whole)
        ids_b, n_b, good = b.texts([t[1:] for t in whole]) if whole else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))
        bytes_a, bytes_b = (at[ids + 1] - at[ids] for ids, (_, at) in ((ids_a, of_a), (ids_b, of_b)))
        if not good.all():
            bytes_a, bytes_b = bytes_a[np.repeat(good, n_a)], bytes_b[np.repeat(good, n_b)]
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = n_a[good], n_b[good]
        owner_a, owner_b = (np.repeat(np.arange(len(n), dtype=np.int32), n) for n in (bytes_a, bytes_b))
        change_a, change_b = (np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool) for x in (owner_a, owner_b))
        starts = np.flatnonzero(change_a | change_b)
        self.left, self.right = ids_a[owner_a[starts]], ids_b[owner_b[starts]]
        cuts = np.flatnonzero(change_a & change_b)
        self.first_a, self.first_b = owner_a[cuts], owner_b[cuts]  # first tokens of each group
        self.ids_a, self.ids_b = ids_a, ids_b
        self.texts = np.array(own, np.int64)[good]  # places of the texts that have tokens
        self.n_a, self.n_b = n_a, n_b
        begins = np.cumsum(n_a) - n_a
        self.links_from = np.searchsorted(owner_a[starts], begins)  # a text's first token of A is its first link's
        self.groups_from = np.searchsorted(self.first_a, begins)

    def pairs(self) -> np.ndarray:
        return (self.left.astype(np.int64) << 32) | self.right

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's links."""
        return np.add.reduceat(values, self.links_from) if len(self.texts) else np.zeros(0, np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each text."""
        return np.diff(np.append(self.groups_from, len(self.first_a))), np.diff(np.append(self.links_from, len(self.left)))

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2``."""
        na, nb = len(self.ids_a), len(self.ids_b)
        size_a, size_b = np.diff(np.append(self.first_a, na)), np.diff(np.append(self.first_b, nb))
        ids = np.empty(na + nb, np.int64)
        place_a = np.arange(na) + np.repeat(self.first_b, size_a)  # behind all of B in earlier groups
        place_b = np.arange(nb) + np.repeat(self.first_a + size_a, size_b)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        values, at = decimals(1 << 17)
        ends = np.cumsum(at[ids + 1] - at[ids])
        out = take_runs(values, at, ids).copy()
        last_a, last_b = place_a[self.first_a + size_a - 1], place_b[self.first_b + size_b - 1]
        out[ends[last_a] - 1] = ord("|")
        out[ends[last_b] - 1] = ord(";")
        stops = ends[np.cumsum(self.n_a + self.n_b) - 1].tolist() if len(self.texts) else []
        return [hashlib.sha256(out[a:z].tobytes()).hexdigest() for a, z in zip([0, *stops], [z - 1 for z in stops], strict=False)]


def links(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(a, b, n, best): how often each pair of ids overlaps in all texts, and whether no other pair of its b does so more often."""
    rows = project(df, _text=text).where("_text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, of_a, of_b = Encoder(vocabulary(path_a), KEPT, specials=False), PieceEncoder(path_b), bytes_of_a(path_a), bytes_of_b(path_b)
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both, where = np.unique(np.concatenate([keys, *(k for k, _ in fresh)]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([sums, *(n for _, n in fresh)]), len(both)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], names=["a", "b", "n"])

        for batch in bounded(batches, "_text"):
            fresh.append(np.unique(Aligned(batch.column(0).to_pylist(), a, b, of_a, of_b).pairs(), return_counts=True))
            if sum(len(k) for k, _ in fresh) > max(200_000, len(keys)):
                keys, sums = merged()
                fresh.clear()
                if len(keys) > HELD:
                    yield from out()
                    keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield from out()

    counted = keep(rows.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    highest = keep(counted.groupBy("b").agg(F.max("n").alias("_most")))  # at most one row for each id of B
    return counted.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = df.sparkSession
    counted = keep(links(df, path_a, path_b, text))
    slices = max(1, -(-counted.count() // pairs))
    rows = project(df, **{key: key, "_text": text})
    sums = T.StructType.fromDDL("n_best long, count_sum long").fields
    numbers = T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields

    def add(at: int, table):
        last = at == slices - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, of_a, of_b = Encoder(vocabulary(path_a), KEPT, specials=False), PieceEncoder(path_b), bytes_of_a(path_a), bytes_of_b(path_b)
            keys, times, best = table.value
            for batch in bounded(batches, "_text"):
                x = Aligned(batch.column(1).to_pylist(), a, b, of_a, of_b)
                different, which = np.unique(x.pairs(), return_inverse=True)
                place = np.minimum(np.searchsorted(keys, different), max(len(keys) - 1, 0))
                known = keys[place] == different if len(keys) else np.zeros(len(different), bool)
                n, top = (np.where(known, values[place] if len(keys) else 0, 0)[which] for values in (times, best))

                def spread(values: np.ndarray, rows: int = batch.num_rows, to: np.ndarray = x.texts) -> np.ndarray:
                    out = np.zeros(rows, np.int64)
                    out[to] = values
                    return out

                found = [spread(x.per_text(top.astype(np.int64))), spread(x.per_text(n))]
                if at:
                    found = [f + batch.column(2 + i).to_numpy() for i, f in enumerate(found)]
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], names=[key, "_text", "n_best", "count_sum"])
                    continue
                digest = [""] * batch.num_rows
                for i, d in zip(x.texts.tolist(), x.digests(), strict=True):
                    digest[i] = d
                groups, linked = x.counts()
                columns = [*map(spread, (x.n_a, x.n_b, groups, linked)), *found]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(digest)], names=[key, *(f.name for f in numbers)])

        return run

    for i in range(slices):
        part = counted.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == i).toArrow()
        keys = (part["a"].to_numpy().astype(np.int64) << 32) | part["b"].to_numpy()
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], part["n"].to_numpy()[order], part["best"].to_numpy()[order]))
        rows = rows.mapInArrow(add(i, table), T.StructType([rows.schema[key], *(numbers if i == slices - 1 else [rows.schema["_text"], *sums])]))
    return rows
