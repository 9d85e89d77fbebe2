"""Texts matched by weighted words: cosine and containment, at or above a gate.

Weights are ``tf * idf`` with idf = ln(n / (1 + df)) + 1 from the references, and ln(n) + 1 for words that no reference has.

Cosines at a low gate are most pairs' (at 0.2 one pair in seven of the driver's conversations), so that no filter by rare words saves
much, and rows of pairs and words would be many times the result. The texts of both sides therefore meet in blocks of at most about
``BLOCK`` texts and ``POSTINGS`` words; a task multiplies two blocks tile by tile, frequent words as matrices and others by their
postings, and hands on only what reaches the gate. Work is quadratic in the texts; a task's memory is not. Containment is the same product, of the
words that a text has and their shares of an item's weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import words
from assaykit.operators.rounds import kept

#: Words of notes and references that are broadcast at most, as weights.
FEW = 2_000_000
#: Room for rounding in bounds.
SLACK = 1e-9
#: Texts and words of texts in a block, texts in a tile, and products that are spread out at once.
BLOCK, POSTINGS, TILE, SPREAD = 8192, 4_000_000, 1024, 500_000
#: Words that at least one in so many pairs of a block's texts share are multiplied as matrices.
DENSE = 256


def counted(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(id, word, tf)."""
    return df.select(F.col(key).alias("id"), F.explode(tokens).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))


def weights(references: DataFrame, n: int) -> DataFrame:
    """(word, idf) over counted references."""
    return references.groupBy("word").agg((F.log(F.lit(float(max(n, 1))) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))


def numbered(idf: DataFrame) -> DataFrame:
    """(word, idf, number), to be broadcast if the words are few; numbers are their place within a partition, and the partition."""
    idf = kept(idf)
    place, parts = F.monotonically_increasing_id(), idf.rdd.getNumPartitions()
    idf = kept(idf.select("word", "idf", (place.bitwiseAND((1 << 33) - 1) * parts + F.shiftright(place, 33)).cast("int").alias("number")))
    return F.broadcast(idf) if idf.count() <= FEW else idf


class Side:
    """One side of two blocks in tiles: matrices of the first ``dense`` words, and the other words' postings in the order of words."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, w: np.ndarray, texts: int, dense: int, vocabulary: int, tile: int) -> None:
        self.tiles = []
        of = doc // tile
        for t in range(-(-texts // tile)):
            own = np.flatnonzero(of == t)
            own = own[np.argsort(word[own], kind="stable")]
            d, g, x = doc[own] - t * tile, word[own], w[own]
            n = np.searchsorted(g, dense)
            matrix = np.zeros((min(tile, texts - t * tile), dense))
            matrix[d[:n], g[:n]] = x[:n]
            self.tiles.append((matrix, d[n:], g[n:], x[n:], np.searchsorted(g[n:], np.arange(vocabulary + 1))))


def products(a: tuple, b: tuple, least: float, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, product) of vectors of two blocks whose product is ``least`` or more, tile by tile.

    A block: the number of its vectors, and for each component other than zero its vector, word and value.
    """
    (texts_a, doc_a, word_a, x), (texts_b, doc_b, word_b, y) = a, b
    (u, n), (v, m) = (np.unique(words, return_counts=True) for words in (word_a, word_b))
    both, at_u, at_v = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if not len(both):
        return
    often = n[at_u] * m[at_v] * DENSE >= texts_a * texts_b
    number = np.empty(len(both), np.int64)
    number[np.argsort(~often, kind="stable")] = np.arange(len(both))
    sides = []
    for texts, doc, word, w in (a, b):
        place = np.minimum(np.searchsorted(both, word), len(both) - 1)
        held = both[place] == word
        sides.append(Side(doc[held], number[place[held]], w[held], texts, int(often.sum()), len(both), tile))
    for i, (p, da, ga, xa, _) in enumerate(sides[0].tiles):
        for j, (q, db, _, xb, first) in enumerate(sides[1].tiles):
            out = p @ q.T
            met = first[ga + 1] - first[ga]  # of each posting of a: the postings of b with its word
            end = np.cumsum(met)
            cuts = [*np.searchsorted(end, np.arange(0, end[-1] if len(end) else 0, SPREAD), side="right"), len(met)]
            for lo, hi in pairwise(cuts):
                of = np.repeat(np.arange(lo, hi), met[lo:hi])
                to = np.arange(len(of)) + np.repeat(first[ga[lo:hi]] - (end[lo:hi] - met[lo:hi]) + (end[lo] - met[lo]), met[lo:hi])
                out += np.bincount(da[of] * len(q) + db[to], xa[of] * xb[to], minlength=out.size).reshape(out.shape)
            r, c = np.nonzero(out >= least)
            if len(r):
                yield r + i * tile, c + j * tile, out[r, c]


def met(a: DataFrame, b: DataFrame, least: float, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(u, v, product) of (id, words, x) of both sides, each id once and its words too, whose product is ``least`` or more, which must be above 0."""
    sizes = [x.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first() for x in (a, b)]
    blocks = [max(-(-docs // block), -(-postings // POSTINGS), min(4, -(-docs // tile)), 1) for docs, postings in sizes]

    def dealt(docs: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine, others = F.pmod(F.xxhash64("id"), F.lit(blocks[side])), F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - side] - 1)).cast("array<long>"))
        return docs.select(mine.alias(own), others.alias(other), F.col("id").alias("uv"[side]), F.lit(side).alias("side"), "words", "x")

    rows = dealt(a, "i", "j", 0).unionByName(dealt(b, "j", "i", 1), allowMissingColumns=True)
    out = f"u {a.schema['id'].dataType.simpleString()}, v {b.schema['id'].dataType.simpleString()}, product double"

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        ids, sides = [], []
        for side, key in enumerate(("u", "v")):
            own = rows.filter(pc.equal(rows["side"], side)).combine_chunks()
            if not own.num_rows:
                return
            held, x = own["words"].combine_chunks(), own["x"].combine_chunks()
            doc = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
            ids.append(own[key].combine_chunks())
            sides.append((len(held), doc, held.flatten().to_numpy(), x.flatten().to_numpy()))
        for i, j, product in products(*sides, least, tile):
            yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(product)], names=["u", "v", "product"])

    return rows.repartition(blocks[0] * blocks[1], "i", "j").groupBy("i", "j").applyInArrow(matched, out)


def cosine_matches(notes: DataFrame, references: DataFrame, nkey: str, rkey: str, text: str, least: float, tokens=words, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(nkey, rkey, cosine) of pairs whose tf-idf vectors have a cosine of ``least`` or more, which must be above 0."""
    n = references.where(F.col(text).isNotNull()).count()
    right = counted(references, rkey, tokens(F.col(text)))
    known = numbered(weights(right, n))

    def unit(counts: DataFrame) -> DataFrame:
        """(id, words, x): components of the words that references have."""
        w = F.col("tf") * F.coalesce("idf", F.log(F.lit(float(max(n, 1)))) + 1)
        rows = counts.join(known, "word", "left").select("id", "number", w.alias("w"))
        held = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("number", "w"))).alias("all")
        docs = rows.where("id is not null").groupBy("id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("size"), held)
        return kept(docs.select("id", F.col("all.number").alias("words"), F.transform("all.w", lambda w: w / F.col("size")).alias("x")))

    found = met(unit(counted(notes, nkey, tokens(F.col(text)))), unit(right), least, block, tile)
    return found.select(F.col("u").alias(nkey), F.col("v").alias(rkey), F.col("product").alias("cosine"))


def contained(items: DataFrame, texts: DataFrame, ikey: str, tkey: str, text: str, least: float, tokens=words, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(ikey, tkey, share) of pairs in which the text holds words with ``least`` or more of the item's idf; each different word counts once."""
    n = items.where(F.col(text).isNotNull()).count()
    own = kept(counted(items, ikey, tokens(F.col(text))))
    known = numbered(weights(own, n))
    whole = own.where("id is not null").join(known, "word").groupBy("id").agg(F.sum("idf").alias("total"), F.collect_list(F.struct("number", "idf")).alias("all"))
    whole = kept(whole.select("id", F.col("all.number").alias("words"), F.transform("all.idf", lambda w: w / F.col("total")).alias("x")))
    # the texts' words of all items' words, once a text
    said = texts.where(F.col(text).isNotNull() & F.col(tkey).isNotNull()).select(F.col(tkey).alias("id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
    held = kept(said.join(known, "word").groupBy("id").agg(F.collect_set("number").alias("words")))
    found = met(held.withColumn("x", F.transform("words", lambda _: F.lit(1.0))), whole, least - SLACK, block, tile)
    return found.select(F.col("v").alias(ikey), F.col("u").alias(tkey), F.col("product").alias("share"))
