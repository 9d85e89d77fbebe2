"""Best-fit packing by minimum bin slack (operator 8).

``token_pieces`` tokenizes documents and cuts only those longer than a sequence. ``pack`` puts pieces into sequences. Which
lengths go together depends on nothing but how many pieces each length has, at most ``size`` numbers: the driver fills one
sequence at a time from these counts. The longest length left opens it, a bitset subset-sum dynamic program over the lengths
available finds the fullest feasible rest, and that combination is removed as often as the counts allow. Pieces then find
their places by rank within their length, in parallel: a length's pieces are dealt over ``SALTS`` groups whose sizes give
each group its first rank, so a length that a third of all pieces share is ranked by many tasks.

Defined cases: a null or empty text is one piece that holds the end id alone. Repeated rows are packed as often as they
occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._bpe import Encoder, vocabulary
from assaykit.llm._cluster import keep
from assaykit.llm._text import bounded, project

#: Groups over which the pieces of one length are ranked; the driver gets at most this many counts for each length.
SALTS = 128


def token_pieces(df: DataFrame, path: str, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids) per piece; ids are little-endian unsigned 32-bit. Only the first piece may be shorter."""
    rows = project(df, **{key: key, "_text": text})
    schema = T.StructType([rows.schema[key], *(T.StructField(n, t, False) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for b in bounded(batches, "_text"):
            ids, counts = encoder.texts(b.column(1).to_pylist())
            stops = np.cumsum(counts)
            ids = np.insert(ids, stops, end).astype("<u4")
            row, piece, start, length, blob, o = [], [], [], [], [], 0
            for n, total in enumerate((counts + 1).tolist()):
                cut, k = 0, 0
                while cut < total:
                    stop = cut + ((total - cut) % size or size)
                    row.append(n)
                    piece.append(k)
                    start.append(cut)
                    length.append(stop - cut)
                    blob.append(ids[o + cut : o + stop].tobytes())
                    cut, k = stop, k + 1
                o += total
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blob, pa.binary())], names=[key, "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, schema)


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths whose sum comes nearest to ``room``; longer lengths first where several do."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in order:
        n = min(counts[length], room // length) if length <= room else 0
        if not n:
            continue
        steps.append((length, n, reach))
        left, k = n, 1
        while left:  # multiplicities by powers of two
            take = min(k, left)
            reach |= (reach << (take * length)) & mask
            left, k = left - take, k * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        k = 0
        while not before >> total & 1:
            total, k = total - length, k + 1
        if k:
            out[length] = k
    return out


def patterns(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, each with the number of sequences that it fills, until no piece is left."""
    counts = {length: n for length, n in counts.items() if n}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        counts[order[0]] -= 1
        found = fullest(counts, order, size - order[0])
        counts[order[0]] += 1
        found[order[0]] = found.get(order[0], 0) + 1
        times = min(counts[length] // k for length, k in found.items())
        for length, k in found.items():
            counts[length] -= times * k
        out.append((found, times))
        order = [length for length in order if counts[length]]
    return out


def pack(pieces: DataFrame, size: int = 2048, length: str = "length") -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset. Reads its input twice: hand it what is kept, not recomputed."""
    columns = pieces.columns
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int"))
    counted = salted.groupBy(F.col(length).alias("_length"), "_salt").agg(F.count(F.lit(1)).alias("_n")).collect()
    sizes = np.zeros((size + 1, SALTS), np.int64)
    for r in counted:
        sizes[r["_length"], r["_salt"]] = r["_n"]
    before = np.cumsum(sizes, axis=1) - sizes
    totals = sizes.sum(axis=1)

    base, slots = 0, []  # slots: length, first rank, first sequence, pieces of that length in each, offset of the first
    used = np.zeros(size + 1, np.int64)
    for found, times in patterns({n: int(c) for n, c in enumerate(totals.tolist()) if c}, size):
        offset = 0
        for n, k in sorted(found.items(), reverse=True):
            slots.append((n, int(used[n]), base, k, offset))
            used[n] += times * k
            offset += n * k
        base += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    step = np.int64(1) << np.int64(50)
    keys = table[:, 0] * step + table[:, 1]

    ranked = salted.withColumn("_at", F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*columns)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, salt, at = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in (length, "_salt", "_at"))
            rank = before[own, salt] + at - 1
            slot = table[np.searchsorted(keys, own * step + rank, side="right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), pa.array(slot[:, 2] + nth // slot[:, 3]), pa.array(slot[:, 4] + nth % slot[:, 3] * own)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, path: str, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents to places in sequences: (key, piece, start, length, ids_crc32, sequence_id, offset), tokenized once."""
    pieces = token_pieces(df, path, size, end, key, text)
    return pack(keep(pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), size)
