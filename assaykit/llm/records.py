"""Token ids in length-delimited binary record files (operator 9).

A shard ``<name>.rec`` is a sequence of frames: the payload's length (unsigned 64 bits), the masked CRC-32 of these eight
bytes, the payload, the payload's masked CRC-32; all little-endian. A payload is the document's key (signed 64 bits), one
byte for the width of an id in bytes (2 or 4), and the ids. ``<name>.idx`` beside it holds, for each frame, key, byte offset,
number of ids, and ids before it in the shard (four signed 64-bit numbers), so that a reader can take records in any order.

Shards are cut at quantiles of the key and written by tasks to the shared folder under names of their own for each attempt;
the manifest lists only what successful attempts wrote, so a lost executor costs a repeated shard and nothing else. Texts
stay where they are: only ids (two bytes each where the vocabulary allows) are shuffled.

Defined cases: a null or empty text is a record that holds the end id alone; a null key sorts first, and is told from other
keys by a width byte of 2 or 4 plus 128; rows that share a key stand in the order of their ids; an empty table has no shard.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._bpe import Encoder, vocabulary
from assaykit.llm._cluster import new_dir
from assaykit.llm._text import bounded, project

#: Layout of a frame's head and foot and of a payload's first bytes, and their sizes.
HEAD, FOOT, PAYLOAD = "<QI", "<I", "<qB"
HEAD_SIZE, FOOT_SIZE, PAYLOAD_SIZE = 12, 4, 9
MANIFEST = "shard long, path string, records long, ids long, bytes long, before long"


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that the checksum of data that holds checksums stays sound."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(FOOT, masked(length)) + payload + struct.pack(FOOT, masked(payload))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at a byte offset, and where the next one begins."""
    size, check = struct.unpack_from(HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at byte {at}")
    payload = data[at + HEAD_SIZE : at + HEAD_SIZE + size]
    (check,) = struct.unpack_from(FOOT, data, at + HEAD_SIZE + size)
    if masked(bytes(payload)) != check:
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + HEAD_SIZE + size + FOOT_SIZE


def write_records(df: DataFrame, path: str, folder: str, end: int = 1, per_shard: int = 4096, key: str = "doc_id", text: str = "text") -> list[tuple]:
    """Writes ids of all texts in ascending key order below ``folder``; returns the manifest, one row for each shard.

    per_shard: records in a shard, about; the manifest and the cut points, which the driver holds, have a row for each shard.
    """
    spark = df.sparkSession
    rows = project(df, _key=key, _text=text)
    n = rows.count()
    shards = -(-n // per_shard)
    cuts = []
    if shards > 1:
        at = [i / shards for i in range(1, shards)]
        cuts = sorted(set(rows.agg(F.percentile_approx("_key", F.array(*map(F.lit, at)), max(10_000, 20 * shards))).first()[0] or []))
    bounds = np.array(cuts, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        encoder, width = Encoder(v), 2 if v.size <= 1 << 16 else 4
        for b in bounded(batches, "_text"):
            ids, counts = encoder.texts(b.column(1).to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end).astype(f"<u{width}")
            stops = np.cumsum(counts + 1)
            keys = b.column(0)
            shard = np.searchsorted(bounds, keys.fill_null(0).to_numpy(), side="left") + 1
            shard[keys.is_null().to_numpy(zero_copy_only=False)] = 0
            blobs = [bytes([width]) + ids[a:z].tobytes() for a, z in zip((stops - counts - 1).tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), keys, pa.array(blobs, pa.binary())], names=["_shard", "_key", "_ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        out, now, done = None, None, []

        def close() -> None:
            if out is None:
                return
            out.close()
            with where.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            done.append((now, f"{folder}/{name}", len(index), ids, size, 0))

        for b in batches:
            for shard, k, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    close()
                    now, name, index, ids, size = shard, f"shard-{shard:07d}-{attempt}", [], 0, 0
                    where.create_dir(root, recursive=True)
                    out = where.open_output_stream(f"{root}/{name}.rec")
                count = (len(blob) - 1) // blob[0]
                data = frame(struct.pack(PAYLOAD, 0 if k is None else k, blob[0] + 128 * (k is None)) + blob[1:])
                out.write(data)
                index.append((0 if k is None else k, size, count, ids))
                ids, size = ids + count, size + len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["shard", "path", "records", "ids", "bytes", "before"])

    encoded = rows.mapInArrow(encode, T.StructType([T.StructField("_shard", T.LongType()), T.StructField("_key", T.LongType()), T.StructField("_ids", T.BinaryType())]))
    tasks = max(1, min(len(cuts) + 2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = encoded.repartition(tasks, "_shard").sortWithinPartitions("_shard", "_key", "_ids")
    manifest, before = [], 0
    for r in sorted(dealt.mapInArrow(write, MANIFEST).collect()):
        manifest.append((*r[:5], before))
        before += r["ids"]
    return manifest


def read_records(spark: SparkSession, manifest: list[tuple], shuffle: int | None = None) -> DataFrame:
    """(key, start, ids) of every record; start counts the ids of all records before it.

    shuffle: a seed; records of each shard then come in a random order, found through the offset index.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, path, _, _, _, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where, name = pafs.FileSystem.from_uri(path)
                with where.open_input_file(f"{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 4)
                order = list(range(len(index)))
                if shuffle is not None:
                    random.Random(f"{shuffle} {path}").shuffle(order)
                with where.open_input_file(f"{name}.rec") as f:
                    for k in range(0, len(order), 256):
                        rows = order[k : k + 256]
                        keys, starts, ids = [], [], []
                        if shuffle is None:
                            f.seek(int(index[rows[0], 1]))
                            stop = index[rows[-1] + 1, 1] if rows[-1] + 1 < len(index) else f.size()
                            whole, at = memoryview(f.read(int(stop - index[rows[0], 1]))), 0
                        for r in rows:
                            if shuffle is not None:
                                f.seek(int(index[r, 1]))
                                head = f.read(HEAD_SIZE)
                                whole, at = memoryview(head + f.read(struct.unpack(HEAD, head)[0] + FOOT_SIZE)), 0
                            payload, at = unframe(whole, at)
                            key, width = struct.unpack_from(PAYLOAD, payload)
                            keys.append(None if width & 128 else key)
                            starts.append(before + int(index[r, 3]))
                            ids.append(np.frombuffer(payload[PAYLOAD_SIZE :], f"<u{width & 127}").astype(np.int32))
                        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=["key", "start", "ids"])

    table = spark.createDataFrame(manifest, MANIFEST)
    if manifest:
        table = table.repartition(len(manifest))
    return table.mapInArrow(read, "key long, start long, ids array<int>")


def token_records(df: DataFrame, path: str, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the record files of df to the shared folder and returns what reading them back gives."""
    spark = df.sparkSession
    return read_records(spark, write_records(df, path, new_dir(spark, "records"), end, key=key, text=text))
