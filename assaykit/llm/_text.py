"""Helpers that the text operators share: bounded batches, character tables, safe projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a single longer text is handled alone.
BATCH_BYTES = 1 << 20


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{src}`").alias(dst) for dst, src in columns.items()))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(size[stop - 1])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts in one array, and each text's length."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower-case form of each code point, where that is a single code point."""

    def low(i: int) -> int:
        x = chr(i).lower()
        return ord(x) if len(x) == 1 else i

    return np.fromiter(map(low, range(0x110000)), np.uint32, 0x110000)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of ``lengths`` consecutive values; 0 for empty runs."""
    out = np.zeros(len(lengths), np.float64)
    full = lengths > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[full]
        out[full] = np.add.reduceat(values, starts, dtype=np.float64)
    return out
