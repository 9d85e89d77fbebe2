"""BPE encoding and decoding (operator 10).

``bpe_encode`` turns texts into token ids and ``bpe_decode`` ids into text, as the tokenizer file at ``path`` says. The
merges run in batched numpy rounds (see ``_bpe``); Spark deals the rows. Rows are independent: no shuffle takes place, and a
task holds about 1 MB of text (or one longer text) and the encodings of about 200,000 distinct pre-tokens.

Defined cases: a null or empty text has no ids and decodes to the empty text. The strings of special tokens become those
tokens, as the library does by default. Repeated rows, ties and null keys are passed through. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaykit.llm._bpe import Encoder, byte_characters, vocabulary
from assaykit.llm._text import bounded, project


def bpe_encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row's whole text."""
    rows = project(df, **{key: key, "_text": text})
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for b in bounded(batches, "_text"):
            ids, counts = encoder.texts(b.column(1).to_pylist())
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[key, "ids"])

    return rows.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows of df with the text of their ids; null ids are the empty text."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        token = [v.tokens.get(i, "") for i in range(v.size)]
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = set(v.special.values())
        raw = [] if v.words else [t.encode() if i in special else bytes(byte[c] for c in t) for i, t in enumerate(token)]
        for b in batches:
            at = b.schema.get_field_index(ids)
            made: list[str] = []
            for n in range(0, b.num_rows, 256):
                part = b.column(at).slice(n, 256)
                sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                flat, o = part.flatten().to_numpy(zero_copy_only=False).tolist(), 0
                for size in sizes.tolist():
                    own = flat[o : o + size]
                    o += size
                    made.append(" ".join([token[i] for i in own]) if v.words else b"".join([raw[i] for i in own]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
