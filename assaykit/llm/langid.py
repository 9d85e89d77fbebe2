"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 1).

``fit`` counts n-grams of labelled texts by language: each task counts into a dense matrix and hands on its non-zero cells, and
Spark adds them up. The model is a matrix of log probabilities (languages x buckets), broadcast whole: its size is set by
``bits`` and the number of languages, not by the data. ``predict`` scores whole texts in batches: the n-grams of all texts of a
batch lie in one array of bucket numbers with the texts' boundaries (a sparse matrix in compressed rows), and each language's
log probabilities are gathered and added up between boundaries.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language that comes first in
alphabetical order; without any labelled text every text is ``und``; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._text import bounded, code_points, letter_table, lower_table, project, segment_sums

ORDERS = (1, 2, 3)
#: Evidence (in n-grams) beyond which a text's score doesn't grow, so that long mixed texts don't look certain.
EVIDENCE = 300
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, log probabilities
    prior: np.ndarray
    bits: int


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of all texts, the number of n-grams of each text, and whether each has a letter.

    Characters other than letters count as blanks; n-grams of blanks alone don't count.
    """
    # a blank before, between and after texts keeps n-grams inside words of one text
    cp, lengths = code_points([f" {t}  " for t in texts])
    letter = letter_table()[cp]
    value = np.where(letter, lower_table()[cp], 32).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    has = np.bincount(owner, weights=letter, minlength=len(texts)) > 0
    out, rows = [], []
    h = np.zeros(len(value), np.uint32)
    seen = np.zeros(len(value), bool)
    for n in range(1, max(ORDERS) + 1):
        size = len(value) - n + 1
        h = (h[:size] * np.uint32(0x01000193)) ^ (value[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n))
        seen = seen[:size] | letter[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(seen)
            mixed = h[at] ^ (h[at] >> np.uint32(15))
            out.append((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
            rows.append(owner[at])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(out)[order], np.bincount(row, minlength=len(texts)), has


def sample(df: DataFrame, label: Column, per_class: int, key: str) -> DataFrame:
    """Rows with a label, about ``per_class`` of each at most, chosen by a hash of the key whatever the order of rows."""
    labelled = df.withColumn("_label", label.cast("string")).where(F.col("_label").isNotNull())
    share = {r["_label"]: min(1.0, per_class / r["n"]) for r in labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return labelled
    rate = F.create_map(*(x for k, v in share.items() for x in (F.lit(k), F.lit(v))))[F.col("_label")]
    return labelled.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < rate * (1 << 30))


def fit(df: DataFrame, per_language: int = 3000, bits: int = 16, smooth: float = 0.1, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from at most about ``per_language`` labelled texts of each language (the bound of the sample)."""
    rows = project(df, _key=key, _text=text, _lang=lang)
    chosen = sample(rows, F.col("_lang"), per_language, "_key").select("_label", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for b in bounded(batches, "_text"):
            label = b.column(0).to_pylist()
            got = [t or "" for t in b.column(1).to_pylist()]
            h, sizes, has = grams(got, bits)
            ends = np.cumsum(sizes)
            for n, name in enumerate(label):
                if has[n]:
                    names.setdefault(name, np.zeros(1 << bits, np.int64))
                    names[name] += np.bincount(h[ends[n] - sizes[n] : ends[n]], minlength=1 << bits)
                    texts[name] = texts.get(name, 0) + 1
        for name, counts in names.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], texts[name]))], names=["lang", "bucket", "n"])

    cells = chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(cells["lang"].unique())
    counts = np.full((len(languages), 1 << bits), smooth)
    prior = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = cells[cells["lang"] == name]
        prior[i] = own.loc[own["bucket"] < 0, "n"].sum()
        own = own[own["bucket"] >= 0]
        counts[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    weights = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, weights, np.log(prior / max(prior.sum(), 1)), bits)


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    given = [t or "" for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(given), [0.0] * len(given)
    h, sizes, has = grams(given, model.bits)
    total = np.stack([segment_sums(w[h], sizes) for w in model.weights]) + model.prior[:, None]
    best = total.argmax(axis=0)
    shrunk = (total - total.max(axis=0)) * np.minimum(1, EVIDENCE / np.maximum(sizes, 1))
    score = 1 / np.exp(shrunk).sum(axis=0)
    return [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, has, strict=True)], np.where(has, score, 0.0).tolist()


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows of df with the predicted language of the whole text and its probability."""
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            names, scores = classify(shared.value, b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang, score])

    return df.mapInArrow(run, schema)
