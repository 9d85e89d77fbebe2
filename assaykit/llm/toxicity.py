"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton (operator 7).

Texts are folded first: compatibility forms, look-alike letters of other scripts, invisible characters, and digits or signs
that stand for letters inside a word. The lexicon is learned from labelled texts: words and word beginnings that occur in
toxic texts much more than in clean ones, with their log odds as weights, and exception phrases: longer words or word pairs around an
entry that clean texts use as often. One automaton holds both; where entries overlap the longest counts, and an exception
counts nothing. The matched weight is normalised by the text's length, and a logistic curve fitted on the labelled texts
turns weight and normalised weight into a score.

Bounds: at most about ``per_class`` texts of each label are learned from, so that what is broadcast doesn't grow with the data. An
entry must have more evidence (its occurrences in toxic texts times its log odds) than the best of as many terms by chance, so
that a few texts can make an entry where few terms are tried. Every whole text is scored.

Defined cases: null and empty texts score as texts without a match; without labels of both kinds every score is 0; a text
with several labels is toxic if one says so; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._cluster import keep
from assaykit.llm._text import bounded, project
from assaykit.llm.langid import sample

#: Look-alike letters, and signs that stand for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v", "ӏ": "l", "г": "r", "п": "n", "ь": "b",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ꜱ": "s", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
INVISIBLE = [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]

#: Times that one text counts a term when the lexicon is learned.
PER_TEXT = 3

TABLE = str.maketrans(LOOK_ALIKE | {chr(c): None for c in INVISIBLE})
SIGN = re.compile(r"[0-9@$!|€+]")
#: A run of letters and signs that has a sign; it is taken whole, from its start.
RUN = re.compile(r"(?<![\w@$!|€+])[\w@$!|€+]*[0-9@$!|€+][\w@$!|€+]*")
SIGN_TABLE = str.maketrans(SIGNS)
GAPS = re.compile(r"[\W_]+")


def _letters(m: re.Match) -> str:
    """A run with its signs as letters; signs at its end, and runs with hardly a letter, stay what they are."""
    core = m[0].rstrip("@$!|€+")
    if sum(c.isalpha() for c in core) < 2:
        return m[0]
    return core.translate(SIGN_TABLE) + m[0][len(core) :]


def fold(text: str) -> str:
    """Words in folded form, with one blank before, between and after them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(TABLE)
    if SIGN.search(text):
        text = RUN.sub(_letters, text)
    return " " + GAPS.sub(" ", text).strip() + " "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    harmless: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = ()

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for entry in self.harmless:
            out.add_word(entry, (len(entry), 0.0))
        if len(out):
            out.make_automaton()
        return out


def features(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, float, float]:
    """Matched weight, its share of the words, and the number of matches; of overlapping entries the longest counts."""
    folded = fold(text or "")
    words = folded.count(" ") - 1
    if not len(automaton) or words < 1:
        return 0.0, 0.0, 0.0
    best: dict[int, tuple[int, float]] = {}
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if length > best.get(start, (0, 0.0))[0]:
            best[start] = (length, weight)
    total, n, free = 0.0, 0, 0
    for start, (length, weight) in sorted(best.items()):
        if start + 1 < free:  # inside an entry that began before
            continue
        free = start + length
        total += weight
        n += weight > 0
    return math.log1p(total), math.log1p(100 * total / words), float(n)


def candidates(folded: str) -> Counter:
    """What may become an entry: each word, and each beginning of a word from four letters to twelve; with how often, ``PER_TEXT`` at most."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        for k in range(4, min(len(w), 12) + 1):
            out[" " + w[:k]] += n
        out[f" {w} "] += n
    return Counter({t: min(n, PER_TEXT) for t, n in out.items()})


def _labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    chosen = sample(labels.groupBy("_key").agg(F.max("_toxic").alias("_toxic")), F.col("_toxic"), per_class, "_key").select("_key", F.col("_toxic").cast("int").alias("_toxic"))
    return docs.join(F.broadcast(chosen), "_key").select("_text", "_toxic")  # bounded by per_class


def learn(df: DataFrame, labels: DataFrame, per_class: int = 4000, margin: float = 0.0, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Lexicon:
    """Learns from at most about ``per_class`` texts of each label. An entry's evidence exceeds the logarithm of the number of terms by ``margin``."""
    rows = _labelled(project(df, _key=key, _text=text), project(labels, _key=key, _toxic=toxic).where(F.col("_key").isNotNull() & F.col("_toxic").isNotNull()), per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], names=["term", "clean", "toxic"])
            for c in seen:
                c.clear()
            return out

        for b in bounded(batches, "_text"):
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[label > 0].update(candidates(fold(t or "")))
                seen[label > 0][""] += 1
            if sum(map(len, seen)) > 300_000:
                yield flush()
        yield flush()

    terms = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    terms = keep(terms.where("term <> ''"))
    n = rows.groupBy().agg(F.count_if(F.col("_toxic") > 0).alias("toxic"), F.count_if(F.col("_toxic") <= 0).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:
        return Lexicon()
    odds = F.log(((F.col("toxic") + 0.5) / (n["toxic"] + 1)) / ((F.col("clean") + 0.5) / (n["clean"] + 1)))  # by occurrences a text
    evidence = PER_TEXT * (math.log(max(1, terms.count())) + margin)
    top = terms.withColumn("odds", odds).withColumn("gain", F.col("toxic") * F.col("odds")).where((F.col("odds") > 1) & (F.col("gain") > evidence))
    found = [tuple(r) for r in top.select("term", "odds", "gain").collect()]  # bounded by the sample
    # a beginning stands for its longer forms, unless these tell more; of equal ones the longest beginning
    found.sort(key=lambda r: (-r[2], r[0].endswith(" "), -len(r[0]), r[0]))
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # beginnings of what is chosen
    for term, w, _ in found:
        own = [term[:k] for k in range(1, len(term) + 1)]
        if term not in begun and not any(x in chosen for x in own):
            chosen[term] = w
            begun.update(own)
    lexicon = Lexicon(chosen)
    lexicon.harmless = _exceptions(rows, lexicon, n)
    got = _features(rows, lexicon).toPandas()
    lexicon.curve = _logistic(np.column_stack([np.ones(len(got)), got["a"], got["b"], got["c"] > 0]), (got["_toxic"] > 0).to_numpy(float))
    return lexicon


def _exceptions(rows: DataFrame, lexicon: Lexicon, n: dict) -> list[str]:
    """Whole words that hold an entry, also with the word before or after them, that clean texts have no less than toxic ones, in three texts or more."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.value.automaton()
        seen: list[Counter] = [Counter(), Counter()]
        for b in bounded(batches, "_text"):
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded, own = fold(t or ""), set()
                for end, (length, _) in finder.iter(folded) if len(finder) else ():
                    start = end - length + 1
                    stop = folded.index(" ", max(start + 1, end))
                    own.add(folded[start : stop + 1])
                    nxt = folded.find(" ", stop + 1)
                    if nxt > 0:
                        own.add(folded[start : nxt + 1])
                    if start > 0:
                        own.add(folded[folded.rindex(" ", 0, start) : stop + 1])
                seen[label > 0].update(own)
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], names=["term", "clean", "toxic"])

    counts = rows.mapInArrow(around, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    usual = counts.where((F.col("clean") >= 3) & (F.col("clean") / n["clean"] >= F.col("toxic") / n["toxic"]))
    return sorted(r["term"] for r in usual.collect())  # bounded by the sample


def _features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for b in bounded(batches, "_text"):
            got = [features(automaton, t) for t in b.column(b.schema.get_field_index("_text")).to_pylist()]
            rest = [(c, n) for c, n in zip(b.columns, b.schema.names, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), *(pa.array([g[i] for g in got], pa.float64()) for i in range(3))], names=[*(n for _, n in rest), "a", "b", "c"])

    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "_text"), *(T.StructField(x, T.DoubleType(), False) for x in "abc")])
    return rows.mapInArrow(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Coefficients of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score(df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row's whole text."""
    rows = _features(project(df, **{key: key, "_text": text}), lexicon)
    if not lexicon.curve:
        return rows.select(key, F.lit(0.0).alias("score"))
    w = lexicon.curve
    z = F.lit(w[0]) + w[1] * F.col("a") + w[2] * F.col("b") + w[3] * (F.col("c") > 0).cast("double")
    return rows.select(key, (1 / (1 + F.exp(-z))).alias("score"))


def attach(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """The rows of df with the score of their whole text."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, w = shared.value.automaton(), shared.value.curve
        for b in bounded(batches, text):
            got = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                x, y, n = features(automaton, t)
                got.append(1 / (1 + math.exp(-(w[0] + w[1] * x + w[2] * y + w[3] * (n > 0)))) if w else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
