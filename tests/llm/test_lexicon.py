"""The learned lexicon: entries of any length, phrases around them, and the matcher against brute force."""

import math
import random

import pytest

from assaykit.llm import queries, toxicity


def brute(lexicon, text):
    """(weight, matches) by trying every entry at every place, from left to right; the longest at a place counts, none inside another."""
    folded, at, total, n = toxicity.fold(text), 0, 0.0, 0
    entries = {**dict.fromkeys(lexicon.harmless, 0.0), **{k: v for k, v in lexicon.weights.items() if k not in lexicon.harmless}}
    while at < len(folded):
        here = [e for e in entries if folded.startswith(e, at)]
        if not here:
            at += 1
            continue
        best = max(here, key=len)
        total += entries[best]
        n += entries[best] > 0
        at += len(best) - 1 if len(best) > 1 else 1  # a word's closing blank may open the next
    return total, n


def test_matching_equals_brute_force():
    rnd = random.Random(6)
    words = ["zog", "zogling", "mup", "mupp", "good", "not", "day", "z0g", "ZOG", "ok"]
    lexicon = toxicity.Lexicon({" zog ": 2.0, " zogl": 3.0, " mup": 1.5}, [" not zog ", " zog day ", " mupp "], ())
    automaton = lexicon.automaton()
    for _ in range(500):
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 12)))
        total, n = brute(lexicon, text)
        a, _, got = toxicity.features(automaton, text)
        assert (got, pytest.approx(a)) == (n, math.log1p(total)), text


def made(spark, tmp_path, n=600):
    rnd = random.Random(2)
    plain = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(20, 60))
        bad = i % 4 == 0
        if bad:
            for _ in range(rnd.randint(2, 4)):
                words.insert(rnd.randrange(len(words)), "zog")
        elif i % 4 == 1:
            at = rnd.randrange(len(words))
            words[at:at] = ["hardly", "zog"]  # harmless behind this word
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    spark.createDataFrame([*rows, (n, None), (n + 1, ""), (None, "zog zog zog")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return dict(rows), {k: t for k, _, t in labels}


def test_short_entries_and_phrases_before_them_are_learned(spark, tmp_path):
    texts, toxic = made(spark, tmp_path)
    got = queries.op7_toxicity(spark, str(tmp_path)).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"} and len(got) == len(texts) + 3
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert len(held) > 100 and all(r.predicted == toxic[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    lexicon = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert " zog " in lexicon.weights and " hardly zog " in lexicon.harmless
