"""Language ID, LM scoring, SimHash groups, extraction, toxicity and the pipeline."""

import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaykit.llm import _forest, htmltext, langid, lmscore, nearcopies, simhash, toxicity
from assaykit.llm._components import label_components

SF, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def frame(spark, texts, **more):
    names = ", ".join(["doc_id long", "text string", *(f"{k} string" for k in more)])
    return spark.createDataFrame([(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)], names)


# language ID


def talk(rnd, words, n=30):
    return " ".join(rnd.choices(words, k=n))


EN, DE = "the of and thing with that house river".split(), "der und nicht schön über straße größe ein".split()


def test_language_id(spark):
    rnd = random.Random(2)
    texts, langs = [], []
    for i in range(60):
        texts.append(talk(rnd, EN if i % 2 else DE))
        langs.append("en" if i % 2 else "de")
    df = frame(spark, texts, lang=langs)
    model = langid.fit(df)
    ask = frame(spark, ["THE RIVER and the house", "über die straße", None, "", "123 !?", talk(rnd, EN, 20_000), "der und nicht"], score=list("abcdefg"))
    got = {r["doc_id"]: (r["lang_pred"], r["_s"]) for r in langid.predict(ask, model, score="_s").collect()}
    assert [got[i][0] for i in range(7)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[2][1] == 0 and got[0][1] > 0.9
    none = langid.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(ask, none, score="_s").collect()} == {"und"}
    assert langid.predict(ask.limit(0), model, score="_s").count() == 0


def test_language_scores_by_brute_force():
    model = langid.Model(["a", "b"], np.log(np.random.default_rng(0).dirichlet(np.ones(256), 2)).astype(np.float32), np.log([0.4, 0.6]), 8)
    texts = ["one two", "drei", "", "x" * 1000]
    h, sizes, _ = langid.grams(texts, 8)
    ends = np.cumsum(sizes)
    names, _ = langid.classify(model, texts)
    for i in (0, 1, 3):
        total = [model.weights[c][h[ends[i] - sizes[i] : ends[i]]].astype(float).sum() + model.prior[c] for c in (0, 1)]
        assert names[i] == "ab"[int(np.argmax(total))]
    alone, _, _ = langid.grams(["drei"], 8)
    assert sorted(alone) == sorted(h[ends[0] : ends[1]])  # neighbours in a batch don't matter


# SimHash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition(spark):
    rnd = random.Random(4)
    texts = ["", "one", "a b c d", "Ä B\tc\nD e", "same same same same same same", *(" ".join(rnd.choices(["x", "Yy", "zZz", "q", "w1"], k=k)) for k in (3, 4, 5, 300, 2000))]
    for t in texts:
        assert simhash.fingerprint(t) & (2**64 - 1) == slow_fingerprint(t)
    hashed = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("A b C d") == hashed


def brute_components(fps, bits):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def near_fingerprints(seed, n=300):
    rnd = random.Random(seed)
    out = [0, 2**63, (1 << 64) - 1]
    while len(out) < n:
        base = rnd.getrandbits(64) if rnd.random() < 0.4 else out[rnd.randrange(len(out))]
        for _ in range(rnd.randint(0, 6)):
            base ^= 1 << rnd.randrange(64)
        out.append(base)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def test_golay_keys_lose_no_link():
    fps = near_fingerprints(1, 500)
    keys, rows = simhash.golay_keys(np.array(fps, np.int64))
    own = [set() for _ in fps]
    for k, r in zip(keys.tolist(), rows.tolist()):
        own[r].add(k)
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4:
                assert own[i] & own[j]


@pytest.mark.parametrize("block", [2048, 5])
def test_links_give_the_components_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(_forest, "BLOCK", block)
    fps = sorted(set(near_fingerprints(2)))
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    at = {x: i for i, x in enumerate(fps)}
    got = _forest.forest(len(fps), np.array([at[e["u"]] for e in edges]), np.array([at[e["v"]] for e in edges]))
    assert got.tolist() == brute_components(fps, 4)


def test_groups_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None, "u"), (9002, "  ", "u"), (9003, "one two", "u"), (9003, "one two", "u"), (9004, "ONE two", "v")], "doc_id long, text string, fp string")
    both = docs.withColumn("fp", F.lit("clash")).unionByName(odd)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicate_groups(both).collect()}
    keys = sorted(got)
    roots = brute_components([k[1] for k in keys], 4)
    assert [got[k] for k in keys] == [keys[r][0] for r in roots]
    assert got[(9002, 0)] == got[(9001, 0)]
    assert simhash.near_duplicate_groups(both.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "y"), (3, "quite other words here now", "z"), (3, "quite other words here now", "z"), (None, "a b c d e", "n"), (None, "alone without a key today", "n")], "doc_id long, text string, _gone string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.drop_near_duplicates(df).collect())
    assert [g for g in got if g[0] != "None"] == [("1", "a b c d e"), ("3", "quite other words here now")]
    assert ("None", "alone without a key today") in got


# near copies


def brute_copies(texts, words=5, similarity=0.8):
    """For each text the smallest position reachable over links of that Jaccard similarity."""
    sets, by, at = [], {}, list(range(len(texts)))
    for i, t in enumerate(texts):
        parts = re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))) if parts else frozenset())
        for x in sets[-1]:
            by.setdefault(x, []).append(i)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    empty = [i for i, s in enumerate(sets) if not s]
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in by[x] if j < i)
        linked = [j for j, n in common.items() if n >= similarity * (len(s) + len(sets[j]) - n)]
        for j in linked + (empty[:1] if not s else []):
            a, b = sorted((root(i), root(j)))
            at[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("common, own", [(400, 50), (80, 10), (8, 1)])
def test_links_at_the_threshold_have_a_common_key(common, own):
    rng, missed, n = np.random.default_rng(5), 0, 500
    for _ in range(10):
        both = rng.integers(0, 2**64, (n, common), dtype=np.uint64)
        left, right = (np.concatenate((both, rng.integers(0, 2**64, (n, own), dtype=np.uint64)), axis=1) for _ in range(2))
        a, b = (np.stack([nearcopies.signed_sums(x) for x in side]) for side in (left, right))
        x, y = nearcopies.soft_decode(a), nearcopies.soft_decode(b)
        shared = (x[..., :, None] == y[..., None, :]).any(axis=(2, 3)).reshape(n, -1, 2).all(axis=2).any(axis=1)
        bits = [np.packbits(s[:, : 64 * nearcopies.SKETCH] > 0, axis=1).view(">i8").astype(np.int64) for s in (a, b)]
        columns = [np.full(2 * n, common + own), *np.concatenate(bits).T]
        near = nearcopies.may_link(columns, np.arange(n), np.arange(n, 2 * n), 0.8)
        missed += int((~(shared & near)).sum())
    assert missed <= 5  # of 5,000 pairs; six pairs of segments miss about 50


def components_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r["component_id"] for r in nearcopies.near_copy_groups(df).orderBy("doc_id").collect()]


def test_near_copies_on_documents(spark):
    texts = [r[0] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").select("text").collect()]
    assert components_of(spark, texts) == brute_copies(texts)


@pytest.mark.parametrize("block", [2048, 8])
def test_near_copies_of_all_kinds(spark, block, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(_forest, "BLOCK", block)
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(500)]
    texts = [None, "", " \t ", "one", "ONE", "a b c d e", "A b C d e", "a b c d e f", "x " * 30000, "\u00c9 a", "\u00e9 a"]
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([12, 60, 150, 400]))
        for _ in range(rnd.choice([2, 5, 30])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts += [" ".join(copy)] * rnd.choice([1, 1, 3])
    assert components_of(spark, texts) == brute_copies(texts)


def test_one_near_copy_of_each_group_stays(spark):
    text = "so then the old boat left the quiet harbour while nobody on the long pier was looking at it again today and the water stayed flat"
    rows = [(1, text, "x"), (2, text.upper(), "y"), (2, text.upper(), "y"), (4, text + " still", "z"), (5, "other words", "q"), (5, "other words", "q"), (None, text, "n"), (None, "alone here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = nearcopies.drop_near_copies(df)
    assert kept.columns == df.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
    assert [g for g in got if g[0] != "None"] == [("1", text), ("5", "other words")]
    assert ("None", "alone here") in got
    assert nearcopies.near_copy_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("drop", [nearcopies.drop_near_copies, simhash.drop_near_duplicates])
def test_texts_that_share_a_key_go_one_by_one(spark, drop):
    text = "so then the old boat left the quiet harbour while nobody on the long pier was looking at it again today"
    other = "a wholly different sentence about mountain goats and the price of cheese in some far valley"
    df = spark.createDataFrame([(1, text), (2, text), (2, other), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in drop(df).collect() if r["text"]) == [(1, text), (2, other)]
    assert drop(df).where("doc_id = 3").count() == 1


# LM scoring


def test_lm_scores_by_brute_force(spark):
    rnd = random.Random(6)
    texts = [talk(rnd, EN if i % 2 else DE, 25) for i in range(40)] + [None, "", "unseen"]
    flags = [i % 2 == 1 if i < 40 else None for i in range(43)]
    df = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(zip(texts, flags))], "doc_id long, text string, target boolean")
    m = lmscore.fit(df, "target")
    uni, pair, given = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    vocabulary = sorted({w for t in texts for w in lmscore.tokens(t)})
    for t, f in zip(texts, flags):
        side, prev = int(bool(f)), None
        given[side][None] += 1
        for w in lmscore.tokens(t):
            uni[side][w] += 1
            pair[side][prev, w] += 1
            given[side][w] += 1
            prev = w
    assert m.words == vocabulary
    kept = {p for s in (0, 1) for p, n in pair[s].items() if n >= 2}
    rows = {r["doc_id"]: r for r in lmscore.score(df, m).collect()}
    for i, t in enumerate(texts):
        h = []
        for side in (0, 1):
            total, loss, prev = sum(uni[side].values()), 0.0, None
            for w in lmscore.tokens(t):
                p = (1 - lmscore.BIGRAM) * (uni[side][w] + lmscore.ADDED) / (total + lmscore.ADDED * (len(vocabulary) + 1))
                if (prev, w) in kept:
                    p += lmscore.BIGRAM * pair[side][prev, w] / max(1, given[side][prev])
                loss -= math.log(p)
                prev = w
            h.append(loss / max(1, len(lmscore.tokens(t))))
        assert rows[i]["h_background"] == pytest.approx(h[0]) and rows[i]["h_target"] == pytest.approx(h[1])
        assert rows[i]["score"] == pytest.approx(h[1] - h[0])
    english = [rows[i]["score"] for i in range(1, 40, 2)]
    german = [rows[i]["score"] for i in range(0, 40, 2)]
    assert max(english) < min(german)
    assert lmscore.score(df.limit(0), lmscore.fit(df.limit(0), "target")).count() == 0


def test_lm_scores_hold_when_nothing_is_common_enough_to_broadcast(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(i if i % 9 else None, talk(rnd, EN if i % 2 else DE, 25) + f" rare{i % 13} once{i}", i % 2 == 1) for i in range(60)] + [(1, "", True), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, target boolean")
    other = spark.createDataFrame([(1, "words nobody saw"), (2, "the unseen")], "doc_id long, text string")

    def scored():
        m = lmscore.fit(df, "target")
        return [sorted(([-1 if x is None else x for x in r] for r in lmscore.score(d, m).collect()), key=lambda r: (r[0], r[1], round(r[4], 9))) for d in (df, other)]

    whole = scored()
    assert [len(x) for x in whole] == [62, 2] and all(r[2] > 0 for r in whole[1])
    monkeypatch.setattr(lmscore, "WORD_SHARE", 0.5)
    monkeypatch.setattr(lmscore, "PAIR_SHARE", 0.5)
    for a, b in zip(whole, scored(), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y)


def lm_rows():
    rnd = random.Random(8)
    rare = [f"rare{i}" for i in range(40)]
    texts = [talk(rnd, EN if i % 2 else DE, 12) + " " + " ".join(rnd.choices(rare, k=6)) + f" once{i}" for i in range(150)]
    return [(i if i % 9 else None, t, i % 2 == 1) for i, t in enumerate([*texts, *texts[:40], "the the the the", "", None])]


def by_value(df):
    return sorted(([-1 if x is None else x for x in r] for r in df.collect()), key=lambda r: (r[0], r[1], round(r[4], 9)))


def test_lm_occurrences_meet_over_buckets_and_chunks(spark, monkeypatch):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string, target boolean").repartition(3)
    whole = by_value(lmscore.score(df, lmscore.fit(df, "target")))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "7")
        for word, pair, chunk, bucket, owed in ((1.0, 1.0, 50, 40, 10), (0.02, 0.04, 300, 300, 40), (0.001, 0.001, 1 << 20, 1, 1)):
            for name, value in (("WORD_SHARE", word), ("PAIR_SHARE", pair), ("CHUNK", chunk), ("BUCKET", bucket), ("OWED", owed)):
                monkeypatch.setattr(lmscore, name, value)
            m = lmscore.fit(df, "target")
            chunks = lmscore._occurrences(m.rows, spark.sparkContext.broadcast(m.tables), 3, True, True).where("_kind <> 0").select("_chunk").distinct().count()
            assert chunks > 20 if chunk == 50 else chunks > 6 if chunk == 300 else chunks == 3
            for got in (lmscore.differences(df, "target"), lmscore.score(df, m)):
                for x, y in zip(by_value(got), whole, strict=True):
                    assert x == pytest.approx(y)
    finally:
        spark.conf.set(batch, rows)


def test_lm_occurrences_are_shuffled_once_and_in_few_rows(spark):
    """A row of each document and a block of each bucket, where a row for each different word and bigram of a document was shuffled."""
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string, target boolean").coalesce(2)
    m = lmscore.fit(df, "target")
    assert m.tokens > 3000
    buckets = 4
    got = lmscore._occurrences(m.rows, spark.sparkContext.broadcast(m.tables), buckets, True, True)
    blocks = got.where("_kind <> 0")
    assert got.where("_kind = 0").count() == df.count()
    assert blocks.count() <= 2 * 3 * buckets  # tasks, kinds of bigrams
    assert 0 < blocks.agg(F.sum("_n")).first()[0] <= m.tokens


def test_lm_chunks_number_their_documents_in_the_bits_they_have(spark, monkeypatch):
    """Batches without a bound on their rows: no two documents share a row's number."""
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string, target boolean").coalesce(1)
    whole = by_value(lmscore.differences(df, "target"))
    monkeypatch.setattr(lmscore, "LINES", 4)
    for x, y in zip(by_value(lmscore.differences(df, "target")), whole, strict=True):
        assert x == pytest.approx(y)


def test_lm_columns_are_packed_whole():
    x = np.array([-(2**63), -5, -5, 0, 1, 2**63 - 1], np.int64)
    assert lmscore.unpacked(lmscore.packed(x), len(x)).tolist() == lmscore.unpacked_sorted(lmscore.packed_sorted(x), len(x)).tolist() == x.tolist()
    assert lmscore.unpacked(lmscore.packed(x[:0]), 0).tolist() == []


# toxicity


def test_folding():
    f = toxicity.fold
    assert f("You 1d10t!") == " you idiot "
    assert f("іdіоt") == " idiot "  # Cyrillic letters
    assert f("ＩＤＩＯＴ") == " idiot "
    assert f("id​iot") == " idiot "
    assert f("$tupid l0ser") == " stupid loser "
    assert f("wait!! in 2024 $$$") == " wait in 2024 "
    assert f("") == "  "


def toxic_table(spark, n=300):
    rnd = random.Random(8)
    plain = "the quick river runs over mossy stones toward morning light again while birds sing of summer".split()
    texts, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(5, 60))
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["blargon", "snerkish", "blargony"]))
        if i % 6 == 1:
            words.insert(0, "blargonfish")
        texts.append(" ".join(words))
        labels.append((i, int(i % 6 == 0)))
    return frame(spark, texts), spark.createDataFrame([*labels, (None, 1), (7, None), (99_999, 1)], "doc_id long, toxic int")


def test_toxicity_learns_words_and_exceptions(spark):
    docs, labels = toxic_table(spark)
    lexicon = toxicity.learn(docs, labels)
    assert any(e.strip().startswith("blargon") for e in lexicon.weights)
    ask = frame(spark, ["you bl4rg0n snerkish blargon", "the quick river runs", "blargonfish over mossy stones", None, "", "the river " * 5000])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(ask, lexicon).collect()}
    assert got[0] >= 0.7 and all(got[i] < 0.7 for i in range(1, 6))
    assert toxicity.score(ask.limit(0), lexicon).count() == 0
    empty = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(ask, empty).collect()} == {0.0}
    kept = toxicity.attach(ask.withColumn("extra", F.lit(1)), lexicon, out="_t")
    assert kept.columns == ["doc_id", "text", "extra", "_t"] and kept.count() == 6


def test_longest_entry_counts_once():
    a = toxicity.Lexicon({" bad": 2.0, " badly": 3.0, " worse ": 1.0}, [" badminton "]).automaton()
    assert toxicity.features(a, "badly")[0] == pytest.approx(math.log1p(3.0))
    assert toxicity.features(a, "badminton")[2] == 0
    assert toxicity.features(a, "bad worse worse")[2] == 3


# HTML


def test_blocks_of_broken_markup():
    page = "<body><nav><a href='>'>Menu</a></nav><p>One<p>Two <b>bold<br>x</b></p><!-- no --><script>var a='</p>'</script><div class=ad>Ad</div>cut &amp &#233; <ul><li>a<li>b"
    assert [(b[0][-1].split()[0], b[1]) for b in htmltext.blocks(page)] == [("nav", "Menu"), ("p", "One"), ("p", "Two bold x"), ("div", "Ad"), ("body", "cut & é"), ("li", "a"), ("li", "b")]
    assert htmltext.blocks("") == [] and htmltext.blocks("<p>  </p>") == []
    assert htmltext.blocks("no markup at all")[0][1] == "no markup at all"


def test_blocks_keep_text_around_odd_markup():
    def texts(page):
        return [t for _, t, _ in htmltext.blocks(page)]

    assert texts('<p>a <svg viewBox="0 0 1 1"/>b</p><p>c <svg><path d="x"/></svg>d') == ["a b", "c d"]
    assert texts("<p>so <math/>on <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><p>c") == ["so on x=2", "c"]
    assert texts("<p>x</p><iframe src=a><p>y</p>") == ["x", "y"]
    for name in ("noscript", "object", "canvas"):
        assert texts(f"<p>x</p><{name}><p>y</p>") == texts(f"<p>x</p><{name}><p>y</p></{name}>") == ["x", "y"]
    assert texts("<p>x<script>if (a < b) {} </p><p>y") == ["x"]
    assert texts('<p><a href="x"">l</a> more</p><p>z</p>') == ["l more", "z"]
    assert texts("<p title=it's>one</p><p>two's</p>") == ["one", "two's"]
    assert texts("<p title=\"x>y\" id = 'b>c'>t</p>") == ["t"]


def test_chain_gradient_and_decoding():
    rng = np.random.default_rng(1)
    m = htmltext.Chain()
    m.emit[:5] = rng.normal(size=(5, 2))
    m.step, m.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    rows = [[0], [1, 2], [3], [4, 0]]
    s = m.scores(rows)

    def value(y):
        return m.start[y[0]] + sum(s[t, y[t]] for t in range(4)) + sum(m.step[y[t], y[t + 1]] for t in range(3))

    every = [[i >> t & 1 for t in range(4)] for i in range(16)]
    assert m.decode(rows) == max(every, key=value)
    node, edge = m._marginals(s[None], np.ones((1, 4), bool))
    weights = np.exp([value(y) for y in every])
    weights /= weights.sum()
    assert np.allclose(node[0, :, 1], [sum(w for w, y in zip(weights, every) if y[t]) for t in range(4)])
    assert np.allclose(edge, [[sum(w * sum(y[t] == a and y[t + 1] == b for t in range(3)) for w, y in zip(weights, every)) for b in (0, 1)] for a in (0, 1)])


def test_extraction_on_pages_not_learned_from():
    model = htmltext.trained()
    right = n = 0
    for page, main in htmltext.labelled_pages(120, seed=404):
        found = htmltext.blocks(page)
        for (_, text, _), label in zip(found, model.decode(htmltext.featured(found))):
            right += (text in main) == bool(label)
            n += 1
    assert right / n > 0.98


DAY = "It was a long day near the river and nobody came. We waited until the evening."


@pytest.mark.parametrize(
    "body, want",
    [
        (f'<article><h1>A day</h1><p>{DAY}</p><div class="advertisement"><p>Buy our fine boats today. Now cheaper.</p></div><p>{DAY} {DAY}</p></article>', ["A day", DAY, f"{DAY} {DAY}"]),
        (f'<article><h1>A day</h1><p>{DAY}</p></article><div class="comments"><p>I liked this very much.</p><p>Me too, thanks for it.</p></div>', ["A day", DAY]),
        (f'<article><h1>A day</h1><p>{DAY}</p></article><div id="user-feedback"><div class="post">I liked this very much.</div><div class="post">Me too, thanks.</div></div>', ["A day", DAY]),
        (f"<article><h1>A day</h1><p>{DAY}</p><ul><li>one</li><li>two</li></ul><p>{DAY}</p></article>", ["A day", DAY, "one", "two", DAY]),
        (f"<div>{DAY}</div><div>{DAY} {DAY}</div>", [DAY, f"{DAY} {DAY}"]),
        (f"<article><p title=don't>{DAY}</p><p>{DAY}</p><p class='it's'>{DAY}</p></article>", [DAY, DAY, DAY]),
        (f"<article><p>{DAY}</p><p>" + "word and more of it. " * 400 + "</p></article>", [DAY, ("word and more of it. " * 400).strip()]),
    ],
)
def test_pages_of_another_make(body, want):
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>{body}<footer>All rights reserved 2024.</footer></body></html>"
    assert htmltext.main_text(htmltext.trained(), page).split("\n\n") == want


SHORT = "The bridge opens on Monday. Walkers may cross it from then."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div>{SHORT}</div>", [SHORT]),
        (f"<p>{SHORT}</p>", [SHORT]),
        (SHORT, [SHORT]),
        (f"<html><head><title>News</title></head><body><p>{SHORT}</p></body></html>", [SHORT]),
        (f"<html><body>{SHORT}</body></html>", [SHORT]),
        (f"<article><h1>A day</h1><!--><p>{DAY}</p><!---><p>{SHORT}</p><!-- x --!><p>{DAY} {DAY}</p><!-- <p>gone</p> --></article>", ["A day", DAY, SHORT, f"{DAY} {DAY}"]),
        (f"<article><h1>A day</h1><p>{DAY}</p></article><form><textarea name=x>Write here. It is free of charge.</textarea></form><noscript>Please enable JavaScript. It is needed.</noscript>", ["A day", DAY]),
        (f'<article><h1>A day</h1><p>{DAY}</p><p>{DAY} {DAY}</p></article><div id="disqus_thread"><div class="post">I liked this very much.</div><div class="post">Me too, thanks for it.</div></div>', ["A day", DAY, f"{DAY} {DAY}"]),
    ],
)
def test_short_pages_odd_comments_and_threads(page, want):
    assert htmltext.main_text(htmltext.trained(), page).split("\n\n") == want


def test_unclosed_elements_are_looked_for_once():
    began = time.process_time()
    for name in ("svg", "iframe", "noscript", "template"):
        page = f"<p>{DAY}</p>" + f"<{name}>" * 40_000
        assert htmltext.blocks(page)[0][1] == DAY
    assert htmltext.blocks(f"<p>{DAY}</p><textarea>{DAY}")[1:] == []
    assert time.process_time() - began < 4


def plain_article(page):
    """The article element of the driver's pages by plain cuts: a reference that shares no code with the operator."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    for gone in (r"<!--.*?-->", r"<(script|style|aside|form|nav)\b.*?</\1>", r'<(div|section)\s+(?:class|id)="?(?:ad|promo|comments?)\b.*?</\1>'):
        inner = re.sub(gone, "\n\n", inner, flags=re.S)
    inner = re.sub(r"<br[^>]*>", " ", inner)
    inner = re.sub(r"</?(?:p|h[1-6]|div|ul|ol|li|blockquote|pre|table|tr|td|section|figure)\b[^>]*>", "\0", inner)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in inner.split("\0")]
    return [x for x in parts if x]


def test_pages_of_the_tables_against_a_plain_extractor(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    pages = [p for p in pages if p and len(re.findall("<article>", p)) == 1 and "</article>" in p]
    model = htmltext.trained()
    same = [[x for x in htmltext.main_text(model, p).split("\n\n") if x] == plain_article(p) for p in pages]
    assert len(pages) > 20 and sum(same) >= 0.97 * len(same)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<html><body><nav><a href=x>Home</a></nav><article><h1>Title here</h1><p>First&nbsp;  one.\n\tGoes on.</p><p>Second one.</p></article><footer>&copy; x</footer>", "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in htmltext.extract(pages).collect())
    assert got == [(1, "Title here\n\nFirst one. Goes on.\n\nSecond one."), (2, ""), (3, ""), (3, "")]


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "best-fit packing"]
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", "en", "s", 5), (9003, "idiot moron scum trash loser clown stupid", "en", "s", 3)], docs.schema)
    now, sizes = docs.unionByName(odd), []
    for n, (_, stage) in enumerate(p.STAGES):
        before = now
        stage(spark, before, MIDDLE).write.parquet(f"{tmp_path}/{n}")
        now = spark.read.parquet(f"{tmp_path}/{n}")
        sizes.append(now.select("doc_id").distinct().count())
        if n < 3:
            assert now.columns == docs.columns
    first = {r[0] for r in spark.read.parquet(f"{tmp_path}/0").select("doc_id").collect()}
    assert first == {r[0] for r in docs.select("doc_id").collect()} | {9003}  # clean documents stay
    second = {r[0] for r in spark.read.parquet(f"{tmp_path}/1").select("doc_id").collect()}
    assert 9003 not in second
    clean = {r[0] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").where("toxic = 0").select("doc_id").collect()}
    assert not (first - second) & clean
    third = spark.read.parquet(f"{tmp_path}/2")
    before = [(r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/1").orderBy("doc_id").select("doc_id", "text").collect()]
    roots = brute_copies([t for _, t in before])
    assert sorted(r[0] for r in third.select("doc_id").collect()) == [d for i, (d, _) in enumerate(before) if roots[i] == i]
    assert sizes[2] == sizes[3] == third.count()


def test_pipeline_with_clashing_columns_and_no_rows(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    clash = docs.withColumns({"lang_found": F.lit(1), "LANG_SCORE": F.lit(2), "toxic_score": F.lit(3), "_label": F.lit(4), "_text": F.lit(5)})
    for _, stage in p.STAGES[:3]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns and 0 < out.count() <= 30
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("size, links", [(1, 0), (200, 140), (40, None)])
def test_components_of_links(spark, size, links):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(size - 1)] if links is None else [(rnd.randrange(size), rnd.randrange(size)) for _ in range(links)]
    at = list(range(size))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for e in edges:
        a, b = sorted(map(root, e))
        at[b] = a
    got = {r["node"]: r["label"] for r in label_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}
