"""The filter audit and the alignment of tokens against brute force, the libraries and DuckDB."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaykit.llm import alignment, audit, queries

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS, LABELS = "doc_id long, text string, lang string, part string, mask string, _fp string", "doc_id long, quality int, toxic int"


def audit_rows():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "SHOUT " * 120, "a|b", "é" * 30, " ".join(words[:150])] + [" ".join(rnd.choices(words[: rnd.choice((40, 300))], k=rnd.randint(60, 160))) + rnd.choice(("", " #", " ABCDEFG" * 20)) for _ in range(25)]
    rows = [(i, rnd.choice(texts), rnd.choice(("en", "de", None, ""))) for i in rnd.sample(range(10_000), 300)]
    rows += [(rnd.randrange(10_000), texts[6], "hot") for _ in range(200)]  # copies of one text, some with equal ids
    rows += rows[:20] + [(None, texts[6], "en"), (None, "only without id", "en"), (None, None, None)]
    labels = [(r[0], rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for r in rnd.sample(rows, 200)] + [(None, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    masks = []
    for k, t, part in rows:
        t = t or ""
        words = "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in t).split(" ")
        words = [w for w in words if w]
        fails = {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), k is not None and k > least[t])) if x}
        masks.append((part or "", fails, any(x[0] == k and k is not None and x[1] == 1 for x in labels), any(x[0] == k and k is not None and x[2] == 1 for x in labels)))
    out, shapley = {}, Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [m for m in own if f in m[1] and not m[1] & set(order[: step - 1])]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [sum(not m[1] & set(order[:step]) for m in own), len(gone), sum(f in m[1] for m in own) - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("tasks", [1, 7, 60])
def test_audit_equals_brute_force_over_any_ranges(spark, tmp_path, tasks):
    rows, labels = audit_rows()
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in queries.op11_filter_audit(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_audit(rows, labels)
    if tasks == 7:
        c = duckdb.connect()
        for name in ("documents", "labels"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert {r[:3]: r[3:] for r in c.execute(queries.oracle_sql()["op11_filter_audit"]).fetchall()} == got


def test_audit_of_few_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], LABELS)
    assert audit.audit(none, marks, lost=F.col("toxic") == 1).count() == 0
    one = audit.audit(spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string"), marks).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120 and {r.shapley for r in one} == {0, 120}


def library_tokens(text):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    whole = " " + text
    e = a.encode(whole, add_special_tokens=False)
    sizes = []
    table = alignment.bytes_of_a(BYTE)[1]
    sizes = [int(table[i + 1] - table[i]) for i in e.ids]
    ids = b.encode(text)
    spelled = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids)]
    return e.ids, sizes, ids, [len(x) for x in spelled], b"".join(spelled) == whole.encode()


def brute_alignment(texts):
    made = []
    for t in texts:
        if not t:
            made.append(None)
            continue
        a, size_a, b, size_b, same = library_tokens(t)
        if not same:
            made.append(None)
            continue
        spans = lambda sizes: [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(len(sizes))]
        sa, sb = spans(size_a), spans(size_b)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i][0] < sb[j][1] and sb[j][0] < sa[i][1]]
        cuts = sorted({z for _, z in sa} & {z for _, z in sb})
        groups = [",".join(str(x) for x, s in zip(a, sa) if lo < s[1] <= hi) + "|" + ",".join(str(x) for x, s in zip(b, sb) if lo < s[1] <= hi) for lo, hi in zip([0, *cuts], cuts)]
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for m in made if m for p in m[3])
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    return [(0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(counts[p] == top[p[1]] for p in m[3]), sum(counts[p] for p in m[3]), m[4]) for m in made]


def odd_texts():
    rnd = random.Random(8)
    parts = ["a", "bb", "Hello", "it's", " ", "  ", "   ", "\n", "\n  ", "\t ", "é", "e\u0301", "中文字", "😀", "½", "12345", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\u00a0", "\u3000", "\x00", "x" * 40, "ﬁ", "\U00013708", "…", "don't stop", " the the"]
    return [None, "", " ", "  ", "▁", "a ▁ b", "a ", " a", "\n", "word"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 25))) for _ in range(250)] + ["the same text", "the same text"]


def test_alignment_equals_the_libraries_pair_by_pair(spark, tmp_path):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i % 50 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_a string, _text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted((str(i if i % 50 else None), *x) for i, x in enumerate(brute_alignment(texts)))
    got = queries.op13_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expected
    sliced = alignment.align(df, BYTE, PIECE, pairs=100)  # many broadcast tables, each adds its share
    assert sorted((str(r[0]), *r[1:]) for r in sliced.collect()) == expected


def test_alignment_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, BYTE, PIECE).count() == 0
    assert alignment.links(none, BYTE, PIECE).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(blank, BYTE, PIECE).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_chunks_are_encoded_as_in_whole_texts():
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=PIECE), alignment.PieceEncoder(PIECE, limit=50)
    texts = [t for t in odd_texts() if t and "▁" not in t]
    for t in texts:
        ids, counts, same = enc.texts([t, t])
        assert same.all()
        assert ids.tolist() == lib.encode(t) * 2 and counts.tolist() == [len(ids) // 2] * 2
    assert not any("▁" in lib.id_to_piece(i).lstrip("▁") for i in range(lib.vocab_size()))
