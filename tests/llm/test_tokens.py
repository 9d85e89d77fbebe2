"""BPE codec, packing and record files against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaykit.llm import bpe, packing, records
from assaykit.llm._bpe import Encoder, vocabulary
from assaykit.llm._cluster import new_dir

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
CASES = ["", "   ", None, "Hello, WORLD! it's 3.14", "a" * 50, "don't we'll 'S 's", "<|endoftext|> mid <|startoftext|><|ENDOFTEXT|>", "x<|endoftext|>y", "ΑΣ ΣΑΣ é é", "\x1cx 　 y\x85z\n\n", "12345 ½ Ⅷ ٣", "😀👍🏽 中文 字", "  two  spaces \t tab"]


def odd_texts(n=400):
    rnd = random.Random(5)
    letters = [chr(c) for c in range(0x250)] + list("̀́Σ中😀 　​İẞﬁ½")
    return ["".join(rnd.choice(letters) if rnd.random() < 0.3 else rnd.choice("aaa bb's  \n\tT1ll'") for _ in range(rnd.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoding_equals_the_library(path):
    lib, enc = Tokenizer.from_file(path), Encoder(vocabulary(path))
    texts = [t or "" for t in CASES] + odd_texts()
    ids, counts = enc.texts(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, e in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, repr(texts[i])
    enc.limit = 0  # forgets between batches
    again, _ = enc.texts(texts)
    assert again.tolist() == ids.tolist()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_code_point_encodes_as_in_the_library(path):
    lib, enc = Tokenizer.from_file(path), Encoder(vocabulary(path))
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x40000 or i >= 0xE0000 or i % 97 == 0)]
    forms = ("{0}", "a{0}b 1{0}2", "{0}'t {0}\u0301", "\u8f3c{0}{0} {0}", "E\u0323{0}\u0307")
    for form in forms:
        for k in range(0, len(points), 65_536):
            texts = ["|".join(form.format(chr(i)) for i in points[k : k + 65_536][n : n + 64]) for n in range(0, 65_536, 64)]
            ids, counts = enc.texts(texts)
            for t, e, own in zip(texts, lib.encode_batch(texts, add_special_tokens=False), np.split(ids, np.cumsum(counts)[:-1])):
                assert own.tolist() == e.ids, ascii(t)


def test_special_strings_as_text():
    lib = Tokenizer.from_file(BYTE)
    lib.encode_special_tokens = True
    text = "a<|endoftext|> b"
    assert Encoder(vocabulary(BYTE), specials=False).texts([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_codec_rows(spark, path):
    lib = Tokenizer.from_file(path)
    texts = CASES + odd_texts(50)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_op10_digests(spark, tmp_path):
    from assaykit.llm.queries import op10_bpe_codec

    lib = Tokenizer.from_file(WORD)
    spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op10_bpe_codec(spark, str(tmp_path)).collect():
        ids = lib.encode(CASES[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pieces_and_packing(spark):
    lib = Tokenizer.from_file(BYTE)
    rnd = random.Random(1)
    texts = CASES + [" ".join(rnd.choices(["alpha", "beta", "gamma,", "\n"], k=rnd.randint(1, 90))) for _ in range(150)] + ["same text"] * 60
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack_documents(df, BYTE, size=64).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert own[0]["start"] == 0 and sum(r["length"] for r in own) == len(ids)
        for r in own[1:]:
            assert r["length"] == 64
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 64) + 1


def test_fullest_combination_against_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        counts = {n: rnd.randint(1, 3) for n in rnd.sample(range(1, 30), 5)}
        room = rnd.randint(1, 60)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * i for s in sums for i in range(k + 1) if s + n * i <= room}
        found = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(n * k for n, k in found.items()) == max(sums)
        assert all(k <= counts[n] for n, k in found.items())


def test_record_files(spark):
    lib = Tokenizer.from_file(WORD)
    texts = CASES + odd_texts(60)
    ids_of = [7 * i - 100 for i in range(len(texts))]
    df = spark.createDataFrame([*zip(ids_of, texts), (None, "no key"), (ids_of[3], "same key")], "doc_id long, text string").repartition(5)
    folder = new_dir(spark, "records-test")
    manifest = records.write_records(df, WORD, folder, per_shard=20)
    assert len(manifest) > 2
    rows = records.read_records(spark, manifest).orderBy("start").collect()
    keys = [r["key"] for r in rows]
    assert keys == [None, *sorted([*ids_of, ids_of[3]])]
    start = 0
    for r in rows:
        assert r["start"] == start and r["ids"][-1] == 1
        start += len(r["ids"])
    text_of = dict(zip(ids_of, texts))
    for r in rows:
        if r["key"] not in (None, ids_of[3]):
            assert r["ids"][:-1] == lib.encode(text_of[r["key"]] or "", add_special_tokens=False).ids
    mixed = records.read_records(spark, manifest, shuffle=4).collect()
    assert sorted((str(r["key"]), r["start"], tuple(r["ids"])) for r in mixed) == sorted((str(r["key"]), r["start"], tuple(r["ids"])) for r in rows)
    assert records.token_records(df.limit(0), WORD).count() == 0


def test_damaged_record_is_found():
    data = bytearray(records.frame(b"abcdef"))
    assert bytes(records.unframe(memoryview(bytes(data)), 0)[0]) == b"abcdef"
    for at in (3, 15):
        hurt = bytearray(data)
        hurt[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(hurt)), 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_encode(df, WORD).count() == 0
    assert packing.pack_documents(df, BYTE).count() == 0
    assert packing.pack_documents(df, BYTE).agg(F.max("sequence_id")).first()[0] is None
