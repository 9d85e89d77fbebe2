"""Every query of the numbered operators over small tables with nulls, repeated rows, clashing columns, and over empty ones."""

import json
import random

import pytest

from assaykit.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, component_id long, part string, ids string, length long, label int"
PAGES = "page_id long, url string, html string, text string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int, query_id long, shard int, vector string"
LABELS = "doc_id long, quality int, toxic int, text string, good_lost string"
ROWS = {"op1": "documents", "op2": None, "op3": "documents", "op4": "documents", "op5": "pages", "op6": None, "op7": "documents", "op8": None, "op9": "documents", "op10": "documents", "op11": None, "op12": "documents", "op13": "documents"}
COLUMNS = {
    "op1": "doc_id held_out lang_pred score",
    "op2": "query_id rank vec_id score",
    "op4": "doc_id fingerprint component_id",
    "op5": "page_id url text n_chars",
    "op6": "query_id rank vec_id score",
    "op7": "doc_id held_out score predicted",
    "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "doc_id start n_tokens ids_crc32",
    "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12": "doc_id n_shingles component_id",
    "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def tables(spark, folder, empty):
    rnd = random.Random(1)
    words = "the and river town gate morning evening paper stone light bird road".split()
    texts = [None, "", "   ", "\\u00e9\\u00e8 \\u4e2d", "x" * 3000, "same text here and there", "same text here and there", "12 34"] + [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(30)]
    docs = [(i * 3 if i % 9 else None, t, rnd.choice(("en", "de", None)), "s", 1, 0.5, 1, 2, "p", "i", 3, 4) for i, t in enumerate(texts)]
    docs += docs[4:8]
    pages = [(i, f"http://h/{i}", h, "clash", 7) for i, h in enumerate((None, "", "<p>A short page. It has two sentences.</p>", "<article><h1>T</h1><p>Long ago. It was so.</p></article>"))]
    pages += [(None, None, "plain text only. Nothing else.", "c", 1), pages[2]]
    vectors = [(i if i % 7 else None, [rnd.uniform(-1, 1) for _ in range(4)], 1, 0.1, 1, 2, 3, "v") for i in range(0, 130)]
    vectors += [(200, None, 1, 0.1, 1, 2, 3, "v"), (220, [float("nan"), 1.0, 1.0, 1.0], 1, 0.1, 1, 2, 3, "v"), (240, [0.0] * 4, 1, 0.1, 1, 2, 3, "v"), (260, [1.0, None, 1.0, 1.0], 1, 0.1, 1, 2, 3, "v"), vectors[20]]
    labels = [(i * 3, i % 2, i % 3 == 0 and 1 or 0, "t", "g") for i in range(30)] + [(None, 1, 1, "t", "g"), (3, None, None, "t", "g"), (6, 1, 1, "t", "g")]
    for name, rows, schema in (("documents", docs, DOCS), ("pages", pages, PAGES), ("embeddings", vectors, VECTORS), ("labels", labels, LABELS)):
        spark.createDataFrame([] if empty else rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return {"documents": docs, "pages": pages}


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    f = str(tmp_path_factory.mktemp(request.param))
    return f, tables(spark, f, request.param == "empty"), request.param == "empty"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_over_odd_and_empty_tables(spark, folder, name):
    path, rows, empty = folder
    op = name.split("_")[0]
    got = queries.queries()[name](spark, path)
    if op in COLUMNS:
        assert got.columns[: len(COLUMNS[op].split())] == COLUMNS[op].split()
    found = got.collect()
    if empty:
        assert found == []
        return
    assert found
    if ROWS[op]:
        table = rows[ROWS[op]]
        key = "page_id" if ROWS[op] == "pages" else "doc_id"
        assert sorted(map(str, (r[key] for r in found))) == sorted(str(t[0]) for t in table)
    if op in ("op2", "op6"):
        assert {r.query_id for r in found}.isdisjoint({200, 220, 260}) and all(r.query_id != r.vec_id for r in found)
    json.dumps([str(r) for r in found])
