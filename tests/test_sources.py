"""Loaders on small files, and the log as a stream."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.records import newest
from assaykit.sources import files
from assaykit.streaming.latest import merge_newest, newest_state, running_total, upsert_newest

PAIR = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("n", T.IntegerType())])
ROW = T.StructType([T.StructField("key", T.StringType()), T.StructField("t", T.LongType()), T.StructField("v", T.IntegerType())])


@pytest.mark.parametrize("body", [[{"id": "a", "n": 1}, {"id": "b"}], {"pairs": [{"id": "a", "n": 1}, {"id": "b"}]}, {"items": [{"id": "a", "n": 1}, {"id": "b", "n": None}]}])
def test_json_wrappers(spark, tmp_path, body):
    (tmp_path / "x.json").write_text(json.dumps(body, indent=1))
    assert sorted((r["id"], r["n"]) for r in files.json_documents(spark, str(tmp_path), PAIR).collect()) == [("a", 1), ("b", None)]


def test_json_lines_with_torn_end(spark, tmp_path):
    with gzip.open(tmp_path / "log.jsonl.gz", "wt") as f:
        f.write('{"key": "a", "t": 1, "v": 2}\n\n   \n{"key": "b", "t": 2, "v": 3}\n{"key": "c", "t"')
    rows, torn = files.json_lines(spark, str(tmp_path), ROW)
    assert sorted(r["key"] for r in rows.collect()) == ["a", "b"]
    assert [r["value"] for r in torn.collect()] == ['{"key": "c", "t"']


def test_csv_with_large_fields(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    big = "x" * 200_000
    (tmp_path / "deep" / "er" / "a.csv").write_text(f'id,text\n1,"line one\nline ""two"", end"\n2,"{big}"\n')
    (tmp_path / "deep" / "skip.txt").write_text("no")
    rows = {r["id"]: r["text"] for r in files.csv_release(spark, str(tmp_path), T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType())]), "*.csv").collect()}
    assert rows == {1: 'line one\nline "two", end', 2: big}


def test_named_texts_and_reports(spark, tmp_path):
    for name in ("s1__a b.txt", "s1__b.txt", "s1__b__variant.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    assert sorted((r["source"], r["id"]) for r in files.named_texts(spark, str(tmp_path)).collect()) == [("s1", "a b"), ("s1", "b")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "rep.md").write_text("# T\n| name | value |\n|---|---|\n| rate | 0.5 |\n| n | 12 |\n")
    assert [(r["name"], r["value"]) for r in files.report_rows(spark, str(tmp_path / "r")).orderBy("place").collect()] == [("name", "value"), ("rate", "0.5"), ("n", "12")]


def test_answers_and_long_table(spark):
    lines = spark.createDataFrame([("1. y sure",), ("2) N",), ("2: ?",), ("",), ("what",)], "value string")
    got = sorted((r["item"] or 0, r["answer"] or "", r["problem"] or "") for r in files.answers(lines).collect())
    assert got == [(0, "", "unreadable"), (1, "Y", ""), (2, "?", "answered twice"), (2, "N", "answered twice")]
    wide = spark.createDataFrame([("a", 1, 2.5)], "k string, x int, y double")
    assert sorted((r["measure"], r["value"]) for r in files.long_table(wide, ["k"]).collect()) == [("x", "1"), ("y", "2.5")]


def test_stream_keeps_the_newest(spark, tmp_path):
    log, state = tmp_path / "log", tmp_path / "state"
    log.mkdir()
    rows = [("a", 1, 1), ("b", 5, 2), ("a", 3, 3), ("a", 2, 4), ("b", 5, 5), ("c", 1, 6)]
    for n, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        (log / f"{n}.json").write_text("".join(json.dumps(dict(zip(("key", "t", "v"), r))) + "\n" for r in part))
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(log))
    order = [F.desc("t"), F.desc("v")]
    last = merge_newest(stream, str(state), ["key"], order)
    assert last == 2
    got = sorted(map(tuple, spark.read.parquet(f"{state}/version={last}").collect()))
    assert got == sorted(map(tuple, newest(spark.createDataFrame(rows, ROW), ["key"], order).collect())) == [("a", 3, 3), ("b", 5, 5), ("c", 1, 6)]


def test_keyed_state_rewrites_only_the_buckets_that_a_batch_touches(spark, tmp_path):
    log, folder = tmp_path / "log", tmp_path / "state"
    log.mkdir()
    order = [F.desc("t"), F.desc("v")]
    schema = "key string, t long, v long"

    def batch(n, rows):
        (log / f"{n}.json").write_text("".join(json.dumps(dict(zip(("key", "t", "v"), r))) + "\n" for r in rows))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(log))  # a new query each time: a restart
        return upsert_newest(stream, str(folder), ["key"], order, buckets=8)

    def files():
        return {(p.parent.name, p.name) for p in (folder / "data").glob("version=*/bucket=*")}

    def told():
        return sorted(map(tuple, newest_state(spark, str(folder), spark.createDataFrame([], schema).schema).collect()))

    assert newest_state(spark, str(folder), spark.createDataFrame([], schema).schema).count() == 0
    rows = [(f"k{i}", 10, i) for i in range(60)]
    assert batch(0, rows) == 0
    first = files()
    assert len(first) == 8 and told() == sorted(rows)
    changed = [("k1", 11, 100), ("k1", 9, 101), ("k2", 3, 102)]  # newer, late, late
    assert batch(1, changed) == 1
    now = sorted([r for r in rows if r[0] != "k1"] + [("k1", 11, 100)])
    assert told() == now
    written = {f for f in files() if f[0] == "version=1"}
    assert 1 <= len(written) <= 2  # the buckets of k1 and k2
    assert batch(2, [("k1", 11, 100), ("new", 1, 1)]) == 2  # a repeated row and a new key
    assert told() == sorted([*now, ("new", 1, 1)])
    live = {f for f in files()}
    assert len(live) <= 8 + 2 + 2 and len([f for f in live if f[0] == "version=0"]) == 8 - len(written)  # what batch 1 replaced has gone
    assert len(list((folder / "manifest").glob("batch=*"))) == 2
    assert batch(3, []) in (-1, 3) and told() == sorted([*now, ("new", 1, 1)])


def test_running_total(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"key": "a", "t": 1, "v": 2}\n{"key": "a", "t": 2, "v": 5}\n{"key": "b", "t": 2, "v": 1}\n')
    q = running_total(spark.readStream.schema(ROW).json(str(tmp_path)), "key", "v").writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("totals").collect())) == [("a", 7, 2), ("b", 1, 1)]
