"""The exact Jaccard join against brute force, over keys, allocations, tables and DuckDB."""

import random

import duckdb
import numpy as np
import pytest

from assaykit.llm import jaccardjoin as jj
from assaykit.llm import queries


def shingles(text, words=4):
    low = "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in low.split(" ") if w]
    return frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else frozenset()


def brute(rows, share, words=4):
    """(key, size, smallest key reachable) of rows (key, text)."""
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= share * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((str(k), len(sets[i]), str(least.get(root(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        at = rnd.randrange(len(out))
        what = rnd.random()
        if what < 0.5:
            out[at] = f"n{rnd.randrange(10**6)}"
        elif what < 0.75:
            del out[at]
        else:
            out.insert(at, f"n{rnd.randrange(10**6)}")
        if not out:
            return ["x"]
    return out


def made_rows(seed, groups=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [None, "", " \t", "a", "A", "a  b", "a\tb", "A b C", "a b c d", "a b c d e"]
    passage = rnd.choices(vocabulary, k=60)
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.choice((5, 8, 9, 10, 12, 16, 25, 60, 200)))
        if rnd.random() < 0.3:
            base += passage
        for _ in range(rnd.choice((1, 2, 3, 5))):
            rows.append(" ".join(edited(rnd, base, rnd.randint(0, max(1, len(base) // 50)))))
    base = rnd.choices(vocabulary, k=150)
    rows += [" ".join(base)] * 30 + [" ".join(edited(rnd, base, 1)) for _ in range(60)]  # a hot group of copies and near copies
    chain = list(base)
    for _ in range(15):  # neighbours link, the ends don't
        chain = edited(rnd, chain, 1)
        rows.append(" ".join(chain))
    keys = rnd.sample(range(10**6), len(rows))
    made = list(zip(keys, rows))
    return made + made[40:44] + [(None, made[50][1]), (None, "only without a key here")]


@pytest.mark.parametrize("share", [85, 60, 97, 100])
def test_groups_equal_brute_force(spark, share):
    rows = made_rows(share)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, node string, n int").repartition(6)
    got = jj.jaccard_groups(df, share=share)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(a), b, str(c)) for a, b, c in got.collect()) == brute(rows, share)


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = [(k, t) for k, t in made_rows(3, groups=40) if k is not None]
    rows = list(dict(rows).items())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(a), b, str(c)) for a, b, c in queries.op12_jaccard_join(spark, str(tmp_path)).collect())
    assert got == brute(rows, 85)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((str(a), b, str(c)) for a, b, c in c.execute(queries.oracle_sql()["op12_jaccard_join"]).fetchall()) == got


def test_no_rows_and_blank_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_groups(none).count() == 0
    blank = spark.createDataFrame([(3, None), (2, ""), (1, " "), (None, None)], "doc_id long, text string")
    assert sorted((str(r[0]), r[1], str(r[2])) for r in jj.jaccard_groups(blank).collect()) == [("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("None", 0, "None")]


def test_sets_equal_words_taken_one_by_one():
    rnd = random.Random(2)
    texts = [None, "", " ", "a", "é É", "x" * 5000] + ["".join(rnd.choices("abC  \t\n\x0bé", k=rnd.randint(1, 80))) for _ in range(400)]
    for words in (1, 2, 4, 5):
        hashes, at = jj.shingle_sets(texts, words)
        assert np.diff(at).tolist() == [len(shingles(t, words)) for t in texts]
        by_set = {}
        for t, node in zip(texts, jj.nodes_of(hashes, at).tolist()):
            assert by_set.setdefault(shingles(t, words), node) == node
        assert len(set(by_set.values())) == len(by_set)


@pytest.mark.parametrize("share", [50, 85, 95])
def test_every_allocation_gives_linked_sets_a_common_key(share):
    starts, limit = np.array(jj.bands(share)), np.array(jj.band_most(share))
    met, kinds = 0, set()
    for trial in range(150):
        rnd = np.random.default_rng(trial)
        size = int(rnd.choice((3, 6, 8, 12, 20, 50, 200, 900)))
        a = np.unique(rnd.integers(0, 2**63, size, dtype=np.int64)).view(np.uint64)
        stay = rnd.integers(size * share // 100, size + 1)
        b = np.unique(np.concatenate((rnd.choice(a, stay, replace=False), rnd.integers(0, 2**62, rnd.integers(0, 100 * size // share - size + 1)).view(np.uint64))))
        both = len(np.intersect1d(a, b))
        union = len(a) + len(b) - both
        if not len(b) or 100 * both < share * union or both == union:
            continue
        less, more = sorted((len(a), len(b)))
        k = int(np.searchsorted(starts, less, side="right")) - 1
        above = int(np.searchsorted(starts, more, side="right")) - 1
        assert union - both <= min(limit[k], jj.differing(less, more, share))
        assert above == k or (above == k + 1 and share * more <= 100 * (starts[above] - 1))
        for sets, chance in ((10, 1e-9), (10**6, 1e-4), (10**8, 0.05), (10**9, 0.5)):
            plain, near = jj.allocate(int(limit[k]), float(less), sets, chance)
            kinds.add(near > 0)
            for p, w in ((plain, near), (max(1, limit[k] - 1), 1), (max(0, limit[k] - 3), 2) if limit[k] > 3 else (plain, near)):
                unit, key = jj.segment_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), np.array([k, k]), limit[[k, k]], np.array([p, p]), np.array([w, w]))
                assert set(key[unit == 0].tolist()) & set(key[unit == 1].tolist())
        met += 1
    assert met > 40 and True in kinds


def test_neighbourhoods_are_taken_where_small_sets_share_much():
    assert jj.allocate(1, 7.0, 10**3, 1e-6)[1] == 0
    assert jj.allocate(1, 7.0, 10**7, 0.2)[1] > 0


def test_odd_sketch_never_refuses_a_link(spark):
    rows = [(k, t) for k, t in made_rows(9) if k is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.described(df, 4, 85, "doc_id", "text").collect()
    n = np.array([r["n"] for r in got])
    sketch = [np.array([r[f"s{i}"] for r in got]) for i in range(jj.SKETCH)]
    text = dict(rows)
    sets = [shingles(text[r["doc_id"]]) for r in got]
    i, j = np.triu_indices(len(got), 1)
    may = jj.may_link([n, *sketch], i, j, 85)
    for a, b, said in zip(i.tolist(), j.tolist(), may.tolist()):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            assert said
    assert may.mean() < 0.5


def test_hot_keys_are_shared_whatever_the_batches(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(300), rnd.randrange(40)) for _ in range(3000)] + [(7, n) for n in range(1000)] + [(10**6 + i, 1) for i in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {(k, n) for k, n in rows if len({m for q, m in rows if q == k}) > 1}
    for size in ("1", "3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [tuple(r) for r in jj.shared(spark.createDataFrame(rows[: 400 if size == "1" else None], "key long, node long")).collect()]
        assert len(got) == len(set(got))
        if size != "1":
            assert set(got) == expected
        else:
            assert set(got) == {(k, n) for k, n in rows[:400] if len({m for q, m in rows[:400] if q == k}) > 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
