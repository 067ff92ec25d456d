"""The stored index, the maintained table, and the joins by anchors and by bins, against plain restatements and on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import anchored, greedy, index, intervals, maintained, retrieve, stored_index, stored_vectors

TEXTS = ["", None, "alpha beta", "alpha", "Beta beta gamma", "delta " * 50, "alpha beta gamma delta", "the the the alpha", "x_y alpha 7"]


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "alpha beta"), (2, "w1 w2 w3 W3"), (3, "nothing here at all"), (4, ""), (5, "w5"), (6, "x_y delta w39")], "query_id long, text string")


@pytest.mark.parametrize("weighing", [stored_index.BM25, stored_index.SPARSE])
def test_index_ranks_like_a_scan(docs, asked, weighing, tmp_path):
    scan = retrieve.bm25_joined if weighing is stored_index.BM25 else retrieve.sparse_joined
    index = stored_index.StoredIndex.create(docs.filter("doc_id % 2 = 0"), f"file://{tmp_path}/index", weighing, block=4, buckets=3)
    index.add(docs.filter("doc_id % 2 = 1"))
    columns = "query_id", "doc_id", "score", "rank"
    found, seen = index.ranked(asked, 3)
    assert rows_of(found, *columns) == rows_of(scan(asked, docs, 3), *columns)
    # some blocks were left out, and questions without a known term have none
    told = {r.query_id: (r.blocks, r.read) for r in seen.collect()}
    assert set(told) == {1, 2, 5, 6} and all(read <= blocks for blocks, read in told.values()) and sum(b for b, _ in told.values()) > sum(r for _, r in told.values())

    gone = docs.filter("doc_id % 5 = 0 or doc_id = 3")
    index.remove(gone.select("doc_id"))
    index.remove(gone.select("doc_id"))  # nothing is left to remove
    again = stored_index.StoredIndex.open(docs.sparkSession, index.path, weighing, block=4, buckets=3)
    left = docs.join(gone, "doc_id", "left_anti")
    assert rows_of(again.search(asked, 3), *columns) == rows_of(scan(asked, left, 3), *columns)
    again.add(docs.filter("doc_id = 3 or doc_id = 105"))
    more = left.unionByName(docs.filter("doc_id = 3 or doc_id = 105"))
    assert rows_of(again.search(asked, 3), *columns) == rows_of(scan(asked, more, 3), *columns)
    assert again.totals()[0] == more.count()
    words = more.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if weighing is stored_index.BM25:
        assert rows_of(again.frequencies(), "term", "df") == rows_of(words, "term", "df")


def test_a_second_question_set_reads_no_texts(spark, docs, asked, tmp_path):
    docs.write.parquet(f"{tmp_path}/docs")
    index = stored_index.StoredIndex.create(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/index")
    found = index.search(asked, 5)
    assert f"{tmp_path}/docs" not in "".join(found.inputFiles()) and found.count()


def test_empty_index(spark, docs, asked, tmp_path):
    index = stored_index.StoredIndex.create(docs.limit(0), f"file://{tmp_path}/index")
    assert index.search(asked, 3).count() == 0 and index.totals() == (0, 0)
    index.add(docs)
    assert index.search(asked.limit(0), 3).count() == 0


def test_vectors_rank_like_a_scan(spark, tmp_path):
    rng = np.random.RandomState(7)
    centres = 4 * rng.randn(6, 8)
    rows = [(k, (centres[k % 6] + rng.randn(8)).tolist()) for k in range(240)] + [(300, [0.0] * 8), (301, [1.0, 2.0]), (302, None), (None, [1.0] * 8), (303, []), (304, centres[0].tolist()), (305, centres[0].tolist())]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>")
    q = spark.createDataFrame([(k, rows[k][1]) for k in (0, 1, 2, 300 - 60)] + [(7, [-1.0, 1.0]), (8, None), (9, [1.0] * 3)], "query_id long, qv array<double>")
    index = stored_vectors.VectorIndex.create(v.filter("doc_id % 3 <> 0"), f"file://{tmp_path}/v", pivots=6, block=10)
    index.add(v.filter("doc_id % 3 = 0"), block=10)
    columns = "query_id", "doc_id", "score", "rank"
    given = v.filter("doc_id is not null")
    for k in (3, 300):
        found, seen = index.ranked(q, k)
        assert rows_of(found, *columns) == rows_of(retrieve.cosine_top_k(q, given, k), *columns)
        told = [(r.blocks, r.read) for r in seen.collect()]
        assert all(read <= blocks for blocks, read in told) and (k > 3 or sum(r for _, r in told) < 0.7 * sum(b for b, _ in told))
    assert rows_of(index.ids(), "doc_id") == sorted((r[0],) for r in rows if r[0] is not None and r[1])


# the maintained table


def test_table_follows_its_batches(spark, tmp_path):
    rng = random.Random(2)
    schema = "k long, a string, n long"
    state = {k: ("old", k) for k in range(0, 60)}
    table = maintained.MaintainedTable.create(spark.createDataFrame([(k, *v) for k, v in state.items()] + [(None, "x", 1)], schema), f"file://{tmp_path}/t", "k", buckets=16)
    history = [dict(state)]
    for n in range(1, 9):
        keys = rng.sample(range(80), 3)
        if n % 4 == 0:
            table.compact(f"c{n}")
        elif n % 3 == 1:
            table.upsert(spark.createDataFrame([(k, f"put {n}", n) for k in keys] + [(keys[0], "aaa", n)], schema), f"b{n}")
            state |= {k: (f"put {n}", n) for k in keys}
        elif n % 3 == 2:
            table.delete(spark.createDataFrame([(k,) for k in [*keys, 999, None]], "k long"), f"b{n}")
            for k in keys:
                state.pop(k, None)
        else:
            table.patch(spark.createDataFrame([(k, n) for k in keys], "k long, n long"), f"b{n}")
            state |= {k: (state[k][0], n) for k in keys if k in state}
        history.append(dict(state))
    again = maintained.MaintainedTable.open(spark, table.path)
    for n, then in enumerate(history):
        assert rows_of(again.read(n), "k", "a", "n") == sorted((k, *v) for k, v in then.items())
    made = again.commits()
    assert [c.number for c in made] == list(range(9)) and all(len(c.touched) <= 4 for c in made)
    # a batch that comes again changes nothing
    assert again.upsert(spark.createDataFrame([(1, "never", 0)], schema), "b1").number == 1 and len(again.commits()) == 9
    assert again.vacuum() and rows_of(again.read(), "k", "a", "n") == sorted((k, *v) for k, v in state.items())


def test_only_changed_rows_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a", None) for k in range(20)], "k long, a string, n long")
    table = maintained.MaintainedTable.create(rows, f"file://{tmp_path}/t", "k")
    assert table.patch(spark.createDataFrame([(3, "a"), (4, "b"), (99, "b")], "k long, a string"), "p").rows == {"put": 1}
    assert table.patch(spark.createDataFrame([(4, "b")], "k long, a string"), "q").rows == {}
    assert rows_of(table.read().filter("a = 'b'"), "k") == [(4,)]


def test_two_writers_of_one_number(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k long, a string")
    one = maintained.MaintainedTable.create(rows, f"file://{tmp_path}/t", "k")
    other = maintained.MaintainedTable.open(spark, one.path)
    seen = other.commits()
    one.upsert(spark.createDataFrame([(2, "b")], "k long, a string"), "first")
    other.commits = lambda snapshot=None: seen  # it looked before the other one wrote
    with pytest.raises(maintained.Conflict):
        other.upsert(spark.createDataFrame([(3, "c")], "k long, a string"), "second")
    assert rows_of(one.read(), "k") == [(1,), (2,)]


def test_a_table_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "k long, a string")
    table = maintained.MaintainedTable.create(none, f"file://{tmp_path}/t", "k")
    assert table.read().count() == 0
    table.delete(none.select("k"), "d")
    table.upsert(spark.createDataFrame([(1, None)], "k long, a string"), "u")
    table.compact("c")
    assert rows_of(table.read(), "k", "a") == [(1, None)]


# containment


def test_contained_passages_by_brute_force(spark):
    rng = random.Random(6)
    texts = [(k, "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 120)))) for k in range(60)] + [(7, "second row of an id"), (61, None), (None, "no id é")]
    passages = []
    for q in range(80):
        t = rng.choice(texts)[1] or "zz"
        a = rng.randint(0, max(0, len(t) - 1))
        passages.append((q, t[a : a + rng.randint(0, 50)]))
    passages += [(900, "never in there"), (901, None), (902, ""), (903, texts[0][1] + "x"), (904, "row of"), (904, "a"), (0, "b")]
    got = anchored.contained(spark.createDataFrame(passages, "query_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string"))
    want = {(q, d) for q, p in passages if p for d, t in texts if d is not None and t and p in t}
    assert rows_of(got, "query_id", "doc_id") == sorted(want)


def test_nothing_is_contained(spark):
    some, none = spark.createDataFrame([(1, "a")], "query_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert anchored.contained(some, none).count() == 0
    assert anchored.contained(some.limit(0), some.withColumnRenamed("query_id", "doc_id")).count() == 0


def test_greedy_containment_is_the_fold_s(spark):
    rng = random.Random(12)
    rows = [(q, k, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 7))) if q < 3 else rng.choice("xyz") * rng.randint(1, 60)) for q in range(5) for k in range(60)]
    rows += [(7, 1, None), (7, 2, " "), (7, 3, "A  b"), (7, 3, "a a b"), (7, 4, "a b c"), (8, 1, "same"), (8, 2, "SAME")]
    table = spark.createDataFrame(rows, "q long, o long, t string")
    assert rows_of(greedy.containment_dedupe(table, "q", "o", "t"), "q", "o") == rows_of(index.containment_dedupe(table, "q", "o", "t"), "q", "o")
    assert greedy.containment_dedupe(table.limit(0), "q", "o", "t").count() == 0


# ranges


def test_ranges_by_brute_force(spark):
    rng = random.Random(9)
    ranges = [(k, rng.choice("ab"), (a := rng.randint(-100, 100)), a + rng.choice([-3, 0, 1, 7, 64, 500])) for k in range(120)] + [(500, "a", None, 3), (501, None, 0, 9)]
    points = [(k, rng.choice("abc"), rng.randint(-140, 300)) for k in range(200)] + [(900, "a", None), (901, None, 3)]
    r, p = spark.createDataFrame(ranges, "range_id long, by string, start long, end long"), spark.createDataFrame(points, "id long, by string, at long")
    want = {(i, k) for i, b, x in points for k, c, s, e in ranges if b is not None and b == c and x is not None and s is not None and s <= x <= e}
    assert rows_of(intervals.in_ranges(p, r, ["by"]), "id", "range_id") == sorted(want)
    first = {i: min((k for j, k in want if j == i), default=None) for i, _, _ in points}
    got = {x.id: x.range_id for x in intervals.first_range(p, r, ["by"], "id", ["range_id"], ["range_id"]).collect()}
    assert got == first
    assert intervals.in_ranges(p, r.limit(0), ["by"]).count() == 0
    bins = r.filter("start <= end").select("start", "end", F.size(intervals.dyadic(F.col("start"), F.col("end"), 9)).alias("n")).collect()
    assert all(x.n <= 2 * (x.end - x.start + 1).bit_length() for x in bins)
