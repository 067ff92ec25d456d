"""What a task holds at once is bounded in bytes and numbers, whatever its input."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from docmill import workers
from docmill.operators import anchored, retrieve, stored_index, stored_vectors


def test_batches_are_bounded_in_bytes(spark):
    workers.ship(spark)
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) <= workers.BATCH_BYTES + 20000


def test_dense_blocks_of_texts():
    places = {f"w{k}": k for k in range(1000)}
    n = 2500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if k % 5 == 0 else f"w{k % 1000} none W{k % 7}" for k in range(n)])], names=["id", "text"])
    blocks = list(retrieve._frequency_blocks(retrieve.BM25, places)(batch))
    assert max(tf.size for _, _, tf in blocks) <= retrieve.DENSE_VALUES
    assert np.concatenate([ids for ids, _, _ in blocks]).tolist() == list(range(n))
    assert sum(tf.sum() for _, _, tf in blocks) == 2 * sum(k % 5 > 0 for k in range(n))
    assert sum(dl.sum() for _, dl, _ in blocks) == 3 * sum(k % 5 > 0 for k in range(n))


def test_hashed_words_are_bounded(monkeypatch):
    monkeypatch.setattr(retrieve, "MOST_WORDS", 10)
    found = retrieve._Hashed({})
    assert [found[f"w{k}"] for k in range(35)] == [-1] * 35 and len(found) <= 10


def test_scores_of_many_questions_of_few_terms(spark):
    """Documents by questions is a matrix too; the weight sees how many documents are looked at together. Smaller ids of a score come last."""
    n, most = 3000, retrieve.DENSE_VALUES

    def weight(tf, dl, avgdl):
        assert len(tf) * n <= most
        return tf

    leg = retrieve.Leg("[a-z0-9]+", False, weight, lambda times: times)
    docs = spark.createDataFrame([(k, "b" if k % 3 else "a b" + " a" * (k % 4)) for k in reversed(range(1000))], "doc_id long, text string").coalesce(1)
    asked, places = [(q, "ab"[q % 2], 1) for q in range(n)], {"a": 0, "b": 1}
    got = retrieve._in_batches(None, docs, 2, leg, asked, places).collect()
    assert {(r.query_id, r["rank"], r.doc_id) for r in got} == {(q, k + 1, d) for q in range(n) for k, d in enumerate((0, 1) if q % 2 else (3, 15))}


def test_cosines_by_parts_of_the_questions(spark):
    """The judge sees what is looked at together."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 4)).round(3)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "doc_id long, v array<double>")
    most = retrieve.DENSE_VALUES

    def judge(score, labels):
        assert score.size <= most
        return score, np.zeros(score.shape, int)

    got = retrieve.cosine_top_k(df.selectExpr("doc_id as query_id", "v as qv"), df, 3, judge).collect()
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    score = np.round(u @ u.T, retrieve.DIGITS)
    want = {(q, r + 1, int(d)) for q in range(len(v)) for r, d in enumerate(np.lexsort((np.arange(len(v)), -score[q]))[:3])}
    assert {(r.query_id, r["rank"], r.doc_id) for r in got} == want


def test_index_counts_off_by_term_and_ranks_either_way(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b{k % 3} c{k % 5} c{k % 7}") for k in range(60)], "doc_id long, text string").coalesce(1)
    index = stored_index.StoredIndex.create(docs, f"file://{tmp_path}/index", block=8, buckets=2)
    assert index._read("entries").select("block").distinct().count() == 8  # blocks are full but for the last
    index.remove(docs.filter("doc_id % 2 = 0").select("doc_id"))
    off = index._read("heads", [1]).collect()
    assert len(off) == len({r.term for r in off}) and {r.term: r.df for r in off}["a"] == -30
    asked = spark.createDataFrame([(0, "b1 c2"), (1, "c3 c3 a")], "query_id long, text string")
    blocks = sorted(map(tuple, index.search(asked, 4).collect()))
    monkeypatch.setattr(stored_index, "MOST_WEIGHTS", 0)
    assert blocks == sorted(map(tuple, index.search(asked, 4).collect())) and len(blocks) == 8


def test_grams_and_places_leave_in_parts(monkeypatch):
    """A whole batch of texts that are full of an anchor is not held."""
    monkeypatch.setattr(anchored, "HELD", 40)
    texts = ["ab" * 100, "", "x", *(f"abab{k}" * 30 for k in range(40))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([0] * len(texts))], names=["id", "text", "of"])
    every, most = lambda h: np.ones(len(h), bool), sum(max(0, 240 - 2**k + 1) for k in (1, 3))
    for make in (anchored._counts, anchored._places):
        parts, again = list(make(every, [1, 3])(iter([batch, batch.slice(0, 0)]))), list(make(every, [1, 3])(iter([batch.slice(k, 1) for k in range(len(texts))])))
        assert len(parts) > 5 and max(p.num_rows for p in parts) <= 40 + most
        assert [p.to_pylist() for p in parts] == [p.to_pylist() for p in again]  # however the texts are batched
    rows = [(r["id"], r["place"], r["gram"]) for p in parts for r in p.to_pylist()]
    want = [(i, at, h) for i, t in enumerate(texts) for k in (1, 3) for at, h in enumerate(anchored.grams(anchored._codes(t), k).astype(np.uint64).view(np.int64).tolist())]
    assert rows == want


def test_vectors_become_no_objects(spark, tmp_path, monkeypatch):
    """Neither a search nor a block makes a Python number of each component; ids, null components and lengths are as they were."""
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=3 if k % 7 else 5).tolist()) for k in range(700)] + [(900, [0.0] * 3), (901, [])]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>")
    index = stored_vectors.VectorIndex.create(df.filter("doc_id % 3 > 0"), f"file://{tmp_path}/v", pivots=4, block=32)
    index.add(df.filter("doc_id % 3 = 0"), block=32)
    asked = df.filter("doc_id % 20 = 0").selectExpr("doc_id as query_id", "v as qv").unionByName(spark.createDataFrame([(None, [1.0, 2.0, 3.0])], "query_id long, qv array<double>"))
    want = {(q, r + 1, d) for q, x in map(tuple, asked.collect()) if q is not None and x for r, d in enumerate(_nearest(x, rows, 4))}
    got = index.search(asked, 4).filter("query_id is not null").collect()
    assert {(r.query_id, r["rank"], r.doc_id) for r in got} == want
    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("qv", pa.list_(pa.float64()))]))
    many = pa.RecordBatch.from_arrays([pa.array([[{"query_id": k, "qv": [float(k + x) for x in range(64)]} for k in range(n)] for n in (3, 500)], kind)], names=["qs"])
    tracemalloc.start()
    ids, vectors = stored_vectors._cell(many, "qs", 1).flatten()
    x, most = stored_vectors._rows(vectors, len(ids)), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x.shape == (500, 64) and x[7, 5] == 12 and ids[7].as_py() == 7 and most < 2 * x.nbytes


def _nearest(x, rows, k):
    norm = lambda v: np.asarray(v) / (np.sqrt(np.dot(v, v)) or 1)
    scores = [(-round(float(norm(x) @ norm(v)), retrieve.DIGITS), d) for d, v in rows if len(v) == len(x)]
    return [d for _, d in sorted(scores)[:k]]


def test_sparse_vectors_are_counted_where_texts_are_read(spark, monkeypatch):
    """Ids in several rows and null ones are one text each; unique ones are not shuffled."""
    rows = [(k, f"a b{k} A_1 été É{k} KK a" * (k % 4)) for k in range(40)] + [(3, "a a c"), (3, None), (None, "x a"), (None, "x"), (99, None), (98, "..")]
    schema = "name long, text string"
    want = Counter()
    for k, t in rows:
        want.update((k, int(hashlib.md5(w.encode()).hexdigest()[:8], 16)) for w in re.findall("[a-z0-9_]+", (t or "").lower()))
    got = retrieve.sparse_vectors(spark.createDataFrame(rows, schema), "name")
    assert got.columns == ["name", "idx", "weight"]
    found = [tuple(r) for r in got.collect()]
    assert {(k, i): w for k, i, w in found} == {k: 1 + n**0.5 for k, n in want.items()} and len(found) == len(want)
    once = spark.createDataFrame([(str(k), t) for k, t in rows[:40]], "name string, text string")
    got = retrieve.sparse_vectors(once, "name")
    assert "Exchange" not in got._jdf.queryExecution().toString() and got.count() == len({k for k in want if k[0] is not None and k[0] < 40 and k[0] % 4} - {(3, int(hashlib.md5(b"c").hexdigest()[:8], 16))})
    monkeypatch.setattr(retrieve, "COUNTED_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([None, "", "a b " * 200, *["a b c"] * 47])], names=["id", "text"])
    parts = list(retrieve._hashed_counts(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 3 and sum(p.num_rows for p in parts) == 2 + 47 * 3 and max(p.num_rows for p in parts) <= 60
