"""Bit-sliced search, the quality classifier and the prefix trie against brute force and held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docmill.llm import impact_index, nbsvm, prefix_trie, queries
from tests.compare import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, rank string, item_id string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def ranked_by_hand(docs, items, k=10):
    """(item_id, rank, doc_id, score); ``docs`` are (doc_id, text)."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n, words = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, ws in asked.items():
        found = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if c[w])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def test_words_are_those_of_the_pattern():
    rng = random.Random(11)
    texts = ["".join(rng.choice("aZ09 .-_@[`{\x7f\x00\n\x80é日😀  ſK") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t in texts:
        assert [w.decode() for w in impact_index.words_of(t.encode())] == terms(t)


def test_slices_add_and_rank():
    rng = np.random.RandomState(5)
    for _ in range(40):
        n, shift = int(rng.randint(1, 300)), int(rng.randint(0, 4))
        words = (n + 63) // 64
        total, sums = np.zeros((26, words), np.uint64), np.zeros(n, np.int64)
        for _ in range(6):
            slots = np.flatnonzero(rng.rand(n) < 0.4)
            if not len(slots):
                continue
            v = rng.randint(0, 2**18, len(slots))
            bits = np.packbits((v >> np.arange(18)[:, None] & 1).astype(np.uint8), axis=1, bitorder="little")
            impact_index.add_slices(total, impact_index.spread_slices(slots, bits.tobytes(), words), shift)
            sums[slots] += v << shift
        at, score = impact_index.best_slots(total, 7)
        want = [k for k in np.lexsort((np.arange(n), -sums)).tolist() if sums[k] > 0][:7]
        assert sorted(at.tolist()) == sorted(want) and score.tolist() == sums[at].tolist()


def test_ties_keep_the_smallest_slots():
    total = np.full((1, 1), (1 << 20) - 2, np.uint64)
    assert sorted(impact_index.best_slots(total, 3)[0].tolist()) == [1, 2, 3]


def test_search_equals_sql(spark, sf):
    assert compare(spark, sf, "op11", queries.op11_impact_index, queries.LEXICAL_SQL) is None


def test_search_on_odd_tables(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "日本", "the"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    docs += [(200 + k, "same words here w1") for k in range(40)] + [(None, "same words here w1"), (3, None), (4, ""), (5, "w1 " * 4000), docs[0], docs[0]]
    items = [(1, "W1 w2 w2 w2 the"), (2, "same"), (2, "words"), (3, "nowhere"), (4, None), (None, "é 日本"), (5, "w3 " * 1000 + "w4")]
    table = spark.createDataFrame([(d, t, "s", "r", "i") for d, t in docs], DOCS).repartition(3)
    asked = impact_index.asked_terms(spark.createDataFrame(items, "item_id long, text string"))
    want = ranked_by_hand(docs, items)
    for block, group in ((32768, 200_000), (16, 3)):
        monkeypatch.setattr(impact_index, "BLOCK_DOCS", block)
        monkeypatch.setattr(impact_index, "GROUP_TERMS", group)
        got = impact_index.search(impact_index.build(table), asked).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    none = table.limit(0)
    assert impact_index.search(impact_index.build(none), asked).count() == 0
    assert impact_index.search(impact_index.build(table), asked.limit(0)).count() == 0


# 12 quality


def test_dual_descent_finds_the_least_loss():
    rng = np.random.RandomState(2)
    x, y = rng.randn(60, 5), np.where(rng.rand(60) < 0.5, 1, -1)
    w = nbsvm.dual_descent(list(x), [np.arange(5)] * 60, y, 5, passes=400)

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()

    assert all(loss(w) <= loss(w + 1e-3 * rng.randn(5)) + 1e-6 for _ in range(200))


def test_ngrams_are_indicators():
    maker = nbsvm.Grams()
    grams, sizes = maker.of(["a b a b", None, "", "x", "the the the"])
    parts = np.split(grams, np.cumsum(sizes)[:-1])
    assert all(len(set(p.tolist())) == len(p) for p in parts) and sizes.tolist()[1:3] == [0, 0] and sizes[3] == 2
    alone, n = nbsvm.Grams().of(["the the the"])  # whatever stands beside it
    assert alone.tolist() == parts[4].tolist() and n[0] == sizes[4]


def test_ratios_by_hand():
    r = nbsvm.ratios(np.array([0, 1, 1, 2]), np.array([2, 2]), np.array([1, 0]), bits=2)
    p, q = np.array([2, 2, 1, 1]) / 6, np.array([1, 2, 2, 1]) / 6
    assert np.allclose(r, np.log(p / q))


def test_logistic_by_scan():
    rng = np.random.RandomState(4)
    m, y, w = rng.randn(300), (rng.rand(300) < 0.5) * 1, rng.rand(300) + 0.5
    y[m > 0.5] = 1
    a, b = nbsvm.logistic(m, y, w, ridge=0)

    def loss(a, b):
        return (w * np.logaddexp(0, -(2 * y - 1) * (a * m + b))).sum()

    assert all(loss(a, b) <= loss(a + d, b + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op12_nbsvm(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r.quality == c] for c in (1, 0))
    assert np.mean([r.predicted for r in good]) >= 0.95 and np.mean([r.predicted for r in bad]) <= 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(nbsvm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in nbsvm.score(docs, nbsvm.fit(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_quality_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (2, "", "x"), (3, "z " * 200_000, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    rows = nbsvm.score(docs, model, keep=("doc_id", "score")).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {model.prior} and [r.score_given for r in rows if r.doc_id == 2] == ["x"]
    assert nbsvm.score(docs.limit(0), model).count() == 0
    assert nbsvm.fit(docs, labels.limit(0)).prior == 0.5


# 13 trie


def trie_by_hand(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p in sorted(nodes, key=len, reverse=True):
        m, below = nodes[p], kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(below), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def test_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_prefix_trie(spark, sf).collect()), key=repr) == trie_by_hand(rows)


def test_trie_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é😀"])) for c in range(-5, 230, 3) for t in rng.sample([None, 0, 1, 2, 3, 5, 8], rng.randint(1, 5))]
    rows += [(c, t, "user", f"long copy {t}") for c in range(400, 420) for t in range(12)] + [(419, 12, "user", "one more")]
    rows += [(500, 1, "user", "tie"), (500, 1, "assistant", "tie"), (500, 1, "user", "tie"), (None, 1, "user", "no id"), rows[0]]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, pos string, node string")
    got = prefix_trie.conversation_trie(table)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == trie_by_hand(rows)
    assert prefix_trie.conversation_trie(table.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[(7, 0, "u", "x")], [(7, 0, "u", "x"), (8, 0, "u", "x")]])
def test_small_tries(spark, rows):
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == trie_by_hand(rows)
