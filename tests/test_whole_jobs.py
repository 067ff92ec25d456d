"""Queries that once did a part of their job, against restatements of the whole."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.functions import guard
from docmill.operators import anchored, chunking, index, retrieve
from docmill.plans.catalogue import QUERIES


def test_every_hundredth_vector_is_looked_up(spark, sf):
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    for name in ("cosine_topk", "cache_lookup", "weighted_cosine", "filter_cascade"):
        assert {r.query_id for r in QUERIES[name](spark, sf).collect()} == {k for k in ids if k % 100 == 0}


def test_cosines_equal_brute_force(spark, monkeypatch):
    """Blocks of a few vectors, ties, zero and null vectors, ones of another length."""
    monkeypatch.setattr(retrieve, "BLOCK_VALUES", 40)
    rng = np.random.RandomState(4)
    x = rng.randint(-2, 3, (60, 4)).astype(float)
    rows = [(k, v, k % 3) for k, v in enumerate(x.tolist())] + [(100, None, 0), (101, [1.0, 2.0], 0)]
    v = spark.createDataFrame(rows, "doc_id long, v array<double>, label long")
    q = v.filter("doc_id % 7 = 0 or doc_id > 99").select(F.col("doc_id").alias("query_id"), F.col("v").alias("qv"))
    norm = np.sqrt((x**2).sum(1))
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    cos = np.round(unit @ unit.T, 6)
    got = {}
    for r in retrieve.cosine_top_k(q, v, 5, itself=False).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    assert set(got) == set(range(0, 60, 7))  # the only vector of two components has no other
    for j, mine in got.items():
        want = [k for k in np.lexsort((np.arange(60), -cos[j])) if k != j][:5]
        assert [(k, s) for _, k, s in sorted(mine)] == [(k, pytest.approx(cos[j, k], abs=1e-6)) for k in want]


@pytest.mark.parametrize("batched, joined", [(retrieve.bm25, retrieve.bm25_joined), (retrieve.sparse_top_k, retrieve.sparse_joined)])
def test_batches_equal_joins(spark, sf, batched, joined):
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    d = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    rows = lambda f: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in f(q, d, 7).collect())
    assert rows(batched) == rows(joined)
    assert batched(q.limit(0), d, 5).count() == 0 and batched(q, d.limit(0), 5).count() == 0


def test_contained_passages(spark):
    d = spark.createDataFrame([(1, "a cat sat"), (2, "cat"), (3, None), (4, "concat")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "cat"), (3, "a cat"), (4, "dog"), (5, ""), (6, None)], "query_id long, text string")
    got = sorted(tuple(r) for r in anchored.contained(q, d).collect())
    assert got == sorted([(1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (1, 4), (2, 4)])
    assert anchored.contained(q.limit(0), d).count() == 0


BY_QUESTION = "hybrid_rrf_topk bm25_topk sparse_topk rrf_fusion weighted_rrf keyword_fallback merge_sub_queries expand_parents promotion_overrides prerank_filter score_boosts co_retrieval".split()


@pytest.mark.parametrize("name", BY_QUESTION)
def test_words_behind_the_twelfth_count(spark, tmp_path, name):
    """Only the thirteenth word of the question is in any document."""
    question = " ".join(f"none{k}" for k in range(12)) + " harbour"
    prose = "The harbour of the town was closed for ships that came late in the year because of ice and wind. "
    docs = [(k, prose * (k % 3 + 1) if k < 30 else "Nothing about ships is written here, only a line on trees and rivers of the north.", "en", "s", 100) for k in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")  # none of the question's
    assert QUERIES[name](spark, str(tmp_path)).count() > 0


def test_scores_of_whole_questions(spark, sf):
    docs = {r.doc_id: re.findall("[a-z0-9]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    asked = {r.item_id: re.findall("[a-z0-9]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    tf, mean = {d: Counter(ws) for d, ws in docs.items()}, sum(map(len, docs.values())) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    got = {}
    for r in QUERIES["bm25_topk"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    assert any(len(ws) > 12 for ws in asked.values())
    for q, ws in asked.items():
        score = {d: sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(docs[d]) / mean)) for w in set(ws) if w in c) for d, c in tf.items()}
        best = sorted((s for s in score.values() if s > 0), reverse=True)[:20]
        mine = sorted(got[q])
        assert [s for _, _, s in mine] == pytest.approx(best, abs=2e-6)
        assert all(s == pytest.approx(score[d], abs=2e-6) for _, d, s in mine)


def test_turns_are_read_not_only_probes(spark, tmp_path):
    said = [(0, 0, "user", "What was the GDP of India in 2020? [1, 2, 3, 4] [] ()"), (0, 1, "assistant", "Table 2.1 of the World Bank says 12%."), (3, 2, "user", "hi")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {n: [tuple(r) for r in QUERIES[n](spark, str(tmp_path)).filter("query_id >= 100").collect()] for n in ("strip_brackets", "entity_extract", "plan_steps")}
    assert {q: re.split(" Source| Notes", p)[0] for q, p, _ in got["strip_brackets"]} == {100000: "What was the GDP of India in 2020?", 100001: "Table 2.1 of the World Bank says 12%.", 400002: "hi"}
    assert {(100001, "12%"), (100001, "Table 2.1"), (100001, "World Bank")} <= set(got["entity_extract"])
    assert got["plan_steps"] == [(100000, "gdp of india 2020")]


def test_every_turn_loses_its_brackets(spark, sf):
    turns = {(r.conv_id + 1) * 100000 + r.turn: r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = {r.query_id: r.plain for r in QUERIES["strip_brackets"](spark, sf).filter("query_id >= 100").collect()}
    assert set(got) == set(turns)
    assert all(got[q].startswith(" ".join(t.split())[:20]) for q, t in turns.items() if not set("[(") & set(t))


def test_containment_of_whole_turns(spark, tmp_path):
    opening = "These fifty characters are the same in every turn "
    said = [opening + "and then the first goes on to ships.", opening + "and then the second goes on to trees.", "trees", "Goes  ON to\nships.", "rivers"]
    spark.createDataFrame([(0, k, "user", t) for k, t in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(tuple(r) for r in QUERIES["containment_dedupe"](spark, str(tmp_path)).collect()) == [(0, 0), (0, 1), (0, 4)]


def test_whole_turns_equal_restatement(spark, sf):
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        kept, t = talks.setdefault(r.conv_id, []), " ".join(r.text.lower().split())
        if not any(t in k or k in t for _, k in kept):
            kept.append((r.turn, t))
    assert {tuple(r) for r in QUERIES["containment_dedupe"](spark, sf).collect()} == {(c, turn) for c, kept in talks.items() for turn, _ in kept}


def test_gates_read_whole_documents(spark, tmp_path):
    docs = [(0, "extraordinarily long words come first", "en", "s", 5000), (2, "two words", "en", "s", 5000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.low_value for r in QUERIES["visual_gates"](spark, str(tmp_path)).collect()} == {0: False, 2: True}


def test_containment_is_greedy_along_chains(spark):
    """What only a dropped row contains stays; empty and repeated candidates are none."""
    rows = [(0, 0, ""), (0, 1, "abc"), (0, 2, "b"), (0, 3, "xbx"), (0, 3, "xbx"), (0, 4, None), (0, 5, "XB"), (1, 0, "  ")]
    df = spark.createDataFrame(rows, "q long, n long, t string")
    assert sorted(tuple(r) for r in index.containment_dedupe(df, "q", "n", "t").collect()) == [(0, 1), (0, 3)]


def test_facts_equal_restatement(spark, sf):
    number = re.compile(r"(?i)(?<![A-Za-z0-9_])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*(?:percent|percentage\s+points|pp|million|billion|trillion|kg|km|tons?|years?|days?|months?)|\$\s?\d+(?:,\d{3})*(?:\.\d+)?)(?![A-Za-z0-9_])")
    texts = ["It cost $ 5,000.50 or 12 million in 3 days", "1,234.5 and 12% and x5% of 7 kgs", "$12 5%a 30 pp", "Table 2.1 of New Delhi World", ""]
    got = [r.e for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(guard.entities(F.col("t")).alias("e")).collect()]
    for t, mine in zip(texts, got):
        want = [x for x in number.findall(t)]
        assert mine[: len(dict.fromkeys(x.lower() for x in want))] == list(dict.fromkeys(want))
    assert got[3] == ["Table 2.1", "New Delhi World"]


def cut(text, size, first=True):
    """Plain restatement of the splitter, part by part."""
    if len(text) <= size:
        return [text] if text else []
    for sep in chunking.SEPARATORS:
        pieces = text.split(sep)
        if len(pieces) > 1:
            runs = [pieces[0]]
            for p in pieces[1:]:
                if not runs[-1]:
                    runs[-1] = p
                elif len(runs[-1]) + len(sep) + len(p) <= size:
                    runs[-1] += sep + p
                else:
                    runs.append(p)
            return [x for r in runs for x in cut(r.strip(), size)]
    return [text[k : k + size] for k in range(0, len(text), size)]


def test_splits_equal_restatement():
    rng = np.random.RandomState(8)
    for _ in range(400):
        t = "".join(rng.choice(["a", "bb", " ", "  ", "\n", "\n\n", ". ", "\t", "x" * 9]) for _ in range(rng.randint(0, 60)))
        assert [t[a:b] for a, b in chunking.split_spans(t, 12)] == cut(t, 12)


def test_upserts_and_patches_have_no_chance_in_them(spark):
    old = spark.createDataFrame([(1, 5.0, 2), (2, 1.0, 1)], "k long, v double, version int")
    new = spark.createDataFrame([(1, 4.0, 2), (1, 3.0, 2), (2, 9.0, 0), (3, None, 1)], "k long, v double, version int")
    assert sorted(tuple(r) for r in index.upsert(old, new, "k", "version").select("k", "v").collect()) == [(1, 4.0), (2, 1.0), (3, None)]
    changes = spark.createDataFrame([(1, 7.0), (1, 8.0)], "k long, v double")
    assert sorted(tuple(r) for r in index.patch(old, changes, "k", ["v"]).select("k", "v", "changed").collect()) == [(1, 8.0, True), (2, 1.0, False)]
