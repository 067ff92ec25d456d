"""The corpus operators against brute force, round trips and held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import chat_format, components, gbt, hnsw, html_extract, imatch, minhash, mixing, queries, sentencepiece_wfst, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component string"
ODD = ["", None, " ", "word", "a b c", "x" * 5000, "<|endoftext|> </s> <0x0A>", "naïve ▁ 日本 😀\n\n \t end ", "Same text here for all of us to see", "Same text here for all of us to see"]


def odd_docs(spark):
    rows = [(k, t, None if k % 3 else "en", None if k == 2 else f"s{k % 2}", None, "clash", "clash") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None, None, None)], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1 SentencePiece


def test_encoding_is_the_library_s(documents):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in documents.select("text").collect()] + [x or "" for x in ODD]
    rng = random.Random(4)
    texts += ["".join(rng.choice(" ▁\n\tabethEiou.,'1é日") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    codec = sentencepiece_wfst.codec(path)
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode(t)
        assert codec.decode(ids) == t.replace("▁", " ")


def test_unigram_paths_are_cheapest():
    def piece(text, score, kind=1):
        import struct

        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    costs = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁ab": -5.5, "ba": -3.5, "▁a": -3.0}
    model = piece("<unk>", 0.0, 2) + b"".join(piece(p, s) for p, s in costs.items()) + b"\x12\x02\x18\x01" + b"\x1a\x06\x18\x01\x20\x00\x28\x01"
    c = sentencepiece_wfst.Codec(model)

    def best(text):
        if not text:
            return 0.0
        return min((-costs[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in costs), default=float("inf"))

    for n in range(1, 7):
        for k in range(2**n):
            t = "".join("ab"[k >> i & 1] for i in range(n))
            assert sum(-costs[c.text_of[i]] for i in c.symbols("▁" + t)) == pytest.approx(best("▁" + t))


def test_a_long_text_without_a_space(spark, tmp_path):
    """A million characters without a cut, through the query, as the library has them."""
    import sentencepiece

    rng = random.Random(9)
    long = "".join(rng.choice("etaoinshrdlu123=+/é") for _ in range(1_000_000))
    docs = [(1, long), (2, "日本語" * 50_000), (3, " " * 100_000 + "x"), (4, long[:300_000].replace("e", " "))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, str(tmp_path)).collect()}
    for k, t in docs:
        assert got[k].token_ids == library.encode(t) and got[k].round_trip
    counted = {r.doc_id: r.n_tokens for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    assert counted == {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in docs}


def test_sentencepiece_odd_tables(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    out = sentencepiece_wfst.encode(odd_docs(spark), path)
    got = out.collect()
    assert len(got) == len(ODD) + 2 and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[1] == 0
    texts = sentencepiece_wfst.decode(out, path).collect()
    assert {r.doc_id: r.text for r in texts}[7] == ODD[7].replace("▁", " ")
    assert sentencepiece_wfst.encode(no_docs(spark), path).count() == 0


# 2 near duplicates


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_components(texts, n, percent=80):
    sets = {k: shingles(t, n) for k, t in texts.items()}
    at = {}
    for k, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, common in Counter(j for g in s for j in at[g] if j < k).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def made_texts():
    """Chains of near copies, groups without a hub, shared passages, short texts and exact copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(4):
        base = [word() for _ in range(80)]
        for k in range(12):
            out.append(" ".join(base))
            base = base.copy()
            base[rng.randrange(80)] = word()
    base = [word() for _ in range(100)]
    for k in range(25):
        copy = base.copy()
        for i in rng.sample(range(100), 3):
            copy[i] = word()
        out.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    out += [" ".join([word() for _ in range(25)] + passage + [word() for _ in range(25)]) for _ in range(30)]
    out += ["One two", "one TWO", "one two three", "", None, " \t"] + ["exact copy of these words here"] * 9
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    texts = made_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=n).collect()}
    assert got == brute_components(texts, n)


@pytest.mark.parametrize("blocks", [32, 1])
def test_every_link_within_a_bucket_is_found(spark, monkeypatch, blocks):
    """With one band of one minimum buckets are large and mixed; what one comparison per member misses is found across them, by blocks or by rare shingles."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "MOST_BLOCKS", blocks)
    texts = made_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=4, bands=40, rows=1).collect()}
    assert got == brute_components(texts, 4)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (7, None), (None, 8)], "u long, v long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_odd_tables(spark):
    rows = minhash.near_duplicates(odd_docs(spark)).collect()
    got = {r.doc_id: r for r in rows if r.doc_id != 5}
    assert len(rows) == len(ODD) + 2
    assert got[9].component_id == 8 and not got[9].kept and got[8].kept and got[0].n_shingles == 0
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


# 3 URL filter


def test_rules_and_words():
    f = url_filter
    assert f.host_and_path("HTTP://A.Example.COM/en/x?q#f") == ("a.example.com", "/en/x")
    assert f.host_and_path("x") == f.host_and_path(None) == ("", "")
    assert f.rule_for("www.example.com", "/en/1") == ("www.example.com/en/", "allow")
    assert f.rule_for("m.www.example.com", "/en/1") == ("www.example.com/en/", "allow")
    assert f.rule_for("a.example.com", "/en/1") == ("example.com/en/", "block")
    assert f.rule_for("notexample.com", "/en/1") == ("com/", "allow")
    assert f.rule_for("example.com", "") is None and f.rule_for("a.org", "/fr/") is None
    assert f.rule_for("a.net", "/fr/x") == ("net/fr/", "block") and f.rule_for("a.net", "/de/") is None
    c = f.classifier()
    assert c.segment("freecasinobets") == ("free", "casino", "bets")
    assert c.segment("dailynewsroom") == ("daily", "news", "room")
    assert c.score(c.words("onlinecasinobonus.example.org", "/win")) > 0 > c.score(c.words("citylibrary.example.org", "/books"))


def cheapest(c, name):
    if not name:
        return 0.0
    return min(c.cost.get(name[:k], c.unknown + 2.5 * k) + cheapest(c, name[k:]) for k in range(1, len(name) + 1))


def test_segments_are_cheapest():
    c = url_filter.classifier()
    for name in ("thecity", "adsx", "newsban", "xxxtub", "pokerx"):
        assert sum(c.cost.get(w, c.unknown + 2.5 * len(w)) for w in c.segment(name)) == pytest.approx(cheapest(c, name))


RULES_SQL = """
WITH u AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, host, path) AS (VALUES ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'), ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/'))
SELECT page_id, u.host, u.path, arg_max(rule, length(rule)) AS rule FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL"""


def test_urls_equal_sql_and_brute_force(spark, sf):
    """Host, path and rule by SQL over all pages; verdicts by all splits of each name and a plain naive Bayes."""
    from itertools import combinations

    from tests.compare import connection

    larger = sf.replace("sf0.001", "sf0.01")
    got = {r.page_id: r for r in queries.op3_url_filter(spark, larger).collect()}
    for page, host, path, rule in connection(larger).execute(RULES_SQL).fetchall():
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule)
    c = url_filter.classifier(queries.tokenizer_path("word_bpe_49k.json"))
    classes = [[w for h in x.split("|") for w in h.split()] for x in (url_filter.ALLOWED, url_filter.BLOCKED)]
    size = len({w for x in classes for w in x})

    def split(name):
        cost = lambda ws: sum(c.cost.get(w, c.unknown + 2.5 * len(w)) for w in ws)
        cuts = ([0, *x, len(name)] for n in range(len(name)) for x in combinations(range(1, len(name)), n))
        return cost(min(([name[a:b] for a, b in zip(x, x[1:])] for x in cuts), key=cost)), cost

    asked = set()
    for r in got.values():
        if r.rule:
            assert r.verdict == dict(url_filter.RULES)[r.rule]
            continue
        words = r.words.split()
        at = 0
        for name in re.findall("[a-z]+", r.host) + re.findall("[a-z]+", r.path.lower()):
            own = []
            while sum(map(len, own)) < len(name):
                own.append(words[at])
                at += 1
            assert "".join(own) == name
            if name not in asked and len(name) < 13:
                best, cost = split(name)
                assert cost(own) == pytest.approx(best)
                asked.add(name)
        odds = math.log(0.25)
        for w in words:
            n0, n1 = (x.count(w) for x in classes)
            if n0 + n1 and w not in url_filter.NEUTRAL:
                odds += math.log((n1 + 0.5) / (len(classes[1]) + 0.5 * size) / ((n0 + 0.5) / (len(classes[0]) + 0.5 * size)))
        assert r.score == pytest.approx(odds) and r.verdict == ("block" if odds > 0 else "allow")
    assert len(asked) > 10 and {r.verdict for r in got.values() if not r.rule} == {"allow", "block"}


def test_url_filter_odd_tables(spark, sf):
    p = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "ftp://", None), (3, "http://spam-farm.example.net/en/", None)], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.verdict) for r in url_filter.judge(p).orderBy("page_id", "host").collect()]
    assert got == [(1, "", "allow"), (2, "", "allow"), (3, "", "allow"), (3, "spam-farm.example.net", "block")]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in queries.op3_url_filter(spark, sf).join(pages.select("page_id", "url"), "page_id").collect():
        assert (r.host, r.path) == url_filter.host_and_path(r.url)
        assert (r.rule and r.verdict) == (r.rule and dict(url_filter.RULES)[r.rule])


# 4 chat formatting


def brute_chats(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_are_read_back(spark):
    rng = random.Random(3)
    marks = ["<|start|>", "<|sep|>", "<|end|>", "<|", "|>", "\\", "\\\\", "<\\|", "<", "[", "INST]", "[INST]", "</s>", "<s>", "<<SYS>>", "a", "\n", " ", "😀", "é", "$1", ""]
    rows = [(i % 60, i // 60 if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None, "<|sep|>", ""]), "".join(rng.choice(marks) for _ in range(rng.randint(0, 9))) if rng.random() < 0.95 else None) for i in range(600)]
    rows += [rows[0], (None, 1, "user", "no conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit("clash"))
    f = chat_format.formatted(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(f).collect()}
    assert got == brute_chats(rows)
    bare = f.select(F.regexp_replace("formatted", r"<\|(?:start|sep|end)\|>", "").alias("x"))
    assert bare.filter("x rlike '\\\\[/?INST\\\\]|</?s>|<</?SYS>>|<\\\\|'").count() == 0
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0


def test_a_conversation_of_many_turns(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k} <|end|>") for k in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.formatted(df)
    r = chat_format.digests(chats).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_chats(rows)[7]
    got = chats.first()
    assert all(chat_format.START not in got.formatted[s : s + n] for s, n in got.loss_spans[:50]) and len(got.loss_spans) == 15_000


def test_layouts(spark):
    j = ['{"prompt":"a","completion":"b"}', '{"messages":[{"role":"human","content":"x"},{"content":"y","role":"gpt"}]}', '{"x":1}', None, "nope", '{"instruction":"i","input":"","output":"o"}']
    got = chat_format.json_turns(spark.createDataFrame(list(enumerate(j)), "id long, j string"), "id", "j").orderBy("id", "turn").collect()
    assert [(r.id, r.role, r.text, r.layout) for r in got] == [
        (0, "user", "a", "prompt-completion"), (0, "assistant", "b", "prompt-completion"), (1, "user", "x", "messages"), (1, "assistant", "y", "messages"),
        (2, None, None, None), (3, None, None, None), (4, None, None, None), (5, "user", "i", "instruction-input"), (5, "assistant", "o", "instruction-input"),
    ]
    t = spark.createDataFrame([(1, "q?", "a!", 5)], "id long, question string, answer string, extra int")
    assert [(r.role, r.text) for r in chat_format.table_turns(t, "id").orderBy("turn").collect()] == [("user", "q?"), ("assistant", "a!")]
    with pytest.raises(ValueError):
        chat_format.table_turns(t.select("id", "extra"), "id")


# 5 nearest neighbours


def test_recall_and_scores(spark):
    rng = np.random.RandomState(7)
    x = np.concatenate([rng.randn(2500, 16), rng.randn(20, 16)[rng.randint(0, 20, 1500)] + 0.05 * rng.randn(1500, 16), np.repeat(rng.randn(1, 16), 30, 0)])
    rows = [(k, [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([r[1] for r in rows])
    hits = 0
    for q in range(0, len(rows), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(len(d)), d)) if k != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[k], abs=1e-12) for _, k, s in mine) and [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        hits += len({k for _, k, _ in mine} & set(want))
    assert hits / (10 * len(got)) >= 0.95


def test_recall_on_the_table(spark, sf):
    """Recall at 10 of the query against brute force over all vectors of the table."""
    larger = sf.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{larger}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op5_hnsw(spark, larger).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [k for k in ids.tolist() if k % 100 == 0]
    hits = 0
    for q in asked:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        hits += len(got[q] & set([int(k) for k in ids[np.lexsort((ids, d))] if k != q][:10]))
    assert hits >= 0.95 * 10 * len(asked)


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [3.0, 0.0]), (None, [1.0, 2.0]), (8, [1.0, 0.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(df).orderBy("rank").collect()] == [(0, 1, 6, 1.0), (0, 2, 7, 2.0)]
    assert hnsw.nearest(df.limit(0)).count() == 0


# 6 token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(documents, name):
    path = queries.tokenizer_path(name)
    texts = [r.text for r in documents.limit(60).collect()] + [x or "" for x in ODD]
    rng = random.Random(8)
    texts += ["".join(rng.choice(" \n\ta1'.sé\x85\x1c\x1f\xa0　​") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert token_counts.Counter(path).count(texts) == want


def test_cache_is_used_and_extended(spark, tmp_path):
    path, cache = queries.tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    d = odd_docs(spark)
    first = token_counts.count_tokens(d, path, cache).collect()
    assert len(first) == len(ODD) + 2
    known = spark.read.parquet(cache)
    before = known.count()
    assert before == known.select("content_digest").distinct().count() == len({x or "" for x in ODD}) + 1
    more = d.unionByName(spark.createDataFrame([(99, "a new text", None, None, None, None, None)], DOCS))
    got = {r.doc_id: r for r in token_counts.count_tokens(more, path, cache).collect()}
    assert spark.read.parquet(cache).count() == before + 1 and got[99].n_tokens == 3 and got[1].n_bytes == got[1].n_tokens == 0
    assert not any(r.over_limit for r in got.values() if r.n_tokens <= 1024)
    assert token_counts.count_tokens(no_docs(spark), path).count() == 0


def test_a_second_run_of_the_query_counts_nothing(spark, sf, tmp_path, monkeypatch):
    cache = str(tmp_path / "counts")
    spark.conf.set("spark.docmill.tokenCache", cache)
    try:
        first = sorted(queries.op6_token_counts(spark, sf).collect())
        known = spark.read.parquet(cache).count()
        monkeypatch.setattr(token_counts, "_count_texts", lambda path: lambda batches: (1 // 0 for _ in batches))  # encoding anything fails
        assert sorted(queries.op6_token_counts(spark, sf).collect()) == first and spark.read.parquet(cache).count() == known
    finally:
        spark.conf.unset("spark.docmill.tokenCache")


# 7 toxicity


def test_held_out_accuracy(spark, sf):
    larger = sf.replace("sf0.001", "sf0.01")
    r = queries.op7_toxicity(spark, larger).filter("held_out").join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").toPandas()
    rank, bad = r.score.rank(), r.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.9 and ((r.predicted == 1) & ~bad).sum() <= 0.02 * (~bad).sum()


def test_labels_of_held_out_rows_are_not_learnt(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(documents, labels), toxicity.fit(documents, flipped)
    assert a.lexicon == b.lexicon
    scores = [{r.doc_id: r.score for r in toxicity.score(documents, m).collect()} for m in (a, b)]  # trees and calibration too
    assert scores[0] == scores[1]


def test_toxicity_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs(spark), labels)
    got = toxicity.score(odd_docs(spark), model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs(spark), model).count() == 0
    assert toxicity.plain("(1d10t),") == ("idiot", True) and toxicity.plain("Clown!") == ("clown", False)


def test_trees_and_isotonic_fit():
    rng = np.random.RandomState(1)
    x = rng.rand(2000, 4)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = gbt.fit(x, y, trees=30, depth=3).probability(rng.rand(1, 4).repeat(1, 0))
    assert 0 < p[0] < 1
    assert ((gbt.fit(x, y).probability(x) > 0.5) == (y > 0)).mean() > 0.97
    s, v = gbt.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.interp([1, 2, 3, 4], s, v).tolist() == [0, 0.5, 0.5, 1] and (np.diff(v) >= 0).all()


# 8 mixing


def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, todo, out = 1.5 * sum(size.values()), set(names), {}
    while todo:
        w = sum(weight[s] for s in todo)
        over = {s for s in todo if left * weight[s] / w > 2 * size[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in todo}
        out |= {s: 2.0 * size[s] for s in over}
        left -= sum(out[s] for s in over)
        todo -= over
    return out


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    total, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        total[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
        assert 0 <= r.copies <= 2
    want = brute_targets(total)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in want)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r.doc_id: r.copies for r in rows if r.copies}


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_every_source_ends_near_its_target(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    sizes, taken, target = {}, Counter(), {}
    for r in mixing.mix(docs).collect():
        sizes.setdefault(r.source, []).append(r["size"])
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert len(target) == 20
    assert all(abs(taken[s] - t) <= max(0.01 * t, np.median(sizes[s])) for s, t in target.items())


def test_a_document_of_a_third_of_its_source(spark):
    """Whether it is taken or not, the shorter ones make up for it, and it is taken as often as they are."""
    rows = [(0, "w " * 1000, "a")] + [(k, "w " * (1 + k % 40), "a") for k in range(1, 101)] + [(200, "w " * 3000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    times = []
    for seed in range(8):
        got = mixing.mix(docs, weights=(1, 1), share=0.5, seed=seed).filter("source = 'a'").collect()
        assert abs(sum(r.copies * r["size"] for r in got) - got[0].target) <= 8
        times.append(sum(r.copies for r in got if r.doc_id == 0))
    rate = got[0].target / got[0].source_size
    assert 1 / 3 < rate < 2 / 3 and abs(np.mean(times) - rate) < 0.4 and set(times) == {0, 1}


def test_copies_are_unbiased(spark):
    """Over many seeds each document is taken as often as its source's rate says."""
    rows = [(k, "w " * (1 + k % 7), "a" if k < 30 else "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    n, got, rate = 25, Counter(), {}
    for seed in range(n):
        for r in mixing.mix(docs, weights=(3, 2), share=0.6, seed=seed).collect():
            got[r.doc_id] += r.copies / n
            rate[r.doc_id] = r.target / r.source_size
    assert np.mean([got[k] for k in range(30)]) == pytest.approx(rate[0], abs=0.05)
    assert max(abs(got[k] - rate[k]) for k in rate) < 0.45


def test_mixing_odd_tables(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert sum(r.rows for r in got) == len(ODD) + 2 and {r.copies * r["size"] for r in got if not r["size"]} == {0}
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mixed_documents(no_docs(spark)).count() == 0


# 9 fingerprints


def test_edited_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"]))
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    known = imatch.lexicon(docs)
    got = {r.doc_id: r for r in imatch.edited_texts(docs, known).collect()}
    alone = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, known).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        j, u = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == alone[i] and g.near_next == imatch.likeness(g.fingerprint, got[j].fingerprint)
        assert g.near_edited == imatch.likeness(g.fingerprint, g.edited_fingerprint)
    by = {}
    for i, t in rows:
        by.setdefault(t, set()).add(got[i].fingerprint)
    assert max(map(len, by.values())) == 1
    assert np.mean([g.near_edited for g in got.values()]) > 3 * np.mean([g.near_next for g in got.values()])


def test_ranges_hold_all_neighbours(spark, monkeypatch):
    """Many small ranges, repeated ids and null ids give the same neighbours as one."""
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(0, 4000, 7)]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) or None) for _ in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = imatch.lexicon(df)
    whole = sorted(map(str, imatch.edited_texts(df, known).collect()))
    monkeypatch.setattr(imatch, "RANGE_ROWS", 20)
    assert len(imatch._starts(df.select("doc_id"))[0]) > 5
    assert sorted(map(str, imatch.edited_texts(df, known).collect())) == whole and len(whole) == 900


def test_sources_may_be_many(spark):
    """Places and running sums by ranges equal a plain restatement for thousands of sources."""
    sizes = {f"s{k:05d}": 1 + k * 7 % 13 for k in range(3000)} | {None: 5}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(5)
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_band_of_frequencies(spark, documents):
    counts = Counter(t for r in documents.collect() for t in imatch.text_terms(r.text or ""))
    n = documents.count()
    want = {t for t, k in counts.items() if max(2, 0.05 * n) <= k <= 0.25 * n}
    assert len(imatch.lexicon(documents, rare=0.05)) == len(want)


def test_fingerprints_odd_tables(spark):
    d = odd_docs(spark)
    got = imatch.edited_texts(d, imatch.lexicon(d)).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    e = no_docs(spark)
    assert imatch.edited_texts(e, imatch.lexicon(e)).count() == 0
    one = d.filter("doc_id = 3")
    assert imatch.edited_texts(one, imatch.lexicon(one)).first().edited_sha256 == hashlib.sha256(b"wowo").hexdigest()


# 10 HTML


def test_generated_pages_not_learnt_from():
    rng, trees, good = random.Random(99), html_extract.model(), 0
    for _ in range(150):
        page = html_extract._made_page(rng)
        want = [x.text for x in html_extract.in_order(html_extract.parse(page)) if x.text and "\x01" in x.text]
        good += html_extract.main_texts([page], trees)[0] == "\n\n".join(want)
    assert good >= 0.85 * 150


def test_pages_of_the_table(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(x for x in blocks if x)


def test_decoding_is_the_most_likely_labelling():
    """All labellings of small trees without a kept node below a dropped one, against the decoder."""
    rng = np.random.RandomState(2)
    for _ in range(150):
        nodes = [html_extract.Node("html", None)]
        for k in range(rng.randint(1, 9)):
            nodes.append(html_extract.Node("div", nodes[rng.randint(len(nodes))]))
            nodes[-1].text = str(k)
        nodes = html_extract.in_order(nodes[0])
        keep = rng.rand(len(nodes))
        best, want = -1.0, None
        for bits in range(2 ** (len(nodes) - 1)):
            stays = [True] + [bool(bits >> k & 1) for k in range(len(nodes) - 1)]
            if all(stays[nodes.index(n.parent)] for n, y in zip(nodes, stays) if y and n.parent):
                p = np.prod([x if y else 1 - x for x, y in zip(keep[1:], stays[1:])])
                if p > best:
                    best, want = p, [n.text for n, y in zip(nodes, stays) if y and n.text]
        assert html_extract.decode(nodes, keep) == want


def test_stray_end_tags_are_linear():
    import time

    took = []
    for n in (4000, 32000):
        page = "<div>" * n + "</p>" * n + "words"
        began = time.time()
        assert html_extract.in_order(html_extract.parse(page))[-1].text == "words"
        took.append(time.time() - began)
    assert took[1] < 24 * took[0] + 1


def test_html_odd_tables(spark):
    rows = [(1, None, None), (1, "u", ""), (2, "u", "<div class=content><p>A &amp; B<br>c</p><script>x</script><p>D"), (3, "u", "<a" * 3000), (4, "u", "<p>" + "x" * 100000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted(r.n_chars for r in got if r.page_id < 3) == [0, 0, 10]
    assert next(r.text for r in got if r.page_id == 2) == "A & B c\n\nD"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# columns of any name


def clashing(spark):
    """Names of results and of what operators make on the way, on rows with nulls, repeats and ties."""
    names = "score predicted text_given row place said at word bits id of words copies size n key head body end parts component_id kept shingles token_ids n_tokens fingerprint host verdict url_given n_chars"
    rows = [(k % 4 or None, t, "s", k, *("x",) * len(names.split())) for k, t in enumerate(["", None, "a b c d e f", "a b c d e f", "you are trash", "word " * 3000])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, " + ", ".join(f"`{n}` string" for n in names.split()))


def test_columns_of_any_name(spark, sf):
    import corpus_pipeline as cp

    d = clashing(spark)
    every = tuple(d.columns)
    model = toxicity.fit(d, spark.read.parquet(f"{sf}/labels.parquet").limit(0))
    made = {
        "toxicity": toxicity.score(d, model, keep=every),
        "sentencepiece": sentencepiece_wfst.encode(d, queries.tokenizer_path("piece_bpe_32k.model"), keep=every),
        "counts": token_counts.count_tokens(d, queries.tokenizer_path("byte_bpe_50k.json"), keep=every),
        "urls": url_filter.judge(d, url="text", keep=every),
        "pages": html_extract.extract(d, page="text", keep=every),
        "prints": imatch.fingerprints(d, imatch.lexicon(d), keep=every),
    }
    for name, out in made.items():
        assert len(set(out.columns)) == len(out.columns) and out.count() == 6, name
        assert out.filter("`a.b` = 5").count() == 1
    assert minhash.near_duplicates(d).count() == 6
    for stage in (cp.drop_toxic, cp.drop_near_duplicates, cp.mix_sources):
        out = stage(spark, d, sf)
        assert out.columns == d.columns
        assert sorted(map(str, out.collect())) and stage(spark, d.limit(0), sf).count() == 0
        assert {str(r) for r in out.collect()} <= {str(r) for r in d.collect()}
    assert cp.encode(spark, d.withColumn("lang", F.lit(None).cast("string")), sf).count() == 6


def test_stages_on_repeated_rows_and_ties(spark, sf):
    import corpus_pipeline as cp

    said = "the same words in the same order for all who read them here"
    rows = [(1, said, "en", "a", 1), (1, said, "en", "a", 1), (2, said, "en", "a", 1), (None, said, None, None, None), (None, said, None, None, None), (3, None, "en", None, 0), (4, "", "en", "b", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in cp.drop_near_duplicates(spark, d, sf).collect()) == [(False, 0), (False, 0), (True, 1), (True, 3), (True, 4)]
    mixed = Counter(r.doc_id for r in cp.mix_sources(spark, d, sf).collect())
    assert set(mixed) <= {1, 2, 3, 4, None} and mixed[1] % 2 == 0


# the pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0 and quality = 1").select("doc_id")
    assert docs.join(labels, "doc_id").count() - clean.join(labels, "doc_id").count() <= 0.02 * labels.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    repeated = clean.unionByName(clean.filter("doc_id % 50 = 1"))
    kept = [r.doc_id for r in cp.drop_near_duplicates(spark, repeated, sf).collect()]
    assert sorted(kept) == sorted(k for k, (_, c) in brute_components(texts, 5).items() if k == c or not texts[k])
    out = cp.run(spark, sf)
    assert out.filter("not round_trip").count() == 0 and out.count() > 0
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near duplicates", "mixing", "SentencePiece"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    from tests.compare import compare

    assert compare(spark, sf, name, queries.queries()[name], queries.oracle_sql()[name]) is None
