"""Registered queries: postings, sparse and dense retrieval, fusion, cascades, quality, expansion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality, text, understand
from ..operators import index, retrieve
from ..workers import written
from .registry import query, read


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: English ones stand for csv, the rest for pdf."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "text", "lang", "source", F.when(F.col("lang") == "en", "csv").otherwise("pdf").alias("source_type"))


TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
BM25_SQL = f"""
toks AS (SELECT doc_id, {TOK} AS ws FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM toks),
qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN df USING (term) JOIN post USING (term) CROSS JOIN stats GROUP BY ALL),
bm_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
SPARSE_SQL = f"""
sq AS (SELECT item_id AS query_id, idx, 1 + sqrt(count(*)) AS qw FROM (SELECT item_id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[a-z0-9_]+'))), 1, 8))::BIGINT AS idx FROM benchmark) GROUP BY ALL),
sd AS (SELECT doc_id, idx, 1 + sqrt(count(*)) AS dw FROM (SELECT doc_id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[a-z0-9_]+'))), 1, 8))::BIGINT AS idx FROM documents) GROUP BY ALL),
sdf AS (SELECT idx, count(*) AS df FROM sd GROUP BY idx),
sp AS (SELECT query_id, doc_id, round(sum(qw * dw * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM sq JOIN sdf USING (idx) JOIN sd USING (idx) CROSS JOIN (SELECT count(*) AS n FROM documents) GROUP BY ALL),
sp_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sp)"""


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return retrieve.bm25(questions(spark, sf_dir), read(spark, sf_dir, "documents"), 20).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SPARSE_SQL} SELECT query_id, doc_id, score, rank FROM sp_ranked WHERE rank <= 20")
def sparse_topk(spark, sf_dir):
    return retrieve.sparse_top_k(questions(spark, sf_dir), read(spark, sf_dir, "documents"), 20).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


RRF_SQL = """
fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, max(CASE WHEN path = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN path = 'sparse' THEN rank END) AS sparse_rank
  FROM (SELECT query_id, doc_id, rank, 'bm25' AS path FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 'sparse' FROM sp_ranked WHERE rank <= 20) GROUP BY ALL),
fused_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)"""


def _legs(spark, sf_dir):
    q, d = questions(spark, sf_dir), read(spark, sf_dir, "documents")
    return [("bm25", retrieve.bm25(q, d, 20)), ("sparse", retrieve.sparse_top_k(q, d, 20))]


QUALITY_SQL = f"""
qual AS (SELECT doc_id, lang, {quality.REASON_SQL} AS reason, {quality.SCORE_SQL} AS quality FROM (SELECT *, {quality.CLEAN_SQL} AS clean FROM documents))"""


@query(f"WITH {BM25_SQL}, {SPARSE_SQL}, {RRF_SQL} SELECT query_id, doc_id, score, bm25_rank, sparse_rank, rank FROM fused_ranked WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    out = retrieve.rrf(_legs(spark, sf_dir), 10)
    return out.select("query_id", "doc_id", "score", *[F.col(c).cast("long").alias(c) for c in ("bm25_rank", "sparse_rank", "rank")])


@query(f"""WITH {BM25_SQL}, {SPARSE_SQL}, {RRF_SQL}, {QUALITY_SQL},
cand AS (SELECT f.query_id, f.doc_id, f.score, f.rank, q.reason, q.quality, CASE WHEN lang = 'en' OR (reason IS NULL AND quality >= 2) THEN 0 WHEN reason IS NULL THEN 1 ELSE 2 END AS tier FROM fused_ranked f JOIN qual q USING (doc_id) WHERE f.rank <= 20),
kept AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS least FROM cand WHERE tier < 2)
SELECT query_id, doc_id, score, CAST(tier AS BIGINT) AS tier, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM kept WHERE tier = least) WHERE new_rank <= CASE WHEN tier = 0 THEN 5 ELSE 2 END""")
def hybrid_rrf_topk(spark, sf_dir):
    """Flagship: both legs, fusion, quality filter with its fallback, five best."""
    fused = written(retrieve.rrf(_legs(spark, sf_dir), 20), "fused")  # read twice: 20 rows a question
    found = chunks(spark, sf_dir).join(retrieve.handed_out(fused.select("doc_id").distinct(), 20, questions(spark, sf_dir)), "doc_id", "left_semi")
    judged = fused.join(quality.judged(found), "doc_id")
    # rejected ones leave behind the window: before it, their filter would go below the join, into the scan, and judge every text
    kept = retrieve.cascade(judged.withColumnRenamed("tier", "grade"), [F.col("grade") == 0, F.col("grade") == 1]).filter("tier < 2")
    order = Window.partitionBy("query_id").orderBy("rank")
    out = kept.withColumn("new_rank", F.row_number().over(order).cast("long")).filter(F.col("new_rank") <= F.when(F.col("tier") == 0, 5).otherwise(2))
    return out.select("query_id", "doc_id", "score", F.col("tier").cast("long").alias("tier"), "new_rank")


_NUMERICAL = f"(regexp_matches(text, '[0-9]') OR list_has_any({TOK}, {list(understand.NUMERICAL)}))"
_EXPLAIN = f"(list_has_any({TOK}, {list(understand.EXPLANATORY)}) OR (regexp_matches(lower(text), '^what (is|are) ') AND NOT {_NUMERICAL}))"
_WEIGHT = "CASE intent " + " ".join(f"WHEN '{i}' THEN CASE WHEN lang = 'en' THEN {w['csv']}::DOUBLE ELSE {w['pdf']}::DOUBLE END" for i, w in understand.WEIGHTS.items()) + " END"


@query(f"""WITH {BM25_SQL}, {SPARSE_SQL},
legs AS (SELECT query_id, doc_id, rank FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM sp_ranked WHERE rank <= 20),
said AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN text || ' Why?' WHEN item_id % 3 = 1 THEN 'How many? ' || text ELSE text END AS text FROM benchmark),
intents AS (SELECT query_id, CASE WHEN numerical AND explains THEN 'mixed' WHEN numerical THEN 'numerical' WHEN explains THEN 'explanatory' ELSE 'balanced' END AS intent FROM (SELECT query_id, {_NUMERICAL} AS numerical, {_EXPLAIN} AS explains FROM said)),
w AS (SELECT query_id, doc_id, round(sum({_WEIGHT} / (60 + rank)), 8) AS score FROM legs JOIN documents USING (doc_id) JOIN intents USING (query_id) GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM w) WHERE rank <= 10""")
def weighted_rrf(spark, sf_dir):
    """Fusion weighed by the source's type and by what each question is after."""
    types = chunks(spark, sf_dir).select("doc_id", "source_type")
    a, b = _legs(spark, sf_dir)
    both = a[1].select("query_id", "doc_id", "rank").unionByName(b[1].select("query_id", "doc_id", "rank")).join(types, "doc_id")
    said = F.when(F.col("query_id") % 3 == 0, F.concat("text", F.lit(" Why?"))).when(F.col("query_id") % 3 == 1, F.concat(F.lit("How many? "), "text")).otherwise(F.col("text"))
    both = both.join(questions(spark, sf_dir).select("query_id", understand.intent(said).alias("intent")), "query_id")
    w = understand.source_weight(F.col("intent"), F.col("source_type"))
    scored = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(w / (60 + F.col("rank"))), 8).alias("score"))
    return retrieve.top_k(scored, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


NEAR_ENOUGH = 0.4


@query(f"""WITH {BM25_SQL}, cq AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN benchmark ON item_id = a.vec_id JOIN embeddings b ON b.vec_id <> a.vec_id),
dense AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cq WHERE score >= {NEAR_ENOUGH}) WHERE rank <= 10), kw AS (SELECT query_id, doc_id, rank FROM bm_ranked WHERE rank <= 10)
SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 8) AS score, 'dense' AS path FROM dense UNION ALL SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank), 8), 'keyword' FROM kw WHERE query_id NOT IN (SELECT query_id FROM dense)""")
def keyword_fallback(spark, sf_dir):
    """Questions whose vector (that of their number) has no near neighbour take the keyword list instead."""
    q, e = questions(spark, sf_dir), read(spark, sf_dir, "embeddings")
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")).join(q, "query_id", "left_semi")
    dense = retrieve.cosine_top_k(asked, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), 10, itself=False)
    dense = dense.filter(F.col("score") >= NEAR_ENOUGH).select("query_id", "doc_id", "score", "rank", F.lit("dense").alias("path"))
    kw = retrieve.bm25(q, read(spark, sf_dir, "documents"), 10)
    both = dense.unionByName(kw.select("query_id", "doc_id", "score", "rank", F.lit("keyword").alias("path")))
    out = retrieve.cascade(both, [F.col("path") == "dense", F.col("path") == "keyword"])
    return out.select("query_id", "doc_id", F.round(F.lit(1.0) / (60 + F.col("rank")), 8).alias("score"), "path")


def _vectors(spark, sf_dir):
    """Queries are the vectors whose id 100 divides, candidates all vectors."""
    e = read(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


COS_SQL = "cs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, b.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)"


@query(f"WITH {COS_SQL} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return retrieve.cosine_top_k(q, v, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {COS_SQL} SELECT query_id, arg_max(doc_id, (score, -doc_id)) AS doc_id, max(score) AS score, max(score) >= 0.95 AS hit FROM cs WHERE doc_id <> query_id GROUP BY query_id")
def cache_lookup(spark, sf_dir):
    """Semantic cache: the nearest stored entry of each query, and whether it is near enough to answer it."""
    q, v = _vectors(spark, sf_dir)
    return retrieve.cosine_top_k(q, v, 1, itself=False).select("query_id", "doc_id", "score", (F.col("score") >= 0.95).alias("hit"))


def _by_label(score, label):
    return np.round(score * np.where(label % 2 == 0, 2.0, 0.65), 5), np.zeros(score.shape, int)


@query(f"WITH {COS_SQL}, w AS (SELECT query_id, doc_id, round(score * CASE WHEN label % 2 = 0 THEN 2.0 ELSE 0.65 END, 5) AS score FROM cs) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM w) WHERE rank <= 5")
def weighted_cosine(spark, sf_dir):
    q, v = _vectors(spark, sf_dir)
    return retrieve.cosine_top_k(q, v, 5, _by_label).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _tiers(score, label):
    third = np.broadcast_to(label == 3, score.shape)
    return score, np.where(score <= 0.2, -1, np.where(third & (score > 0.3), 0, np.where(third, 1, 2)))


@query(f"WITH {COS_SQL}, c AS (SELECT *, CASE WHEN label = 3 AND score > 0.3 THEN 0 WHEN label = 3 THEN 1 ELSE 2 END AS tier FROM cs WHERE score > 0.2), k AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS least FROM c) SELECT query_id, CAST(tier AS BIGINT) AS tier, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k WHERE tier = least) WHERE rank <= 5")
def filter_cascade(spark, sf_dir):
    """Strict filter, relaxed filter, none: the first that leaves something."""
    q, v = _vectors(spark, sf_dir)
    best = retrieve.cosine_top_k(q, v, 5, _tiers).withColumnRenamed("tier", "filter")
    kept = retrieve.cascade(best, [F.col("filter") == 0, F.col("filter") == 1])
    return kept.select("query_id", F.col("tier").cast("long").alias("tier"), "doc_id", "score")


@query("SELECT vec_id, k, round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS x FROM (SELECT vec_id, embedding, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings)")
def l2_normalise(spark, sf_dir):
    """Every component of twice each vector, brought to unit length."""
    e = read(spark, sf_dir, "embeddings").withColumn("d", F.transform("embedding", lambda x: 2 * x.cast("double")))
    return e.select("vec_id", F.posexplode(retrieve.normalised_vector(F.col("d"))).alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query("SELECT doc_id, idx, weight FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS idx, round(1 + sqrt(count(*)), 6) AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents) GROUP BY ALL)")
def sparse_vectors(spark, sf_dir):
    return retrieve.sparse_vectors(read(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


@query(f"SELECT count(*) AS n, round(avg(len({TOK})), 6) AS avgdl, sum(len({TOK}))::BIGINT AS tokens FROM documents")
def corpus_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    words = F.size(text.tokens(F.col("text")))
    return d.agg(F.count("*").alias("n"), F.round(F.avg(words), 6).alias("avgdl"), F.sum(words).cast("long").alias("tokens"))


@query(f"SELECT w AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK}) AS w FROM documents) GROUP BY w")
def document_frequency(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {QUALITY_SQL} SELECT doc_id, coalesce(reason, 'none') AS reason, CAST(quality AS BIGINT) AS quality FROM qual")
def chunk_quality(spark, sf_dir):
    return quality.judged(chunks(spark, sf_dir)).select("doc_id", F.coalesce("reason", F.lit("none")).alias("reason"), F.col("quality").cast("long").alias("quality"))


@query(f"WITH {QUALITY_SQL} SELECT reason, count(*) AS n FROM qual WHERE reason IS NOT NULL AND lang <> 'en' GROUP BY reason")
def removed_reasons(spark, sf_dir):
    return quality.judged(chunks(spark, sf_dir).filter("source_type = 'pdf'")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


SUB = f"""WITH {BM25_SQL}, sub AS (SELECT query_id // 2 AS query_id, 's' || (query_id % 2) AS sub_query, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm) WHERE r <= 5)"""


@query(SUB + " SELECT query_id, doc_id, max(score) AS score, string_agg(DISTINCT sub_query, ',' ORDER BY sub_query) AS found_by FROM sub GROUP BY ALL")
def merge_sub_queries(spark, sf_dir):
    """The best few of each sub-query, merged by document."""
    r = retrieve.bm25(questions(spark, sf_dir), read(spark, sf_dir, "documents"), 5)
    r = r.withColumn("sub_query", F.concat(F.lit("s"), F.col("query_id") % 2)).withColumn("query_id", F.floor(F.col("query_id") / 2))
    return retrieve.merge_by_id(r)


@query(f"""WITH {BM25_SQL}, r AS (SELECT query_id, doc_id, doc_id // 10 AS parent_id, rank FROM bm_ranked WHERE rank <= 20), p AS (SELECT doc_id // 10 AS parent_id, count(*) AS size FROM documents GROUP BY 1)
SELECT query_id, parent_id, min(rank) AS rank, count(*) AS children, any_value(size) AS size FROM r JOIN p USING (parent_id) GROUP BY query_id, parent_id""")
def expand_parents(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    r = retrieve.bm25(questions(spark, sf_dir), d, 20).withColumn("parent_id", F.floor(F.col("doc_id") / 10))
    parents = d.groupBy(F.floor(F.col("doc_id") / 10).alias("parent_id")).agg(F.count("*").alias("size"))
    return retrieve.expand_parents(r, parents).select("query_id", "parent_id", F.col("rank").cast("long").alias("rank"), "children", "size")


@query(f"""WITH {BM25_SQL}, r AS (SELECT query_id, doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id - doc_id % 10 END AS home, rank FROM bm_ranked WHERE rank <= 20),
f AS (SELECT query_id, coalesce(home, doc_id) AS parent_id, arg_min(doc_id, (rank, doc_id)) AS child_id, min(rank) AS rank FROM r GROUP BY ALL)
SELECT query_id, parent_id, child_id, rank, length(CASE WHEN child_id % 4 = 0 THEN c.text ELSE coalesce(nullif(trim(p.text), ''), c.text) END) AS chars, CASE WHEN child_id % 4 = 0 THEN length(coalesce(nullif(trim(p.text), ''), c.text)) END AS support
FROM f JOIN documents c ON c.doc_id = child_id LEFT JOIN documents p ON p.doc_id = parent_id""")
def parent_contexts(spark, sf_dir):
    """Contexts of questions: the first document of ten is the parent of the others; some children keep their own text, some have no parent."""
    d = read(spark, sf_dir, "documents")
    r = retrieve.bm25(questions(spark, sf_dir), d, 20).join(d.select("doc_id", "text"), "doc_id")
    home = F.when(F.col("doc_id") % 9 != 0, F.col("doc_id") - F.col("doc_id") % 10)
    r = r.select("query_id", F.col("doc_id").alias("child_id"), home.alias("parent_id"), "rank", "text", (F.col("doc_id") % 4 == 0).alias("keep"))
    out = retrieve.parent_contexts(r, d.select(F.col("doc_id").alias("parent_id"), "text"))
    return out.select("query_id", "parent_id", "child_id", F.col("rank").cast("long").alias("rank"), F.length("text").cast("long").alias("chars"), F.length("support").cast("long").alias("support"))


@query(f"""WITH {BM25_SQL} SELECT query_id, doc_id, new_rank, promotion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY promotion, rank, doc_id) AS new_rank FROM (
SELECT query_id, doc_id, rank, CAST(CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS promotion FROM bm_ranked WHERE rank <= 20)) WHERE new_rank <= 5""")
def promotion_overrides(spark, sf_dir):
    r = retrieve.bm25(questions(spark, sf_dir), read(spark, sf_dir, "documents"), 20)
    out = retrieve.promoted(r, F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0, F.col("doc_id") % 3 == 0, 5)
    return out.select("query_id", "doc_id", F.col("new_rank").cast("long").alias("new_rank"), F.col("promotion").cast("long").alias("promotion"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, sha1(text) AS content_id FROM documents GROUP BY text")
def exact_dedupe(spark, sf_dir):
    return index.exact_dedupe(read(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, left(text, 160) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def composite_dedupe(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("head", F.substring("text", 1, 160))
    return index.keep_first(d, ["source", "lang", "head"], "doc_id").select("doc_id", "source", "lang")


@query("""WITH RECURSIVE n AS (SELECT conv_id AS query_id, turn AS rank, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) <> ''),
f AS (SELECT query_id, k, rank, true AS stays, [t] AS kept FROM n WHERE k = 1 UNION ALL
 SELECT query_id, k, rank, stays, CASE WHEN stays THEN list_append(kept, t) ELSE kept END AS kept FROM (SELECT n.query_id, n.k, n.rank, n.t, f.kept, len(list_filter(f.kept, lambda x: contains(x, n.t) OR contains(n.t, x))) = 0 AS stays FROM f JOIN n ON n.query_id = f.query_id AND n.k = f.k + 1))
SELECT query_id, rank FROM f WHERE stays""")
def containment_dedupe(spark, sf_dir):
    """Among a query's candidates, in order, those that neither contain a kept one nor are part of one."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return index.containment_dedupe(c, "query_id", "rank", "text").select("query_id", "rank")


@query("SELECT o_orderkey, o_totalprice + 1 AS price, 2 AS version FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT -o_orderkey, o_totalprice, 2 FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def upsert_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    old = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("version"))
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"), F.lit(2).alias("version"))
    more = o.filter("o_orderkey % 100 = 0 AND o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.col("o_totalprice").alias("price"), F.lit(2).alias("version"))
    return index.upsert(old, new.unionByName(more), "o_orderkey", "version")


@query("SELECT doc_id, source FROM documents WHERE NOT (lang = 'fr' OR source = 'src3')")
def delete_where(spark, sf_dir):
    return index.delete_where(read(spark, sf_dir, "documents"), (F.col("lang") == "fr") | (F.col("source") == "src3")).select("doc_id", "source")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 10 = 0 AND c_mktsegment <> 'X' AS changed FROM customer")
def patch_changed(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    patch = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("X").alias("c_mktsegment"))
    return index.patch(c, patch, "c_custkey", ["c_mktsegment"])
