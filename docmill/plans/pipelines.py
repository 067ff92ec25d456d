"""Whole plans: ingest (blocks to index tables), retrieval (guard to top k) and the check of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guard, quality, text, understand
from ..operators import chunking, index, retrieve
from ..workers import written


def ingest(docs: DataFrame, key: str = "doc_id", size: int = chunking.CHUNK, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Documents (key, text, source) to chunks (chunk_id, key, n, text, source, entity_ids), each content once."""
    paragraphs = chunking.paragraphs(docs, key)
    lists = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "paragraph"))).alias("ps"))
    packed = lists.select(key, F.posexplode(chunking.pack(F.transform("ps", lambda x: x["paragraph"]), size, overlap)).alias("n", "text"))
    chunks = packed.join(docs.select(key, "source"), key).withColumn("chunk_id", text.uuid5(F.col("text"))).withColumn("entity_ids", understand.entity_labels(F.col("text")))
    return index.keep_first(chunks, ["chunk_id"], key)


def index_tables(chunks: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Postings, document statistics and hashed sparse vectors of chunks."""
    docs = chunks.select(F.col(key).alias("doc_id"), "text")
    return {"postings": retrieve.postings(docs), "stats": retrieve.corpus_stats(docs), "sparse": retrieve.sparse_vectors(docs)}


def guarded(questions: DataFrame) -> DataFrame:
    """Questions with redacted text and the verdict of the input layers."""
    t = F.col("text")
    holds = {"injection": guard.injected(t), "budget": guard.over_length(t) | guard.over_tokens(t), "coverage": guard.over_coverage(t), "content": guard.weak_content(t).isNotNull()}
    layers = [(name, guard.LAYERS[name], violated) for name, violated in holds.items()]
    return questions.withColumn("verdict", guard.verdict(layers)).withColumn("text", guard.redacted(t))


def answer_contexts(questions: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """One plan for all questions: guard, both legs, fusion weighed by intent, quality filter, ``k`` contexts each.

    ``docs`` has doc_id, text and source_type. No step loops over questions.
    """
    asked = guarded(questions).filter("verdict.passed")
    legs = [retrieve.bm25(asked, docs, 20), retrieve.sparse_top_k(asked, docs, 20)]
    ranked = legs[0].select("query_id", "doc_id", "rank").unionByName(legs[1].select("query_id", "doc_id", "rank"))
    intents = asked.select("query_id", understand.intent(F.col("text")).alias("intent"))
    types = docs.select("doc_id", "source_type")
    w = understand.source_weight(F.col("intent"), F.col("source_type"))
    fused = ranked.join(intents, "query_id").join(types, "doc_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(w / (retrieve.RRF_K + F.col("rank"))), 8).alias("score"))
    best = retrieve.top_k(fused, 4 * k)
    best = written(best, "best")  # read twice: 4 k rows a question
    found = docs.join(retrieve.handed_out(best.select("doc_id").distinct(), 4 * k, questions), "doc_id", "left_semi")
    judged = best.join(quality.judged(found).drop("source_type"), "doc_id")
    # rejected ones leave behind the window: before it, their filter would go below the join, into the scan, and judge every text
    kept = retrieve.cascade(judged.withColumnRenamed("tier", "grade"), [F.col("grade") == 0, F.col("grade") == 1]).filter("tier < 2")
    return retrieve.top_k(kept.drop("rank"), k)


def checked_answers(answers: DataFrame) -> DataFrame:
    """Answers (answer, source) with the verdict of the output layers, and the fallback text where one is violated."""
    a, s = F.col("answer"), F.col("source")
    unfaithful = F.coalesce(guard.faithfulness(a, s), F.lit(0.0)) < guard.FAITHFUL
    holds = {
        "entities": F.size(guard.ungrounded(guard.entities(a), s)) > 0,
        "quotes": F.exists(guard.quotes(a), lambda q: ~F.contains(s, q)),
        "prompt_leak": guard.prompt_leak(a),
        "data_leak": guard.data_leak(a),
        "faithfulness": unfaithful,
    }
    layers = [(name, critical, holds[name]) for name, critical in guard.LAYERS.items() if name in holds]
    v = answers.withColumn("verdict", guard.verdict(layers))
    return v.withColumn("safe_answer", F.when(F.col("verdict.passed"), guard.repaired_markdown(a)).otherwise(F.lit("I do not have sufficient data to answer this question.")))
