"""Retrieval and ranking over sets of queries: sparse and dense scores, fusion, boosts, cascades, expansion.

Every ranking has a total order, score descending and then id ascending; scores are rounded before they
are compared, so that equal candidates tie however their sums were added up.

Sparse scores of a question set that is small enough (its size is checked) are matrix products in Arrow
batches: a task keeps the best of each question, and only these are shuffled. Larger sets join postings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import sparse_index, tokens
from ..workers import ship

K1, B, RRF_K = 1.5, 0.75, 60
DIGITS = 6
#: Distinct terms times questions up to which their weights go to every task, as a dense matrix (64 MB).
MOST_WEIGHTS = 8_000_000
#: Numbers of a block of vectors; of a dense block of documents, and of cosines that are looked at together.
BLOCK_VALUES, DENSE_VALUES = 4_000_000, 500_000
#: Words whose hashes a worker remembers.
MOST_WORDS = 50_000
#: Bytes of texts (and one more text) whose words are counted together.
COUNTED_BYTES = 2**20


def top_k(scored: DataFrame, k: int, by: list[str] = ["query_id"], score: str = "score", tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of each query's tokens."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf, dl. With ``terms`` only theirs are kept, before anything is grouped."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("ws")).withColumn("dl", F.size("ws").cast("long"))
    rows = words.select("doc_id", "dl", F.explode("ws").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents n and mean length avgdl; a null text has no tokens."""
    return docs.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


@dataclass(frozen=True)
class Leg:
    """How texts become terms, and how often a term is in a text becomes its weight there."""

    pattern: str
    hashed: bool
    weight: Callable[[np.ndarray, np.ndarray, float], np.ndarray]
    asked: Callable[[np.ndarray], np.ndarray]


def _gain(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[:, None] / avgdl))


BM25 = Leg("[a-z0-9]+", False, _gain, lambda n: np.ones_like(n))
SPARSE = Leg("[a-z0-9_]+", True, lambda tf, dl, avgdl: np.where(tf > 0, 1 + np.sqrt(tf), 0.0), lambda n: 1 + np.sqrt(n))


class _Hashed(dict):
    """Word -> place of its hash among the asked terms, or -1; without these, the hash. Words met are remembered (bounded)."""

    def __init__(self, places: dict | None):
        self.places = places

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        out = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        out = self[word] = out if self.places is None else self.places.get(out, -1)
        return out


def _frequency_blocks(leg: Leg, places: dict, asking: int = 0):
    """Of an Arrow batch (doc_id, text) blocks of ids, numbers of words and a matrix of how often each term is in each text.

    Neither this matrix nor that of the scores of ``asking`` questions has more than DENSE_VALUES numbers (or one text's).
    """
    find, width = re.compile(leg.pattern).findall, len(places)
    hashed = _Hashed(places)
    placed = (lambda words: map(hashed.__getitem__, words)) if leg.hashed else (lambda words: map(places.get, words, repeat(-1)))

    def blocks(batch: pa.RecordBatch):
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        step = max(1, DENSE_VALUES // max(1, width, asking))
        for k in range(0, len(texts), step):
            words = [find((t or "").lower()) for t in texts.slice(k, step).to_pylist()]
            dl = np.array([len(w) for w in words], np.int64)
            at = np.fromiter(placed(chain.from_iterable(words)), np.int64, int(dl.sum()))
            line = np.repeat(np.arange(len(words)), dl)
            asked = at >= 0
            tf = np.bincount(line[asked] * width + at[asked], minlength=len(words) * width).reshape(len(words), width)
            yield ids[k : k + step], dl, tf.astype(float)

    return blocks


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best positive scores, ties to smaller ids."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _in_batches(queries: DataFrame, docs: DataFrame, k: int, leg: Leg, asked: list, places: dict) -> DataFrame:
    """The ``k`` best documents of each question; ``asked`` are (query_id, term, count) rows, ``places`` their terms' columns."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    names = list(dict.fromkeys(q for q, _, _ in asked))
    column = {q: j for j, q in enumerate(names)}

    def count(batches):
        blocks = _frequency_blocks(leg, places)
        df, n, words = np.zeros(len(places), np.int64), 0, 0
        for batch in batches:
            for ids, dl, tf in blocks(batch):
                df += (tf > 0).sum(0)
                n, words = n + len(ids), words + int(dl.sum())
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *range(len(places))]), pa.array([n, words, *df.tolist()])], names=["place", "n"])

    told = {r["place"]: r["n"] for r in texts.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # a row a term
    n, words = told.get(-2, 0), told.get(-1, 0)
    df = np.array([told.get(j, 0) for j in range(len(places))], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = np.zeros((len(places), len(names)))
    for q, term, times in asked:
        weights[places[term], column[q]] = leg.asked(np.array([times], float))[0] * idf[places[term]]
    shared = spark.sparkContext.broadcast(weights)  # no more than MOST_WEIGHTS numbers

    def score(batches):
        blocks = _frequency_blocks(leg, places, len(names))
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        reached, last = np.zeros(len(names)), np.zeros(len(names), np.int64)  # by k documents: the least score, and the largest id that has it
        for batch in batches:
            for ids, dl, tf in blocks(batch):
                found = np.round(leg.weight(tf, dl, words / max(n, 1) or 1.0) @ shared.value, DIGITS)
                most = found.max(0)
                for j in np.flatnonzero((most > reached) | ((most == reached) & (most > 0) & (ids.min() < last))).tolist():
                    scores, mine = np.concatenate([kept[j][0], found[:, j]]), np.concatenate([kept[j][1], ids])
                    best = _best(scores, mine, k)
                    kept[j] = scores[best], mine[best]
                    if len(best) == k:
                        reached[j], last[j] = scores[best[-1]], mine[best[-1]]
        out = [names[j] for j, (s, _) in enumerate(kept) for _ in range(len(s))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out, pa.int64()), pa.array(np.concatenate([x for _, x in kept])), pa.array(np.concatenate([s for s, _ in kept]))],
            names=["query_id", "doc_id", "score"],
        )

    return top_k(texts.mapInArrow(score, "query_id long, doc_id long, score double"), k)


def _small(queries: DataFrame, leg: Leg) -> tuple[list, dict] | None:
    """(query_id, term, count) rows and the terms' places, if questions and terms are few enough to be handed out."""
    words = tokens(F.col("text"), leg.pattern)
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(words).alias("term"))
    rows = rows.groupBy("query_id", (sparse_index(F.col("term")) if leg.hashed else F.col("term")).alias("term")).agg(F.count("*").alias("n"))
    size = rows.agg(F.approx_count_distinct("term").alias("terms"), F.approx_count_distinct("query_id").alias("asked")).first()
    if size["terms"] * size["asked"] > MOST_WEIGHTS / 2 or not size["terms"]:
        return None
    asked = sorted((r["query_id"], r["term"], r["n"]) for r in rows.collect())
    return asked, {t: j for j, t in enumerate(sorted({t for _, t, _ in asked}))}


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by Okapi BM25 with non-negative idf; ``k`` best for each query (ids are numbers)."""
    small = _small(queries, BM25)
    return _in_batches(queries, docs, k, BM25, *small) if small else bm25_joined(queries, docs, k)


def bm25_joined(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``bm25`` of any number of questions: a join of their terms with the postings."""
    wanted = query_terms(queries)
    found = postings(docs, wanted)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = df.crossJoin(corpus_stats(docs))  # one row of statistics
    scored = wanted.join(weighted, "term").join(found, "term")
    scored = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(idf * gain), DIGITS).alias("score"))
    return top_k(scored, k)


#: Rows of ranked lists up to which they are broadcast: what is found is then met by its texts in the scan.
MOST_HANDED_OUT = 500_000


def handed_out(ranked: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """``ranked`` lists of ``k`` rows a query, marked to be broadcast if there can't be many of them."""
    return F.broadcast(ranked) if k * queries.count() <= MOST_HANDED_OUT else ranked


def _hashed_counts(batches):
    """row, idx, n of texts: how often the words of each hash are in a text; a word's hash is made once, and some texts are counted at a time."""
    find, hashed = re.compile(SPARSE.pattern).findall, _Hashed(None)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + COUNTED_BYTES, "right")))
            words = [find((t or "").lower()) for t in texts.slice(first, last - first).to_pylist()]
            dl = np.array([len(w) for w in words], np.int64)
            idx = np.fromiter(map(hashed.__getitem__, chain.from_iterable(words)), np.int64, int(dl.sum()))
            # hashes have 32 bits
            both, n = np.unique(np.repeat(np.arange(first, last), dl) << 32 | idx, return_counts=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(both >> 32)), pa.array(both & (2**32 - 1)), pa.array(n)], names=["id", "idx", "n"])
            first = last


def sparse_vectors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, idx, weight: hashed sparse vectors with weights 1 + sqrt(tf); rows of one id (null too) are one text.

    A text is counted where it is read. Only where an id comes in several rows, which is found out at plan time from the
    ids alone, counts are shuffled to be summed.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), "text")
    counts = rows.mapInArrow(_hashed_counts, StructType([rows.schema["id"], StructField("idx", LongType()), StructField("n", LongType())]))
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        counts = counts.groupBy("id", "idx").agg(F.sum("n").alias("n"))
    return counts.select(F.col("id").alias(id_col), "idx", (1 + F.sqrt("n")).alias("weight"))


def sparse_top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Sparse dot product, each dimension weighed by its inverse document frequency; ``k`` best for each query (ids are numbers)."""
    small = _small(queries, SPARSE)
    return _in_batches(queries, docs, k, SPARSE, *small) if small else sparse_joined(queries, docs, k)


def sparse_joined(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``sparse_top_k`` of any number of questions: a join by dimension."""
    words = tokens(F.col("text"), SPARSE.pattern)
    q = queries.select("query_id", F.explode(words).alias("t")).groupBy("query_id", sparse_index(F.col("t")).alias("idx")).agg((1 + F.sqrt(F.count("*"))).alias("qw"))
    rows = docs.select("doc_id", F.explode(words).alias("t")).select("doc_id", sparse_index(F.col("t")).alias("idx"))
    d = rows.join(q.select("idx").distinct(), "idx", "left_semi").groupBy("doc_id", "idx").agg((1 + F.sqrt(F.count("*"))).alias("dw"))
    n = docs.agg(F.count("*").alias("n"))
    df = d.groupBy("idx").agg(F.count("*").alias("df")).crossJoin(n)  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = q.join(df, "idx").join(d, "idx").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("dw") * idf), DIGITS).alias("score"))
    return top_k(scored, k)


def normalised_vector(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


Judge = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _packed(rows: DataFrame, key: str, vector: str, label: str | None, blocks: int, name: str) -> DataFrame:
    """dim, ``name`` (a block's number) and of its rows the keys, labels and vectors, behind one another."""
    cells = F.struct(F.col(key).cast("long").alias("key"), (F.col(label) if label else F.lit(0)).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("dim"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name), cells.alias("c"))
    lists = rows.groupBy("dim", name).agg(F.collect_list("c").alias("cs"))
    return lists.select("dim", name, *[F.transform("cs", lambda c: c[k]).alias(f"{name}_{k}") for k in ("key", "label")], F.flatten(F.transform("cs", lambda c: c["v"])).alias(f"{name}_v"))


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, judge: Judge | None = None, itself: bool = True) -> DataFrame:
    """query_id, tier, doc_id, score, rank: the ``k`` vectors (doc_id, v and, if any, label) of highest cosine for each query (query_id, qv).

    The exact scan of a stated query set: blocks of queries meet blocks of vectors, each pair of blocks is
    one matrix product, and only the best of a pair of blocks are shuffled. ``judge`` turns rounded cosines (queries
    by vectors) and the vectors' labels into scores and tiers (-1: no candidate); each tier has its own ``k``. Vectors
    that are null or of another length than the query's are no candidates, a zero vector has the cosine 0;
    ``itself`` tells whether a vector with the query's own id is one.
    """
    ship(vectors.sparkSession)
    label = "label" if "label" in vectors.columns else None
    dim = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    per_block = max(1, min(4096, BLOCK_VALUES // dim))
    counts = queries.count(), vectors.count()
    blocks = [max(1, -(-n // per_block)) for n in counts]
    asked = _packed(queries, "query_id", "qv", None, blocks[0], "q")
    stored = _packed(vectors, "doc_id", "v", label, blocks[1], "b")
    met = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1)))).join(stored, ["dim", "b"])

    def unit(flat, width: int) -> np.ndarray:
        x = np.asarray(flat, float).reshape(-1, width)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda name: batch.column(name).slice(r, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                width, asking, ids, labels = batch.column("dim")[r].as_py(), cell("q_key"), cell("b_key"), cell("b_label").astype(float)
                near = unit(cell("b_v"), width).T
                asked = cell("q_v").reshape(-1, width)
                # a part of the questions at a time: cosines of whole blocks would be a matrix of 128 MB, several times
                step = max(1, DENSE_VALUES // max(1, len(ids)))
                for first in range(0, len(asking), step):
                    score = np.round(unit(asked[first : first + step], width) @ near, DIGITS)
                    score, tier = judge(score, labels) if judge else (score, np.zeros(score.shape, int))
                    out = []
                    for j, q in enumerate(asking[first : first + step].tolist()):
                        for t in np.unique(tier[j]).tolist():
                            at = np.flatnonzero((tier[j] == t) & ((ids != q) | itself)) if t >= 0 else ()
                            at = [] if not len(at) else at[np.lexsort((ids[at], -score[j, at]))[:k]]
                            out += [(q, t, int(ids[x]), float(score[j, x])) for x in at]
                    columns = list(zip(*out)) or [()] * 4
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "tier", "doc_id", "score"])

    return top_k(met.mapInArrow(run, "query_id long, tier long, doc_id long, score double"), k, by=["query_id", "tier"])


def rrf(ranked: list[tuple[str, DataFrame]], k: int, weights: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank); the rank in each list is kept as ``<name>_rank``."""
    every = reduce(DataFrame.unionByName, [d.select("query_id", "doc_id", "rank", F.lit(name).alias("path")) for name, d in ranked])
    w = weights if weights is not None else F.lit(1.0)
    fused = every.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(w / (RRF_K + F.col("rank"))), 8).alias("score"),
        *[F.max(F.when(F.col("path") == name, F.col("rank"))).alias(f"{name}_rank") for name, _ in ranked],
    )
    return top_k(fused, k)


def cascade(candidates: DataFrame, tiers: list[Column], by: list[str] = ["query_id"]) -> DataFrame:
    """Per query the candidates of the strictest tier that has any: tier 0, else 1, ... (a column ``tier``)."""
    tier = F.lit(len(tiers))
    for k in reversed(range(len(tiers))):
        tier = F.when(tiers[k], F.lit(k)).otherwise(tier)
    tagged = candidates.withColumn("tier", tier)
    return tagged.withColumn("_least", F.min("tier").over(Window.partitionBy(*by))).filter("tier = _least").drop("_least")


def merge_by_id(parts: DataFrame, by: list[str] = ["query_id", "doc_id"]) -> DataFrame:
    """Best score and the sub-queries that found it."""
    return parts.groupBy(*by).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("sub_query")), ",").alias("found_by"))


def expand_parents(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (query_id, parent_id, rank) to parents (parent_id, text): one row per parent, at its best child's rank."""
    best = ranked.groupBy("query_id", "parent_id").agg(F.min("rank").alias("rank"), F.count("*").alias("children"))
    return best.join(parents, "parent_id")


def parent_contexts(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """query_id, parent_id, child_id, rank, text, support: one context for each parent, by its best child (query_id, child_id, parent_id, rank, text, keep).

    The context is the parent's text (parent_id, text), or, where the child says ``keep``, the child's own with the
    parent's as support. A child without a parent stands for itself.
    """
    home = F.coalesce(F.col("parent_id"), F.col("child_id"))
    first = ranked.groupBy("query_id", home.alias("parent_id")).agg(F.min_by(F.struct("child_id", "rank", "text", F.coalesce("keep", F.lit(False)).alias("keep")), F.struct("rank", "child_id")).alias("c"))
    met = first.join(parents.select("parent_id", F.col("text").alias("whole")), "parent_id", "left")
    whole = F.coalesce(F.nullif(F.trim("whole"), F.lit("")), F.col("c.text"))
    return met.select("query_id", "parent_id", "c.child_id", "c.rank", F.when(F.col("c.keep"), F.col("c.text")).otherwise(whole).alias("text"), F.when(F.col("c.keep"), whole).alias("support"))


def promoted(scored: DataFrame, locked: Column, figure: Column, demoted: Column, k: int) -> DataFrame:
    """Named figures first, then locked entities, then the rest by rank, tables last."""
    group = F.when(figure, 0).when(locked, 1).when(demoted, 3).otherwise(2)
    order = Window.partitionBy("query_id").orderBy(group, F.col("rank"), F.col("doc_id"))
    return scored.withColumn("promotion", group).withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k)
