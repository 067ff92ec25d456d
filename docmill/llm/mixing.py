"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source whose target is r times its size takes every document floor(r) times for sure and once
more with the probability r - floor(r). Rounding these probabilities independently would leave a
source's words far from its target; so two documents at a time trade probability, weighed by their
words, until one of them is 0 or 1: the expected copies of each and the words of both stay as they
were. The one left over goes on to the next document of its chunk. Chunks hold a bounded
number of documents (picked by hash), each leaves one document, and these meet in the chunks of the
next level: a reduction tree of logarithmic depth whatever share of the rows a source holds.

In a trade the shorter document is settled first as a rule, so what a tree leaves is one of its longest. Documents
are therefore rounded by classes of size, the longest first, and only documents of like size trade. The one that a class
leaves is drawn; the words by which the class then differs from its expectation are made up for by all shorter
documents, whose probability is what is left of the target over what is left of the words. That keeps every
document's expected copies (unless shorter documents are too few to make up for it), and a source ends off its target by
a document of the smallest class that it has, not by its longest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, written

WEIGHTS = (5, 2, 1)
#: Documents of a chunk on average; the longest documents of a class have up to so many times the words of its shortest.
CHUNK, CLASS = 256, 8
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    words = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), words.alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Columns source, source_size, source_rows, target: ``share`` of all words dealt out by weight, none above ``most`` times its source.

    Sources in code-point order (null last) take the weights in turn. What would lie above a
    source's limit is dealt to the others by weight until none is above: a level at which
    every target is the smaller of its limit and weight times level. Sources may be many: places and
    running sums go by ranges.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    per = ranked(per, [F.col("source").asc_nulls_last()], [], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight")).drop("n")
    per = ranked(per, [F.col("ratio"), F.col("source").asc_nulls_last()], ["cap", "weight"], "sources")
    every = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))  # one row
    rest = F.col("weights") - F.col("sum_weight") + F.col("weight")
    per = per.crossJoin(every).withColumn("level", (F.col("words") * F.lit(share) - F.col("sum_cap") + F.col("cap")) / rest)
    first = per.filter(F.col("level") <= F.col("ratio")).agg(F.min_by("level", "n").alias("first"))  # one row
    per = per.crossJoin(first)
    return per.select("source", "source_size", "source_rows", F.least("cap", F.coalesce(F.col("first") * F.col("weight"), F.col("cap"))).alias("target"))


_ITEM = "struct<s: double, h: bigint, doc_id: bigint, size: bigint, rows: bigint, p: double>"
_STATE = f"cast(named_struct('left', null, 'done', array()) as struct<left: {_ITEM}, done: array<struct<item: {_ITEM}, more: int>>>)"


def _fold(seed: int) -> str:
    """One sequential pass over a chunk: ``left`` is the document still undecided, ``done`` the decided ones."""
    trade = (
        "named_struct('c', st.left, 'x', x, 'k', x.s / st.left.s, "
        "'rise', least(1D - st.left.p, x.p * x.s / st.left.s), 'fall', least(st.left.p, (1D - x.p) * x.s / st.left.s), "
        f"'u', pmod(xxhash64({seed}, st.left.h, x.h, x.size), 9007199254740992) / 9007199254740992D)"
    )
    moved = "named_struct('c', t.c, 'x', t.x, 'k', t.k, 'rise', t.rise, 'fall', t.fall, 'up', coalesce(t.u < t.fall / nullif(t.rise + t.fall, 0D), true))"
    # the first of the pair is decided if it reaches 1 (0) before the other reaches 0 (1)
    settled = "named_struct('t', t, 'first', if(t.up, 1D - t.c.p <= t.x.p * t.k, t.c.p <= (1D - t.x.p) * t.k))"
    change = "if(r.t.up, r.t.rise, -r.t.fall)"

    def item(of: str, p: str) -> str:
        return f"named_struct('s', {of}.s, 'h', {of}.h, 'doc_id', {of}.doc_id, 'size', {of}.size, 'rows', {of}.rows, 'p', least(1D, greatest(0D, {p})))"

    left = f"if(r.first, {item('r.t.x', f'r.t.x.p - {change} / r.t.k')}, {item('r.t.c', f'r.t.c.p + {change}')})"
    done = "array(named_struct('item', if(r.first, r.t.c, r.t.x), 'more', cast(if(r.first, r.t.up, not r.t.up) as int)))"
    return (
        "if(st.left is null, named_struct('left', x, 'done', st.done), "
        f"element_at(transform(transform(transform(array({trade}), t -> {moved}), t -> {settled}), "
        f"r -> named_struct('left', {left}, 'done', concat(st.done, {done}))), 1))"
    )


def _tree(pending: DataFrame, most_chunks: int, seed: int, name: str) -> DataFrame:
    """source, item and more (0 or 1) of all documents ``pending`` (source, chunks, x): a reduction tree for each source, its last one drawn."""
    level, done = 0, []
    while True:
        chunk = F.pmod(F.xxhash64(F.lit(seed + level), F.col("x.h")), F.col("chunks"))
        folded = pending.groupBy("source", "chunks", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
        folded = folded.select("source", "chunks", F.expr(f"aggregate(xs, {_STATE}, (st, x) -> {_fold(seed)})").alias("st"))
        folded = written(folded, f"{name}-{level}")
        done.append(folded.select("source", F.explode("st.done").alias("d")).select("source", "d.item.*", F.col("d.more").alias("more")))
        pending = folded.select("source", F.ceil(F.col("chunks") / CHUNK).alias("chunks"), F.col("st.left").alias("x"))
        if most_chunks <= 1:
            break
        most_chunks, level = -(-most_chunks // CHUNK), level + 1
    last = F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(9007199254740992)) / F.lit(9007199254740992.0) < F.col("p")
    done.append(pending.select("source", "x.*").withColumn("more", last.cast("int")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 8, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, rows, copies.

    One row for each distinct (doc_id, source, size); ``rows`` tells how many rows of ``docs`` have
    it, and each of them is taken ``copies`` times. A source's words taken differ from its target by
    less than one such document of the smallest class of sizes (1 to 7 words, 8 to 63, ...) that it has, if the shorter
    documents of a source can make up for its longer ones; copies never exceed ``most``. Sizes are numbers of words (null text:
    0). Documents without words trade with nobody and are drawn alone. A null source is a source, a
    null doc_id an id. All draws are hashes of ids, so that reruns agree. An empty table gives no rows. The classes
    are rounded one after the other, by jobs at plan time.
    """
    sized = written(sizes(docs, doc_id, source, text), "sizes")
    goal = written(targets(sized, weights, share, most).withColumnRenamed("source", "goal_source"), "targets")
    items = sized.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "source", "size").agg(F.count("*").alias("rows"))
    items = items.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source", "source_rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # within rounding errors of an integer nothing is left to draw
    items = items.withColumn("sure", F.floor(rate + 1e-9).cast("int")).withColumn("p", F.greatest(rate - F.col("sure"), F.lit(0.0)))
    items = items.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("s", (F.col("size") * F.col("rows")).cast("double"))
    items = written(items.withColumn("class", F.floor(F.log(F.greatest("s", F.lit(1.0)) + 0.5) / math.log(CLASS)).cast("int")), "items")
    fixed = (F.col("p") < 1e-9) | (F.col("size") == 0)
    alone = F.when(F.col("p") < 1e-9, F.lit(0)).otherwise((F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(9007199254740992)) / F.lit(9007199254740992.0) < F.col("p")).cast("int"))
    out = ["doc_id", "source", "size", "source_size", "target", "rows", "copies"]
    decided = items.filter(fixed).withColumn("copies", F.col("sure") + alone).select(*out)

    open_ = items.filter(~fixed)
    per = written(open_.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("s").alias("words"), F.sum(F.col("s") * F.col("p")).alias("due")), "classes")
    # what is left of each source: words it has to take, and words there are
    left = per.groupBy(F.col("source").alias("of")).agg(F.sum("due").alias("due"), F.sum("words").alias("words"))
    rounded: list[DataFrame] = []
    for at, n in sorted(((r["class"], r["n"]) for r in per.groupBy("class").agg(F.max("n").alias("n")).collect()), reverse=True):  # some twenty classes at most
        chunks = per.filter(F.col("class") == at).select("source", F.ceil(F.col("n") / CHUNK).alias("chunks"), F.col("words").alias("own"))
        here = chunks.join(left, F.col("source").eqNullSafe(F.col("of")))
        here = here.select(F.col("source").alias("own_source"), "chunks", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("due") / F.col("words"))).alias("rate"))
        met = open_.filter(F.col("class") == at).join(here, F.col("source").eqNullSafe(F.col("own_source")))
        pending = met.select("source", "chunks", F.struct("s", "h", "doc_id", "size", "rows", F.col("rate").alias("p")).alias("x"))
        rounded.append(_tree(pending, -(-n // CHUNK), seed, f"mixed-{at}"))
        taken = rounded[-1].groupBy(F.col("source").alias("now")).agg(F.sum(F.col("s") * F.col("more")).alias("took"), F.sum("s").alias("gone"))
        left = left.join(taken, F.col("of").eqNullSafe(F.col("now")), "left")
        left = left.select("of", *[(F.col(c) - F.coalesce(x, F.lit(0.0))).alias(c) for c, x in (("due", "took"), ("words", "gone"))])
    for part in rounded:
        part = part.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
        part = part.withColumn("copies", F.floor(F.col("target") / F.col("source_size") + 1e-9).cast("int") + F.col("more"))
        decided = decided.unionByName(part.select(*out))
    return decided


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, none that it leaves out; columns of any name stay."""
    taken = mix(docs, doc_id=doc_id, source=source, text=text, **options).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words"), "copies")
    size = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs[doc_id].alias("own_id"), docs[source].alias("own_source"), size.alias("own_words"))
    met = rows.join(taken, F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("of")) & (F.col("own_words") == F.col("words")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
