"""Toxicity: boosted trees over lexicon, proximity, capitals, punctuation and obfuscation rates.

Fitting takes a bounded sample of labelled rows, as many toxic ones as others, picked by hash.
Half of it teaches a lexicon (words and word beginnings that toxic texts have and others don't), two
thirds of the rest the trees, the last part the isotonic calibration, weighed to the true class
shares; so no part is judged on texts it has learnt from. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import forget, narrowed, small_batches, written

#: Rows of the fitting sample at most.
SAMPLE = 8000
#: Entries of the learnt lexicon at most.
LEXICON = 3000
#: Log-odds from which a term belongs to the learnt lexicon.
STRONG = 2.5
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
MEMO_WORDS = 100_000
#: Seed lexicon, used beside the learnt one.
SEED = frozenset("bastard bastards clown crap disgusting dumb fool freak garbage hate hateful idiot idiotic idiots imbecile kill loser losers moron moronic morons pathetic pig scum scumbag shut stupid sucker trash ugly vermin worthless".split())
SECOND_PERSON = frozenset("you your yours yourself youre ya ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti vosotros vuestro".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")
_REPEAT = re.compile(r"(.)\1\1")


def plain(word: str) -> tuple[str, bool]:
    """A word without outer punctuation, lower-cased, and whether it had to be freed of digits or inner signs."""
    edge = _EDGE.sub("", word).lower()
    if edge.isalpha():
        return edge, False
    if not edge:
        return "", False
    bare = _INNER.sub("", edge)
    if any(map(str.isalpha, bare)) and not bare.isalpha():
        bare = bare.translate(_LEET)
    bare = _INNER.sub("", bare)
    return bare, bare != edge and bare.isalpha()


def terms(word: str) -> list[str]:
    """What the lexicon may know of a plain word: itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: gbt.Trees | None = None
    points: np.ndarray | None = None
    values: np.ndarray | None = None


# columns of a word: log-odds, learnt, seed, obfuscated, obfuscated and known, second person, capitals, letters, signs, digits, shouted, length, repeats, beginning only
WORD_COLUMNS = 14


class Features(dict):
    """Word -> row of ``table``, the word's own features."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.table = np.zeros((1024, WORD_COLUMNS), np.float32)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        bare, hidden = plain(word)
        best, whole = 0.0, False
        for n, t in enumerate(terms(bare)) if bare else ():
            s = self.lexicon.get(t, 0.0)
            if s > best:
                best, whole = s, n == 0
        seed = bare in SEED
        letters = sum(map(str.isalpha, word))
        capitals = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        self.table[k] = (
            best, best >= STRONG, seed, hidden, hidden and (seed or best >= STRONG), bare in SECOND_PERSON, capitals, letters,
            len(word) - letters - digits, digits, letters > 1 and capitals == letters, len(word), bool(_REPEAT.search(word)), best >= STRONG and not whole,
        )
        return k

    def of(self, texts: list[str | None]) -> np.ndarray:
        """Dense features of whole texts."""
        if len(self) > MEMO_WORDS:
            self.clear_all()
        words = [(t or "").split() for t in texts]
        sizes = np.array([len(w) for w in words])
        out = np.zeros((len(texts), 16))
        if not sizes.sum():
            return out
        rows = np.fromiter((k for w in words for k in map(self.__getitem__, w)), np.int64, int(sizes.sum()))
        table = self.table[rows]
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(table, starts, axis=0).astype(float)
        n, chars = sizes[full], np.maximum(total[:, 11], 1)
        hit = (table[:, 1] + table[:, 2]) > 0
        near = np.zeros(len(full))
        you = np.flatnonzero(table[:, 5])
        hits = np.flatnonzero(hit)
        if len(you) and len(hits):
            doc = np.repeat(np.arange(len(full)), n)
            at = np.searchsorted(you, hits)
            for side in (np.minimum(at, len(you) - 1), np.maximum(at - 1, 0)):
                ok = doc[you[side]] == doc[hits]
                np.maximum.at(near, doc[hits][ok], 1 / (1 + np.abs(you[side] - hits)[ok]))
        known = np.add.reduceat(hit.astype(float), starts)
        out[full] = np.stack(
            [
                np.maximum.reduceat(table[:, 0], starts), np.log1p(known), known / n, np.log1p(total[:, 1]), total[:, 1] / n, np.log1p(total[:, 2]), total[:, 2] / n,
                total[:, 0] / n, np.log1p(total[:, 13]), near, total[:, 6] / np.maximum(total[:, 7], 1), total[:, 10] / n, total[:, 8] / chars, total[:, 9] / chars,
                total[:, 3] / n + np.log1p(total[:, 4]), total[:, 12] / n,
            ],
            1,
        )
        return out


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _term_counts(batches):
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            counts[y].update({t for w in {plain(w)[0] for w in (text or "").split()} if w for t in terms(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())],
            names=["term", "toxic", "other"],
        )


def _features_of(lexicon: dict[str, float]):
    def run(batches):
        maker = Features(lexicon)
        for batch in batches:
            x = maker.of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["part", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learn from at most ``sample`` labelled rows that aren't held out; without both classes there is no model.

    A doc_id labelled more than once is toxic if one of its labels says so; labels with a null id or another value
    than 0 and 1 don't count; of a repeated doc_id every text is learnt from; a null text is an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Model()
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(sample // 2) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(6)).cast("int"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("part", "y", "text")  # at most ``sample`` small rows
    chosen = written(chosen, "toxicity-sample")
    first = chosen.filter("part < 3")
    counts = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    stats = first.select("text", "y").mapInArrow(_term_counts, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    least = max(3, math.ceil(0.004 * n1))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    top = stats.filter(F.col("a") >= least).withColumn("s", odds).filter("s >= 1").orderBy(F.desc("s"), "term").limit(LEXICON)
    lexicon = {r["term"]: float(r["s"]) for r in top.select("term", "s").collect()}
    rows = chosen.filter("part >= 3").mapInArrow(_features_of(lexicon), "part int, y int, x array<double>").collect()
    forget(chosen)
    rows.sort(key=lambda r: (r["part"], r["y"], r["x"]))
    part = np.array([r["part"] for r in rows])
    y = np.array([r["y"] for r in rows])
    if len(set(y[part < 5])) < 2 or not (part == 5).any():
        return Model()
    x = np.array([r["x"] for r in rows])
    trees = gbt.fit(x[part < 5], y[part < 5])
    late = part == 5
    weight = np.where(y[late] == 1, shares[1] / max(1, (y[late] == 1).sum()), shares[0] / max(1, (y[late] == 0).sum()))
    points, values = gbt.isotonic(trees.probability(x[late]), y[late], weight)
    return Model(lexicon, trees, points, values)


def _scores(model: Model, maker: Features, texts: list[str | None]) -> np.ndarray:
    x = maker.of(texts)
    if model.trees is None:
        hits = np.expm1(x[:, 5])
        return hits / (hits + 1)
    return np.interp(model.trees.probability(x), model.points, model.values)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep``, score (0 to 1) and predicted (1 from ``threshold`` on) of each whole text.

    A null or empty text has features of zero and the score these get. Without a model the score
    is known words / (known words + 1), after the seed lexicon alone. Other columns don't matter, a kept
    column named like a result's gets _given behind its name, repeated rows give repeated results, an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    source, names, schema = narrowed(docs, keep, "score double, predicted int", F.col("text"))

    def run(batches):
        maker = Features(model.lexicon)
        for batch in batches:
            s = _scores(model, maker, batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns, whatever these are called; see ``score``."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        maker = Features(model.lexicon)
        for batch in batches:
            kept = batch.filter(pa.array(_scores(model, maker, batch.column(at).to_pylist()) < threshold))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, docs.schema)
