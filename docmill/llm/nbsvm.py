"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, under a linear hinge-loss model.

N-grams of a text are its words and pairs of words as written, with their signs and capitals, and runs of one to three
word shapes (capitals, digits, signs behind a word, the word before repeated). A text is the set of those it has.
Fitting takes a bounded sample of labelled rows, as many of either class, picked by hash. Each n-gram
is scaled by the logarithm of how much oftener texts of class 1 have it, and a linear model is
fitted to the scaled indicators by dual coordinate descent, one text's multiplier at a time. Texts
of the sample that it hasn't learnt from, weighed to the true class shares, fit the logistic curve that makes a
margin a probability. Scoring is one pass over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrowed, small_batches

#: Rows of the fitting sample at most, and n-grams of them all at most (rows beyond, in the order of their hashes, are left out).
SAMPLE, SAMPLE_NGRAMS = 8000, 20_000_000
#: N-grams are hashed to this many bits.
BITS = 20
SMOOTHING = 1.0
#: Cost of a unit of hinge loss, and passes over the sample.
COST, PASSES = 1.0, 12
THRESHOLD = 0.7
MEMO_WORDS = 300_000
_CLASSES = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "0")]
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other characters stay, runs of one of them as two."""
    for pattern, sign in _CLASSES:
        word = pattern.sub(sign, word)
    return re.sub(r"(.)\1+", r"\1\1", word)[:12]


class Grams(dict):
    """Word -> its place in the columns of hashes: of the word, and of its shape."""

    def __init__(self):
        super().__init__()
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.hashes = np.zeros((4096, 2), np.uint64)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[k] = xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(shape(word), 1)
        return k

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the texts behind one another, and how many each text has."""
        if len(self) > MEMO_WORDS:
            self.clear_all()
        words = [(t or "").split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        at = np.fromiter((k for w in words for k in map(self.__getitem__, w)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        word, form = self.hashes[at].T if len(at) else np.zeros((2, 0), np.uint64)
        same = np.zeros(len(at), bool)
        same[1:] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
        form = form ^ (same * _TIMES[2])
        found = [(word, doc), (form, doc)]
        for values, most in ((word, 2), (form, 3)):
            run = values
            for n in range(1, most):
                run = (run[:-1] * _TIMES[0] + values[n:] * _TIMES[1]) if len(run) else run
                if n < len(at):
                    inside = doc[n:] == doc[:-n]
                    found.append((run[inside] + np.uint64(n), doc[n:][inside]))
        mixed = [(h * _TIMES[2] >> np.uint64(64 - BITS)).astype(np.int64) | d << BITS for h, d in found]
        key = np.concatenate(mixed)
        key.sort()
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        return key & (1 << BITS) - 1, np.bincount(key >> BITS, minlength=len(texts))


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Weight of each hashed n-gram, and slope and place of the logistic curve; without weights every text scores ``prior``."""

    weights: np.ndarray | None = None
    slope: float = 1.0
    place: float = 0.0
    prior: float = 0.5


def ratios(grams: np.ndarray, sizes: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Log-count ratios of all n-grams: how much oftener texts of class 1 have them, each class's counts brought to sum 1."""
    side = np.repeat(y, sizes)
    p, q = (SMOOTHING + np.bincount(grams[side == c], minlength=1 << bits) for c in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(values: list[np.ndarray], places: list[np.ndarray], y: np.ndarray, width: int, cost: float = COST, passes: int = PASSES, seed: int = 12) -> np.ndarray:
    """Weights of least |w|^2 / 2 + cost * sum of max(0, 1 - y w x), y being 1 and -1: each step solves for one row's multiplier."""
    w, alpha = np.zeros(width), np.zeros(len(y))
    square = [float(v @ v) for v in values]
    rng = np.random.RandomState(seed)
    for _ in range(passes):
        for i in rng.permutation(len(y)).tolist():
            if not square[i]:
                continue
            at, v, sign = places[i], values[i], y[i]
            step = (sign * float(w[at] @ v) - 1) / square[i]
            new = min(max(alpha[i] - step, 0.0), cost)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * sign * v
                alpha[i] = new
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not below 0) and place of the weighted logistic curve, by Newton's method with halved steps."""

    def loss(a: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -(2 * y - 1) * (a[0] * margin + a[1]))).sum() + ridge * a[0] ** 2)

    a, x = np.zeros(2), np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        slope = x.T @ (weight * (p - y)) + [2 * ridge * a[0], 0]
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag([2 * ridge, 1e-9])
        step, size, now = np.linalg.solve(curve, slope), 1.0, loss(a)
        while size > 1e-6 and loss(a - size * step) > now:
            size /= 2
        a = a - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(a[0]), 0.0), float(a[1])


def _margins(pairs: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Margin of each text, its scaled indicators brought to length 1. ``pairs`` are (ratio, weight) of each n-gram."""
    r, w = pairs[grams].T.astype(float)
    ends = np.cumsum(sizes)
    sums = [np.concatenate([[0], np.cumsum(x)])[np.stack([ends - sizes, ends])] for x in (r * w, r * r)]
    dot, square = (s[1] - s[0] for s in sums)
    return dot / np.sqrt(np.maximum(square, 1e-12))


def _sampled(batches):
    maker = Grams()
    for batch in batches:
        grams, sizes = maker.of(batch.column(2).to_pylist())
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["place", "y", "grams"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 12) -> Model:
    """Learn from at most ``sample`` labelled rows that aren't held out, half of them of either class.

    A doc_id labelled more than once is of class 1 if all its labels say so; labels with a null id or another value than 0
    and 1 don't count; of a repeated doc_id every text is learnt from; a null text is an empty one. Without both classes
    there is no model, and every text scores the share of class 1 (0.5 without labels).
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    if len(shares) < 2:
        return Model(prior=prior)
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(sample // 2) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``sample`` small rows
    rows = chosen.select(F.xxhash64(F.lit(seed), "doc_id").alias("place"), "y", "text").mapInArrow(_sampled, "place bigint, y int, grams array<int>")
    # no more than ``sample`` rows of a bounded number of n-grams reach the driver
    some = rows.withColumn("n", F.size("grams"))
    got = some.withColumn("total", F.sum("n").over(Window.orderBy("place", "y", "n"))).filter(F.col("total") <= SAMPLE_NGRAMS).select("place", "y", "grams").toArrow()
    got = got.sort_by([("place", "ascending"), ("y", "ascending")])
    place, y = (got.column(c).to_numpy() for c in ("place", "y"))
    lists = got.column("grams").combine_chunks()
    grams, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    late = place.astype(np.uint64) // np.uint64(7) % np.uint64(4) == 0  # a quarter for the curve
    if len(set(y[~late])) < 2 or len(set(y[late])) < 2:
        return Model(prior=prior)
    owner = np.repeat(late, sizes)
    ratio = ratios(grams[~owner], sizes[~late], y[~late])
    early = grams[~owner]
    parts = np.split(early, np.cumsum(sizes[~late])[:-1])
    scaled = [(r := ratio[p]) / max(1e-6, float(np.sqrt(r @ r))) for p in parts]
    weights = dual_descent(scaled, parts, 2 * y[~late] - 1, 1 << BITS)
    both = np.stack([ratio, weights], 1).astype(np.float32)
    margin = _margins(both, grams[owner], sizes[late])
    weight = np.where(y[late] == 1, prior / (y[late] == 1).sum(), (1 - prior) / (y[late] == 0).sum()) * late.sum()
    return Model(both, *logistic(margin, y[late], weight), prior)


def _scores(model: Model, maker: Grams, texts: list[str | None]) -> np.ndarray:
    if model.weights is None:
        return np.full(len(texts), model.prior)
    margin = _margins(model.weights, *maker.of(texts))
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.place, -30, 30)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep``, score (0 to 1) and predicted (1 from ``threshold`` on) of each whole text.

    A null or empty text has no n-grams and the score that a margin of 0 has. Other columns don't matter, a kept
    column named like a result's gets _given behind its name, repeated rows give repeated results, an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source, names, schema = narrowed(docs, keep, "score double, predicted int", F.col("text"))
    shared = spark.sparkContext.broadcast(model)  # 2**BITS pairs of numbers

    def run(batches):
        maker = Grams()
        for batch in batches:
            s = _scores(shared.value, maker, batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return source.mapInArrow(run, schema)
