"""I-Match fingerprints: terms within a band of inverse document frequency, hashed in randomised lexicon subsets.

Document frequencies count all documents. The band's lexicon is small whatever the corpus: a term in
at least ``rare`` of n documents, and their frequencies add up to the number of (document, term) pairs. So
there are no more than (mean number of distinct terms of a document) / ``rare`` of them, 300,000 if a document
has 300 on average, and that is what is broadcast: 16 bytes a term.
A fingerprint has one hash for each of several random subsets of the lexicon: of a text's sorted
distinct terms within that subset. Subsets of many rates make it tell exact, near and distant texts
apart; a subset in which a text has no term says nothing and is left blank.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, small_batches

#: The band, as shares of all documents: inverse document frequencies from ln 4 to ln 1000.
RARE, COMMON = 0.001, 0.25
#: Rows of a range that one task edits, on average, and ids looked at to find the ranges; beyond that ranges get longer.
RANGE_ROWS, MOST_PICKED = 10_000, 4_000_000
#: Subsets of each rate; rate k keeps a term with probability 2**-k.
PER_RATE, RATES = 6, 10
SUBSETS = PER_RATE * RATES
BLANK = "-" * 8
_TERM = re.compile(r"[^\W_]+")
_BITS = np.arange(SUBSETS, dtype=np.uint64)
MEMO_WORDS = 300_000


def text_terms(text: str) -> set[str]:
    """Distinct terms: runs of letters and digits, lower-cased."""
    return set(_TERM.findall(text.lower()))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns term (64-bit hash), df: in how many rows each term is. Counts are added up in Python before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            terms = list(counts)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([counts[t] for t in terms], pa.int64())], names=["term", "df"])
            counts.clear()
            return out

        for batch in batches:
            for x in batch.column(text).to_pylist():
                counts.update(text_terms(x or ""))
            if len(counts) > MEMO_WORDS:
                yield flush()
        if counts:
            yield flush()

    return docs.select(text).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", rare: float = RARE, common: float = COMMON) -> np.ndarray:
    """Sorted hashes of the terms within the band: in at least 2 and ``rare`` of all documents, in at most ``common`` of them (or 2).

    Repeated rows count as often as they come; null texts have no terms; an empty table has an empty lexicon.
    """
    small_batches(docs.sparkSession)
    n = docs.count()
    counted = frequencies(docs, text)
    band = counted.filter((F.col("df") >= max(2.0, rare * n)) & (F.col("df") <= max(2.0, common * n)))
    return np.sort(band.select("term").toArrow()["term"].to_numpy().astype(np.int64))


class Printer:
    """Fingerprints of texts by one lexicon."""

    def __init__(self, known: np.ndarray, seed: int):
        self.known, self.codes = known, {}
        bits = known.view(np.uint64)
        mixed = ((bits ^ np.uint64(seed * 1000003 + k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in range(SUBSETS))
        mixed = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) for x in mixed)
        rates = np.repeat(np.arange(1, RATES + 1), PER_RATE)
        # bit k of a term tells whether it is in subset k
        self.inside = np.zeros(len(known), np.uint64)
        for k, (x, r) in enumerate(zip(mixed, rates.tolist())):
            self.inside |= ((x >> np.uint64(64 - r)) == 0).astype(np.uint64) << np.uint64(k)
        self.value = (bits ^ (bits >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)

    def code(self, term: str) -> int:
        if len(self.codes) > MEMO_WORDS:
            self.codes.clear()
        h = np.uint64(xxhash.xxh3_64_intdigest(term)).astype(np.int64)
        at = int(np.searchsorted(self.known, h))
        out = self.codes[term] = at if at < len(self.known) and self.known[at] == h else -1
        return out

    def hashes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each subset's terms, and how many they are."""
        codes = self.codes
        found = sorted({c for t in text_terms(text) if (c := codes[t] if t in codes else self.code(t)) >= 0})
        inside, value = (self.inside[found][:, None] >> _BITS & np.uint64(1)).astype(bool), self.value[found]
        # terms are sorted and distinct, so a mixed sum of their values is a hash of the sequence
        out = np.zeros(SUBSETS, np.uint64)
        counts = inside.sum(0)
        if len(found):
            out = (inside * (value ^ (value >> np.uint64(32)))[:, None]).sum(0, dtype=np.uint64)
            out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return (out >> np.uint64(32)).astype(np.uint32), counts

    def fingerprint(self, text: str) -> str:
        h, n = self.hashes(text)
        return "".join(f"{x:08x}" if k else BLANK for x, k in zip(h.tolist(), n.tolist()))


def likeness(a: str, b: str) -> float:
    """Share of the subsets in which the two fingerprints agree, among those in which either has terms; 1 for two blank ones."""
    said = same = 0
    for k in range(0, max(len(a), len(b)), 8):
        x, y = a[k : k + 8], b[k : k + 8]
        if x != BLANK or y != BLANK:
            said += 1
            same += x == y
    return same / said if said else 1.0


def fingerprints(docs: DataFrame, known: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), seed: int = 9) -> DataFrame:
    """Columns ``keep`` and fingerprint of each whole text (null: empty, whose fingerprint is blank).

    A kept column of that name gets _given behind its own; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    source, names, schema = narrowed(docs, keep, "fingerprint string", F.col(f"`{text}`"))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # see the bound above

    def run(batches):
        printer = Printer(shared.value, seed)
        for batch in batches:
            prints = [printer.fingerprint(x or "") for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(prints, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def _starts(rows: DataFrame) -> tuple[np.ndarray, bool]:
    """Smallest ids of ranges of about RANGE_ROWS rows, and whether null ids come before them.

    Every tenth of the ids that a hash picks, one in RANGE_ROWS / 10 or in as many as give MOST_PICKED.
    """
    about = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False)).alias("nulls")).first()
    every = max(RANGE_ROWS // 10, -(-about["n"] // MOST_PICKED))
    picked = rows.select("doc_id").filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(every)) == 0).distinct()
    ids = np.sort(picked.dropna().toArrow()["doc_id"].to_numpy())[9::10]  # at most about MOST_PICKED numbers
    least = about["least"] if about["least"] is not None else 0
    return np.concatenate([[least], ids[ids > least]]).astype(np.int64), about["nulls"]


def edited_texts(docs: DataFrame, known: np.ndarray, seed: int = 9) -> DataFrame:
    """Each document beside its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edit replaces the last floor(n_chars / 2) code points by the first as many of the next
    document (all, if it has fewer). Next goes by ascending doc_id (null first, ties by text), after
    the last comes the first. Rows are dealt into ranges of ids; each range also gets the first row of
    the range behind it, so one pass in order over each range sees every pair of neighbours.
    Null texts are empty; the only row of a table is its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    starts, nulls = _starts(rows)
    bounds, shared = spark.sparkContext.broadcast(starts), spark.sparkContext.broadcast(known)  # see the bounds above

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the number of an id's range, and one more if the id is where the range starts."""
        at = np.searchsorted(bounds.value, ids.to_numpy(), "right") - 1
        return pd.Series(2 * at + (bounds.value[at] == ids.to_numpy()))

    ranged = rows.withColumn("place", place(F.coalesce("doc_id", F.lit(int(starts[0])))))
    part = F.shiftright("place", 1).cast("int")
    # the first rows of a range are guests of the range before it, those of the table of the last one
    very_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == int(starts[0])
    also = F.when(very_first, F.lit(len(starts) - 1)).when(F.col("doc_id").isNotNull() & (F.col("place") % 2 == 1) & (part > 0), part - 1)
    copies = F.filter(F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.struct(also.alias("part"), F.lit(True).alias("guest"))), lambda x: x["part"].isNotNull())
    dealt = ranged.select("doc_id", "text", F.explode(copies).alias("p")).select("p.part", "p.guest", "doc_id", "text")
    dealt = dealt.repartitionById(len(starts), F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        printer = Printer(shared.value, seed)
        held = None  # part, id, text, fingerprint
        done_part = None

        def pair(a, text_b, print_b):
            _, doc, text, mark = a
            half = len(text) // 2
            edited = text[: len(text) - half] + text_b[:half]
            edited_mark = printer.fingerprint(edited)
            return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, print_b)

        for batch in batches:
            out = []
            for part, guest, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if guest and part == done_part:
                    continue  # rows that tie with the first of the next range
                mark = printer.fingerprint(text)
                if held and held[0] == part:
                    out.append(pair(held, text, mark))
                if guest:
                    held, done_part = None, part
                else:
                    held = (part, doc, text, mark)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
