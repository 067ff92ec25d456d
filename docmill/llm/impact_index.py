"""Ranked lexical search on a bit-sliced impact index.

``build`` reads whole texts once and writes postings: for each block of documents and each of its terms the
places (slots) of the documents that hold it and how often they do. Nothing in it depends on other blocks,
so blocks of new documents can be added. What a term adds to a document's score, its impact, needs the number of all
documents and words; ``sliced`` turns postings of asked terms into impacts and cuts these into bit slices: slice j
is a bitmap of the postings whose impact has bit j. ``search`` spreads the slices of an item's terms over
the block's slots, adds them by carry arithmetic on 64 documents a word, and finds the best documents by
walking the sums from the most significant slice down. Blocks give their k best, a window the k best of all.

Every step works on one block, which holds a bounded number of documents and words; items go in groups of a
bounded number of terms. Nothing that grows with the documents goes through the driver or to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Documents of a block at most (slots are 16 bits), and words after which a block ends.
BLOCK_DOCS, BLOCK_WORDS = 32_768, 3_000_000
#: (item, term) rows of a group of items, about; and numbers of the bitmaps that a task holds at once.
GROUP_TERMS, BITMAP_WORDS = 200_000, 6_000_000
#: Length normalisation in hundredths, saturation and scale of the impact formula.
NORM, SCALE, TF_SCALE, LENGTH_SCALE = 75, 10**9, 1000, 8
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() and c < 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and all other code points from U+0080, A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


class _Ids(dict):
    """Term -> its number, in the order of first use."""

    def __missing__(self, term: bytes) -> int:
        out = self[term] = len(self)
        return out


_POSTINGS = "block bigint, term binary, slots binary, counts binary, docs bigint, words bigint"


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of consecutive runs of ``values``, which end at ``ends``."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _block(number: int, ids: list[int | None], lengths: list[int], words: list[np.ndarray], terms: _Ids) -> Iterator[pa.RecordBatch]:
    """Rows of one block; the first, without a term, has the ids and lengths of its documents, ids ascending, nulls last."""
    n = len(ids)
    given = np.array([x is not None for x in ids])
    values = np.array([x if x is not None else 0 for x in ids], np.int64)
    order = np.lexsort((values, ~given))
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    size = np.array(lengths, np.int64)
    known = int(given.sum())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.array([None], pa.binary()), pa.array([values[order][:known].tobytes()], pa.binary()), pa.array([size[order].tobytes()], pa.binary()),
            pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64()),
        ],
        names=["block", "term", "slots", "counts", "docs", "words"],
    )
    if not terms:
        return
    key = np.concatenate(words).astype(np.int64) * n + np.repeat(slot, size)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.uint32)
    at = key[first]
    ends = np.searchsorted(at, (np.arange(len(terms)) + 1) * n)
    names, slots = list(terms), (at % n).astype(np.uint16)
    for k in range(0, len(names), 50_000):
        part = slice(ends[k - 1] if k else 0, ends[min(k + 50_000, len(names)) - 1])
        here = ends[k : k + 50_000] - part.start
        m = len(here)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m, number)), pa.array(names[k : k + m], pa.binary()), _binaries(slots[part], here), _binaries(count[part], here),
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
            ],
            names=["block", "term", "slots", "counts", "docs", "words"],
        )


def _blocks(batches):
    place, made = TaskContext.get().partitionId() << 32, 0
    ids, lengths, words, terms, total = [], [], [], _Ids(), 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
            ids.append(doc)
            lengths.append(len(own))
            words.append(np.fromiter(map(terms.__getitem__, own), np.int32, len(own)))
            total += len(own)
            if len(ids) >= BLOCK_DOCS or total >= BLOCK_WORDS:
                yield from _block(place + made, ids, lengths, words, terms)
                made += 1
                ids, lengths, words, terms, total = [], [], [], _Ids(), 0
    if ids:
        yield from _block(place + made, ids, lengths, words, terms)


@dataclass
class Index:
    """``postings``: block, term, slots, counts; ``blocks``: block, ids, lengths. ``docs``, ``words``: documents with a term, and all terms."""

    postings: DataFrame
    blocks: DataFrame
    docs: int
    words: int


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index every row of ``docs`` by all terms of its whole text.

    A null text has no term; repeated rows are documents each; a null id stays and stands behind all others
    among equal scores. Other columns don't matter. An empty table gives an index without blocks.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("said"))
    rows = written(rows.mapInArrow(_blocks, _POSTINGS), "postings")
    # read apart, so that the two can be grouped together
    blocks = docs.sparkSession.read.schema(rows.schema).parquet(rows._docmill_path).filter("term is null").select("block", F.col("slots").alias("ids"), F.col("counts").alias("lengths"), "docs", "words")
    n, words = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return Index(rows.filter("term is not null").select("block", "term", "slots", "counts"), blocks.select("block", "ids", "lengths"), n, words)


def _terms(batches):
    for batch in batches:
        words = [words_of(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(1)]
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([w for ws in words for w in ws], pa.binary())], names=["item_id", "term"])


def asked_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term, times: how often each term stands in each item; rows of one item count together."""
    small_batches(items.sparkSession)
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("said"))
    return rows.mapInArrow(_terms, "item_id bigint, term binary").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _runs(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column behind one another, and the number of bytes of each row."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.uint8), np.array([len(c) for c in cells], np.int64)


def _lengths_norm(lengths: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of each document; in Python's integers where 64 bits might not do."""
    if len(lengths) and NORM * int(lengths.max()) * docs >= 2**63:
        return np.array([100 - NORM + NORM * int(x) * docs // words for x in lengths], np.int64)
    return 100 - NORM + NORM * lengths * docs // max(words, 1)


def _cut(docs: int, words: int):
    """Bit slices of the impacts of one block's terms."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["block", "term", "slots", "slices"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] + [pa.array([], pa.binary())] * 3, names=names)
        m = _lengths_norm(np.frombuffer(right.column("lengths")[0].as_py(), np.int64), docs, words)
        raw, size = _runs(left.column("slots"))
        slots, df = raw.view(np.uint16).astype(np.int64), size // 2
        tf = _runs(left.column("counts"))[0].view(np.uint32).astype(np.int64)
        impact = np.repeat(left.column("weight").to_numpy(), df) * (SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * m[slots]))
        wide = (df + 7) // 8  # bytes of a term's slice
        begin = np.cumsum(wide) - wide
        spread = np.zeros(int(wide.sum()) * 8, np.int64)
        spread[np.arange(len(impact)) + np.repeat(begin * 8 - (np.cumsum(df) - df), df)] = impact
        slices = max(1, int(impact.max()).bit_length())
        bits = np.stack([np.packbits((spread >> s & 1).astype(np.uint8), bitorder="little") for s in range(slices)])
        cells: list[bytes] = [b""] * len(df)
        for w in np.unique(wide).tolist():  # terms of as many bytes together
            at = np.flatnonzero(wide == w)
            every = bits[:, begin[at][:, None] + np.arange(w)].transpose(1, 0, 2).reshape(len(at), -1)
            for k, row in zip(at.tolist(), every):
                cells[k] = row.tobytes()
        return pa.table([left.column("block"), left.column("term"), left.column("slots"), pa.array(cells, pa.binary())], names=names)

    return run


def sliced(index: Index, terms: DataFrame) -> DataFrame:
    """block, term, slots, slices: the bit-sliced impacts of ``terms`` (term) in every block; weight 0 is left out, for it adds nothing."""
    held = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.sum(F.octet_length("slots") / 2).cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = df.select("term", weight.alias("weight")).filter("weight > 0")
    met = index.postings.join(weights, "term").select("block", "term", "weight", "slots", "counts")
    cut = met.groupBy("block").cogroup(index.blocks.groupBy("block")).applyInArrow(_cut(index.docs, index.words), "block bigint, term binary, slots binary, slices binary")
    return written(cut, "slices")


def spread_slices(slots: np.ndarray, cell: bytes, words: int) -> np.ndarray:
    """A term's slices as bitmaps over all slots of a block: (slices, words of 64 bits)."""
    wide = (len(slots) + 7) // 8
    bits = np.unpackbits(np.frombuffer(cell, np.uint8).reshape(-1, wide), axis=1, bitorder="little")[:, : len(slots)]
    word = slots >> 6
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros((len(bits), words), np.uint64)
    out[:, word[first]] = np.add.reduceat(bits * (np.uint64(1) << (slots & 63).astype(np.uint64)), first, axis=1)
    return out


def add_slices(total: np.ndarray, more: np.ndarray, shift: int = 0) -> None:
    """``total`` += ``more`` << ``shift``, both bit-sliced along their first axis, least significant slice first."""
    carry = None
    for s in range(len(more)):
        a, b = total[s + shift], more[s]
        odd = a ^ b
        both = a & b
        if carry is None:
            total[s + shift], carry = odd, both
        else:
            total[s + shift] = odd ^ carry
            carry = both | (carry & odd)
    for s in range(len(more) + shift, len(total)):
        if carry is None or not carry.any():
            return
        a = total[s]
        total[s], carry = a ^ carry, a & carry


def best_slots(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and sums of the ``k`` largest positive sums, ties to smaller slots; not in order of their sums."""
    sure = np.zeros(total.shape[1], np.uint64)
    open_ = np.bitwise_or.reduce(total, axis=0)
    for s in range(len(total) - 1, -1, -1):
        high = open_ & total[s]
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            open_ = high
        else:
            sure |= high
            open_ &= ~total[s]
            if n == k:
                open_[:] = 0
                break
    slots = [np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, open_)]
    found = np.concatenate([slots[0], slots[1][: k - len(slots[0])]])
    bits = total[:, found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)
    return found, (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(0)


def _rank(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["item_id", "doc_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids = np.frombuffer(right.column("ids")[0].as_py(), np.int64)
        words = (len(right.column("lengths")[0].as_py()) // 8 + 63) // 64
        slots = [np.frombuffer(c, np.uint16).astype(np.int64) for c in left.column("slots").to_pylist()]
        cells = left.column("slices").to_pylist()
        slices = max(len(c) // ((len(s) + 7) // 8) for s, c in zip(slots, cells))
        asked: dict[int | None, list[tuple[int, int]]] = {}
        for term, uses in enumerate(left.column("uses").to_pylist()):
            for use in uses:
                asked.setdefault(use["item_id"], []).append((term, use["times"]))
        out: tuple[list, list, list] = [], [], []
        # items of many terms first, so that those with a term left are always the first ones of a part
        queue = sorted(asked.items(), key=lambda x: -len(x[1]))
        while queue:
            tall = slices + sum(t for _, t in queue[0][1]).bit_length() + 1
            many = max(1, BITMAP_WORDS // (words * (slices * len(queue[0][1]) + tall)))
            part, queue = queue[:many], queue[many:]
            tall = slices + max(sum(t for _, t in uses) for _, uses in part).bit_length()
            part.sort(key=lambda x: -sum(times & 1 for _, times in x[1]))
            total = np.zeros((tall, len(part), words), np.uint64)
            # a single item of very many terms takes its bitmaps one by one
            ready = {t: spread_slices(slots[t], cells[t], words) for t in {t for _, uses in part for t, _ in uses}} if len(part) > 1 else None
            for shift in range(max(t for _, uses in part for _, t in uses).bit_length()):
                lists = [[t for t, times in uses if times >> shift & 1] for _, uses in part]
                for step in range(max(map(len, lists))):
                    rows = [j for j, own in enumerate(lists) if len(own) > step]
                    more = np.zeros((slices, len(rows), words), np.uint64)
                    for x, j in enumerate(rows):
                        t = lists[j][step]
                        own = ready[t] if ready else spread_slices(slots[t], cells[t], words)
                        more[: len(own), x] = own
                    if rows[-1] == len(rows) - 1:  # the first ones: in place
                        add_slices(total[:, : len(rows)], more, shift)
                    else:
                        sums = total[:, rows]
                        add_slices(sums, more, shift)
                        total[:, rows] = sums
            for j, (item, _) in enumerate(part):
                at, score = best_slots(total[:, j], k)
                out[0].extend([item] * len(at))
                out[1].extend(ids[x] if x < len(ids) else None for x in at.tolist())
                out[2].extend(score.tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], names=names)

    return run


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item of ``asked_terms``.

    Equal scores go by ascending doc_id, a null one last; an item whose terms no document holds has no rows. Items with
    very many terms, or a term repeated very often, are right too: repeats are added by their binary digits.
    """
    asked = written(asked, "asked")
    groups = max(1, -(-asked.count() // GROUP_TERMS))
    group = F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int")
    uses = asked.groupBy(group.alias("part"), "term").agg(F.collect_list(F.struct("item_id", "times")).alias("uses"))
    left = sliced(index, asked).join(uses, "term").select("part", "block", "slots", "slices", "uses")
    right = index.blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_rank(k), "item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
