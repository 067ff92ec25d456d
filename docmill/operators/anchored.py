"""Containment join of many passages with many texts, exact, without handing the passages out.

A passage can only be in a text that holds every gram (run of characters) of it. So each passage is anchored at the
gram that the fewest texts hold, and only texts with that gram are looked at:

1. a passage offers a few grams (those of least hash); all texts count how many of them hold each one that is offered (a
   bitmap of gram hashes, bounded whatever the number of passages, tells which these may be; counts are summed in a task
   before the shuffle). Passages whose few are all common offer all their grams,
2. a passage with a gram that no text holds is in none; the others keep their rarest gram,
3. all texts give the places of anchors, an equi-join turns a place into the start of a passage,
4. the texts that hold a start, and no others, are dealt out; the SHA-256 digest of what stands at the start is compared
   with the passage's.

Neither passages nor texts are written or shuffled, but for the texts of step 4: what the other steps move is a few
numbers for each passage and place. Grams have a length of a power of two, 16 at most; a shorter passage has shorter
ones. Of a longer passage only grams whose hash 16 divides may be anchors (all of them, if there is none): what a gram is
doesn't depend on what holds it, so the text has that gram too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship, written

#: Longest gram, its power of two.
LEVELS = 4
#: One of so many grams may be an anchor.
ONE_OF = 16
#: Grams that a passage offers at first, and what number of texts makes a gram common.
FEW, COMMON = 8, 64
#: Bits of a bitmap for each hash, and at least and at most.
BITS_PER_HASH, LEAST_BITS, MOST_BITS = 64, 2**22, 2**27
#: Grams of passages or texts, or places of anchors, that a task holds before it hands them on; texts that it knows again.
HELD = 250_000
OWN = "pid long, gram long, at long, level int"
_FACTOR = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


def grams(codes: np.ndarray, level: int, group: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of 2**level code points, different ones for each ``group``."""
    h = codes.astype(np.uint64) + np.uint64(1)
    for k in range(level):
        step = 1 << k
        h = h[:-step] + h[step:] * np.uint64(pow(_FACTOR, step, 2**64)) if len(h) > step else h[:0]
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(group % 2**64)) * _SPREAD + np.uint64(level)
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _level(length: int) -> int:
    return min(LEVELS, length.bit_length() - 1)


def _batch(*columns: tuple[np.ndarray, pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)


def _unlike(batches, once: bool):
    """The rows of batches of (id, text, of); with ``once``, where an id tells its text, a task gives few of them again."""
    known: set[int] = set()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if once:
                if row[0] in known:
                    continue
                if len(known) >= HELD:
                    known.clear()
                known.add(row[0])
            yield row


def _of_passages(few: int | None, once: bool = False, asked=None):
    """pid, gram, at, level: distinct grams that may be a passage's anchor, ``few`` at most, with their first places; of the passages that ``asked`` lets through."""

    def own(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out():
            pid, h, at, level = (np.concatenate(x) for x in zip(*held))
            return _batch((pid, pa.int64()), (h.view(np.int64), pa.int64()), (at.astype(np.int64), pa.int64()), (level, pa.int32()), names=["pid", "gram", "at", "level"])

        if asked:
            batches = (b.filter(pa.array(asked(b.column(0).to_numpy().view(np.uint64)))) for b in batches)
        for pid, text, of in _unlike(batches, once):
            codes = _codes(text)
            level = _level(len(codes))
            h = grams(codes, level, of)
            some = np.flatnonzero(_sampled(h))
            h, at = np.unique(h[some] if len(some) else h, return_index=True)
            h, at = h[:few], (some[at] if len(some) else at)[:few]
            held.append((np.full(len(h), pid, np.int64), h, at, np.full(len(h), level, np.int32)))
            size += len(h)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return own


def _sampled(h: np.ndarray) -> np.ndarray:
    return h & np.uint64(ONE_OF - 1) == 0


def _maybe(hashes: DataFrame, n: int):
    """A function for tasks: which of some 64-bit hashes may be among the ``n`` in the first column. It holds MOST_BITS bits at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_HASH * n).bit_length()))
    at = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits.bit_length() + 1)
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()  # at most MOST_BITS / 64 rows of 16 bytes
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    shared = hashes.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(64 - bits.bit_length() + 1)

    def maybe(h: np.ndarray) -> np.ndarray:
        at = h >> shift
        return (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    return maybe


def _filter(keys: DataFrame):
    """Which of some grams may be among ``keys``, as a function for tasks, and the levels of these. Sampled grams and others have a bitmap each."""
    sampled = F.col("gram").bitwiseAND(ONE_OF - 1) == 0
    n = keys.agg(F.count_if(sampled).alias("sampled"), F.count_if(~sampled).alias("others"), F.sort_array(F.collect_set("level")).alias("levels")).first()
    of_sampled = _maybe(keys.filter(sampled).select("gram"), n.sampled) if n.sampled else None
    of_others = _maybe(keys.filter(~sampled).select("gram"), n.others) if n.others else None

    def maybe(h: np.ndarray) -> np.ndarray:
        found = of_others(h) if of_others else np.zeros(len(h), bool)
        at = np.flatnonzero(_sampled(h))
        found[at] = of_sampled(h[at]) if of_sampled else False
        return found

    return maybe, n.levels  # five at most


def _counts(maybe, levels: list[int], once: bool = False):
    """gram, n: how many of some texts (id, text, of) hold each gram that ``maybe`` lets through; no more than HELD and one text's are held."""

    def count(batches):
        held: list[np.ndarray] = []
        size = 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return _batch((h.view(np.int64), pa.int64()), (n, pa.int64()), names=["gram", "n"])

        for _, t, of in _unlike(batches, once):
            codes = _codes(t)
            for level in levels:
                h = grams(codes, level, of)
                h = np.unique(h[maybe(h)])
                held.append(h)
                size += len(h)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return count


def _places(found, levels: list[int], once: bool = False):
    """id, gram, place of the grams that ``found`` lets through in texts (id, text, of); no more than HELD and one text's are held."""

    def places(batches):
        ids, at, which = [], [], []
        size = 0

        def out():
            joined = [np.concatenate(x) for x in (ids, which, at)]
            return _batch((joined[0], pa.int64()), (joined[1].astype(np.uint64).view(np.int64), pa.int64()), (joined[2].astype(np.int64), pa.int64()), names=["id", "gram", "place"])

        for i, t, of in _unlike(batches, once):
            codes = _codes(t)
            for level in levels:
                h = grams(codes, level, of)
                p = np.flatnonzero(found(h))
                ids.append(np.full(len(p), i, np.int64))
                at.append(p)
                which.append(h[p])
                size += len(p)
            if size > HELD:
                yield out()
                ids, at, which, size = [], [], [], 0
        if ids:
            yield out()

    return places


def _holding(wanted, once: bool):
    """The texts (id, text, of, mark) whose mark ``wanted`` lets through."""

    def held(batches):
        known: set[int] = set()
        for batch in batches:
            keep = wanted(batch.column(3).to_numpy().view(np.uint64))
            if once:  # a copy's id is its text's
                for k in np.flatnonzero(keep):
                    i = batch.column(0)[k].as_py()
                    keep[k] = i not in known
                    if len(known) >= HELD:
                        known.clear()
                    known.add(i)
            yield batch.filter(pa.array(keep)).select([0, 1, 2])

    return held


def keyed(text: str, by: str | None = None) -> list[Column]:
    """Of a text, in its group: of, digest, n (its length), pid (a number of the text in the group)."""
    of = F.xxhash64(by) if by else F.lit(0).cast("long")
    digest = F.unhex(F.sha2(text, 256))
    return [of.alias("of"), digest.alias("digest"), F.char_length(text).alias("n"), F.xxhash64(digest, of).alias("pid")]


def _rarest(own: DataFrame, texts: DataFrame, once: bool) -> DataFrame:
    """pid, a: of each passage's grams in ``own`` the one that the fewest texts hold, and how many do."""
    maybe, levels = _filter(own)
    df = texts.mapInArrow(_counts(maybe, levels, once), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df"))
    counted = own.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return counted.groupBy("pid").agg(F.min_by(F.struct("gram", "at", "level", "df"), F.struct("df", "at")).alias("a"))


def _met(passages: DataFrame, known: DataFrame, texts: DataFrame, once: bool) -> DataFrame | None:
    """pid, digest, id of the passages (pid, said, of) in texts (id, text, of); ``known`` has their pid, of, n and digest. None, if nothing can be in anything.

    With ``once`` the passages are the texts, an id is its text's pid, and a text is not said to be in itself.
    """
    own = written(passages.mapInArrow(_of_passages(FEW, once), OWN), "passage-grams")
    if not own.limit(1).count():
        return None
    rarest = written(_rarest(own, texts, once), "rarest")
    common = rarest.filter(F.col("a.df") > COMMON).select("pid")
    if n := common.count():
        again = written(passages.mapInArrow(_of_passages(None, once, _maybe(common, n)), OWN), "passage-grams")
        both = rarest.unionByName(_rarest(again, texts, once))
        rarest = written(both.groupBy("pid").agg(F.min_by("a", F.struct("a.df", "a.at")).alias("a")), "rarest")
    # a gram that only one text holds is that of the passage itself
    anchors = written(rarest.select("pid", "a.*").filter(F.col("df") > int(once)), "anchors")
    if not anchors.limit(1).count():
        return None
    found, levels = _filter(anchors)

    hits = texts.filter("id is not null").mapInArrow(_places(found, levels, once), "id long, gram long, place long")
    starts = hits.join(anchors.select("gram", "pid", "at"), "gram").select("id", "pid", (F.col("place") - F.col("at")).alias("start")).filter("start >= 0")
    starts = written((starts.filter("id <> pid") if once else starts).distinct(), "starts")
    wanted = _maybe(starts.select(F.xxhash64("id")), starts.count())
    held = texts.filter("id is not null").withColumn("mark", F.xxhash64("id")).mapInArrow(_holding(wanted, once), "id long, text string, of long")
    met = held.join(starts.join(known.distinct(), "pid"), ["id", "of"]).filter(F.unhex(F.sha2(F.substring("text", F.col("start").cast("int") + 1, F.col("n")), 256)) == F.col("digest"))
    return met.select("pid", "digest", "id").distinct()


def contained(passages: DataFrame, docs: DataFrame, passage: str = "query_id", doc: str = "doc_id", text: str = "text", by: str | None = None) -> DataFrame:
    """(passage, doc) of the documents that hold a passage as it is, each pair once; with ``by`` only those of the same ``by``.

    Empty and null passages are in none, null texts hold none; a repeated id has the passages of all its rows. Nothing but
    bounded bitmaps leaves the executors. Most of the steps start jobs at plan time.
    """
    ship(docs.sparkSession)
    said = passages.filter(F.col(text) != "").select(F.col(passage).cast("long").alias("qid"), F.col(text).alias("said"), *keyed(text, by))
    asked = written(said.drop("said").distinct(), "passages")
    texts = docs.filter(F.col(text) != "").select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"), keyed(text, by)[0])
    met = _met(said.select("pid", "said", "of"), asked.select("pid", "of", "n", "digest"), texts, once=False)
    if met is None:
        return texts.select(F.col("id").alias(passage), F.col("id").alias(doc)).limit(0)
    return met.join(asked, ["pid", "digest"]).select(F.col("qid").alias(passage), F.col("id").alias(doc)).distinct()


def contained_in_others(rows: DataFrame) -> DataFrame | None:
    """(a, b): the text of pid a is part of another one of its group, of pid b. ``rows`` (text and what ``keyed`` tells of it) are read several times."""
    ship(rows.sparkSession)
    met = _met(rows.select("pid", F.col("text").alias("said"), "of"), rows.select("pid", "of", "n", "digest"), rows.select(F.col("pid").alias("id"), "text", "of"), once=True)
    return met if met is None else met.select(F.col("pid").alias("a"), F.col("id").alias("b"))
