"""Near duplicates: MinHash signatures, banding, verification and connected components.

1. Each whole text becomes the set of its distinct word shingles (64-bit hashes); texts with equal
   sets form a class that its smallest id stands for.
2. Universal hash minima of a class give a signature; bands of it are the keys of buckets, and its lower 16 bits are kept for verification. With
   45 bands of 6 minima a pair of similarity 0.8 shares no bucket with a probability of 1e-6.
3. In each bucket every member is compared with the smallest one only: members - 1 pairs. Pairs
   pass a signature check and are then confirmed on the full sets.
4. Components of the confirmed links. Only a bucket with a failed pair whose ends are still in different
   components can hold further links. There signatures meet block by block inside a task, each pair in the
   first bucket it shares. Where a member would have to be dealt to more than MOST_BLOCKS blocks, the bucket's
   members are dealt again by an exact prefix filter: sets as similar as wanted share one of the rarest
   shingles of each, so only members with such a shingle in common meet. Members with a pair that may be linked come back with their full sets, and the task
   emits the confirmed links that join components, fewer than it has members. So there is no cap on
   buckets, and no list of all pairs of a group either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, parted, small_batches, written
from .components import connected_components

BANDS, ROWS = 45, 6
#: Verification lets a pair pass from this many standard deviations below the wanted similarity.
SLACK = 4.5
#: Members of a block whose signatures meet in one task, their shingles on average, and blocks of a bucket.
BLOCK, BLOCK_SHINGLES, MOST_BLOCKS = 1024, 1_000_000, 32
#: Slots in which shingles are counted to tell rare from frequent ones; any count gives the same links.
SLOT_BITS = 16
#: Words whose hashes a task remembers.
MEMO_WORDS = 150_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text of fewer words than
    ``width`` has its whole sequence as the one shingle, one without words has none.
    """
    if len(_words) > MEMO_WORDS:
        _words.clear()
    hashes, sizes = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        hashes.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
        sizes.append(len(words))
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    rolled = _mixed(every + _GOLDEN)
    for k in range(1, width):
        rolled = rolled[: len(every) - k] if len(every) > k else rolled[:0]
        if len(rolled):
            rolled = _mixed(rolled * _GOLDEN + every[k : k + len(rolled)])
    out, at = [], 0
    for words, n in zip(hashes, sizes):
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(words.tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` multiply-add hash functions on 32 bits."""
    rng = np.random.RandomState(seed)
    a = rng.randint(0, 2**32, count, np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.randint(0, 2**32, count, np.uint64).astype(np.uint32)


def signatures(sets: list[np.ndarray], count: int, seed: int) -> np.ndarray:
    """``count`` hash minima of each non-empty set."""
    a, b = _family(count, seed)
    out = np.empty((count, len(sets)), np.uint32)
    done = 0
    while done < len(sets):
        upto, total = done, 0
        while upto < len(sets) and (total < 32768 or upto == done):
            total += len(sets[upto])
            upto += 1
        x = (np.concatenate(sets[done:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[done : upto - 1])])
        h = np.empty_like(x)
        for k in range(count):
            np.multiply(x, a[k], out=h)
            np.add(h, b[k], out=h)
            out[k, done:upto] = np.minimum.reduceat(h, starts)
        done = upto
    return out.T


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(minima), 0) * _GOLDEN
    for k in range(rows):
        keys = _mixed(keys + minima[:, k : bands * rows : rows].astype(np.uint64))
    return keys


_SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, minima array<smallint>"


def _lists(flat: np.ndarray, width: int, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat, kind))


def sign(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            minima = np.zeros((len(sets), bands * rows), np.uint32)
            if full:
                minima[full] = signatures([sets[k] for k in full], bands * rows, seed)
            keys = band_keys(minima, bands, rows)
            set_a = np.array([np.bitwise_xor.reduce(_mixed(s ^ _GOLDEN)) if len(s) else 0 for s in sets], np.uint64)
            set_b = np.array([_mixed(s + _MIX).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_a.view(np.int64)),
                    pa.array(set_b.view(np.int64)), _lists(keys.reshape(-1).view(np.int64), bands, pa.int64()),
                    _lists(minima.astype(np.uint16).reshape(-1).view(np.int16), bands * rows, pa.int16()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "minima"],
            )
        _words.clear()  # the worker goes on to other tasks

    return docs.mapInArrow(run, _SIGNED)


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "shingles"])
        _words.clear()

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _least_equal(threshold: float, minima: int) -> int:
    return int(np.floor(minima * threshold - SLACK * np.sqrt(minima * threshold * (1 - threshold))))


def confirm(pairs: DataFrame, docs: DataFrame, signed: DataFrame, width: int, percent: int, minima: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets have 100 * intersection >= percent * union."""
    least = _least_equal(percent / 100, minima)
    marks = signed.select("doc_id", "minima")
    near = (
        pairs.join(marks.select(F.col("doc_id").alias("u"), F.col("minima").alias("mu")), "u")
        .join(marks.select(F.col("doc_id").alias("v"), F.col("minima").alias("mv")), "v")
        .filter(F.expr(f"aggregate(zip_with(mu, mv, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) >= {least}"))
        .select("u", "v")
    )
    near = written(near, "near-pairs")
    needed = near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = written(_full_sets(parted(docs, "doc_id", needed)[0], width), "shingle-sets")
    met = near.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv")), "v")
    common = met.select("u", "v", F.size(F.array_intersect("su", "sv")).cast("long").alias("i"), (F.size("su") + F.size("sv")).cast("long").alias("n"))
    links = written(common.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("u", "v"), "links")
    forget(near, sets)
    return links


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Columns v, component, n_shingles, bucket: for each set (doc_id, component, shingles) the shingles of which a set linked to it must have one among its own.

    In any order of all shingles two sets with 100 * intersection >= ``percent`` * union share one of the first
    n - ceil(percent * n / 100) + 1 of each. The order here is from rare to frequent, as far as the counts of
    2**SLOT_BITS hash slots tell; these counts, not the shingles, go through the driver.
    """
    spark = sets.sparkSession
    slot = F.shiftrightunsigned("s", 64 - SLOT_BITS).cast("int")
    counted = sets.select(F.explode("shingles").alias("s")).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()  # at most 2**SLOT_BITS rows
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            sizes, tokens = [], []
            for x in batch.column("shingles"):
                own = np.asarray(x.values).view(np.uint64)
                order = np.lexsort((own, shared.value[own >> np.uint64(64 - SLOT_BITS)]))
                sizes.append(len(own))
                tokens.append(own[order[: len(own) + percent * len(own) // -100 + 1]])
            many = [len(t) for t in tokens]
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            told = [np.repeat(np.array(x, np.int64), many) for x in (batch.column("doc_id").to_pylist(), batch.column("component").to_pylist(), sizes)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, told), pa.array(flat.view(np.int64))], names=["v", "component", "n_shingles", "bucket"])

    return sets.mapInArrow(run, "v bigint, component bigint, n_shingles bigint, bucket bigint")


def _open_pairs(group: pd.DataFrame, least: int, bands: int, rows: int):
    """Of each member of a block, or of two, the later ones that may be linked to it, in another component.

    Their signatures agree often enough, and this bucket is the first that the two share, so that no
    other bucket has to look at the pair (members dealt by a shingle have band -1 and may meet more than once).
    """
    ids, parts, blocks = (group[c].to_numpy() for c in ("v", "component", "block"))
    minima = np.stack(group["minima"].to_numpy())
    band, one = group["band"].iloc[0], group["i"].iloc[0] == group["j"].iloc[0]
    for k in range(len(ids) - 1):
        may = (parts[k + 1 :] != parts[k]) & (ids[k + 1 :] != ids[k])
        if not one:
            may &= blocks[k + 1 :] != blocks[k]
        at = np.flatnonzero(may) + k + 1
        if len(at):
            equal = minima[at] == minima[k]
            near = equal.sum(1) >= least
            at, equal = at[near], equal[near]
            if band >= 0:
                at = at[equal.reshape(len(at), bands, rows).all(2).argmax(1) == band]
        if len(at):
            yield k, at


_GROUP = ["bucket", "band", "i", "j"]


def _active(least: int, bands: int, rows: int):
    """Members that some pair of their block asks for."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v", kind="stable")
        wanted = np.zeros(len(group), bool)
        for k, at in _open_pairs(group, least, bands, rows):
            wanted[k] = wanted[at] = True
        return group.loc[wanted, [*_GROUP, "block", "v", "component"]]

    return run


def _joining(least: int, bands: int, rows: int, percent: int):
    """Links of a block that join components, confirmed on full sets: fewer than its members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v", kind="stable")
        ids, parts = group["v"].to_numpy(), group["component"].to_numpy()
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in group["shingles"]]  # sorted as unsigned
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for k, at in _open_pairs(group, least, bands, rows):
            own, mine = sets[k], find(parts[k])
            at = [x for x in at.tolist() if find(parts[x]) != mine]
            if not at:
                continue
            flat = np.concatenate([sets[x] for x in at])
            sizes = np.array([len(sets[x]) for x in at])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for x in np.flatnonzero(common * 100 >= (sizes + len(own) - common) * percent).tolist():
                a, b = find(parts[k]), find(parts[at[x]])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((ids[k], ids[at[x]]))
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 11, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, n_shingles, component_id and kept of each row.

    Two rows are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word
    shingles; component_id is the smallest id that links reach, kept tells whether it is the row's own.
    Texts that are null, empty or without words have n_shingles 0 and are linked with nothing. Rows
    with equal sets are linked however many they are. Rows of one id are one node. A row without an
    id has no component and is kept. Other columns don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    minima = bands * rows
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    signed = written(sign(docs, width, bands, rows, seed), "signed")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    buckets = reps.select(F.col("doc_id").alias("v"), "n_shingles", F.posexplode("bands").alias("band", "bucket")).repartition("bucket")
    firsts = buckets.groupBy("bucket").agg(F.min("v").alias("u"), F.count("*").alias("members"), F.sum("n_shingles").alias("held")).filter("members > 1")
    candidates = written(buckets.join(firsts, "bucket").filter("u <> v").select("bucket", "band", "members", "held", "u", "v"), "candidates")

    links = confirm(candidates.select("u", "v").distinct(), docs, some, width, percent, minima)
    found = written(connected_components(links), "components")
    label = found.select("node", "component")

    def labelled(rows_: DataFrame, node: str, name: str) -> DataFrame:
        return rows_.join(label.withColumnsRenamed({"node": node, "component": name}), node, "left").withColumn(name, F.coalesce(name, node))

    failed = candidates.filter("members > 2").join(links, ["u", "v"], "left_anti").select("u", "v").distinct()
    apart = labelled(labelled(failed, "u", "cu"), "v", "cv").filter("cu <> cv").select("u", "v")
    opened = candidates.filter("members > 2").join(apart, ["u", "v"], "left_semi").select("bucket", "band", "members", "held", "u").distinct()
    opened = written(opened, "open-buckets")
    members = candidates.join(opened.select("bucket"), "bucket", "left_semi").select("bucket", "band", "members", "held", "v")
    members = members.unionByName(opened.select("bucket", "band", "members", "held", F.col("u").alias("v"))).distinct()
    members = written(labelled(members, "v", "component"), "open-members")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("held") / BLOCK_SHINGLES)).cast("int")
    large = blocks > MOST_BLOCKS
    in_large = written(members.filter(large).select("v", "component").distinct(), "large-members")
    large_sets = _full_sets(parted(docs, "doc_id", in_large.select(F.col("v").alias("doc_id")))[0], width)
    large_sets = written(large_sets.join(in_large.withColumnRenamed("v", "doc_id"), "doc_id"), "large-sets")
    # of shingles that lie in one component only nothing has to be compared
    prefixes = written(_prefixes(large_sets, percent), "prefixes")
    shared = prefixes.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    shared = shared.filter("lo <> hi").select("bucket", "members", "held")
    dealt = prefixes.join(shared, "bucket").select("bucket", F.lit(-1).alias("band"), "members", "held", "v", "component")

    facts = some.select(F.col("doc_id").alias("v"), "minima").dropDuplicates(["v"])
    rows_in = members.filter(~large).unionByName(dealt).join(facts, "v")
    pieces = (
        rows_in.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "v", "component", "minima")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = _least_equal(percent / 100, minima)
    ask = pieces.repartition(tasks, *_GROUP).groupBy(*_GROUP).applyInPandas(_active(least, bands, rows), "bucket bigint, band int, i int, j int, block int, v bigint, component bigint")
    ask = written(ask, "active")
    needed = ask.select(F.col("v").alias("doc_id")).distinct()
    sets = written(_full_sets(parted(docs, "doc_id", needed)[0], width), "shingle-sets")
    met = ask.join(facts.select("v", "minima"), "v").join(sets.select(F.col("doc_id").alias("v"), "shingles").dropDuplicates(["v"]), "v")
    more = met.repartition(tasks, *_GROUP).groupBy(*_GROUP).applyInPandas(_joining(least, bands, rows, percent), "u bigint, v bigint")
    more = written(more, "links")
    if more.limit(1).count():
        ends = (
            more.join(label.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
            .join(label.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
            .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        )
        second = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("root"))
        inner = found.join(second, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        outer = second.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("root").alias("component"))
        joined = written(inner.unionByName(outer), "components")
        forget(found)
        found = joined
    forget(candidates, links, opened, members, in_large, large_sets, prefixes, ask, sets, more)

    roots = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("root"))
    rows_ = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(roots, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return rows_.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
