"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards by a hash of their id. Equal vectors of a shard are one node, whose ids stand
beside it. A shard becomes one row: ids, vectors and, level by level, a flat array of neighbours with a
fixed number of places per node. Nodes are linked to what a search of the graph built so far finds near
them. A query goes through the graph of each shard from the top level down; the shards' results are
merged by exact distance. Searches run for many nodes or queries at once, step by step as arrays, and
queries travel in blocks, one row for a block and a shard.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Vectors of a shard on average, and its components at most; queries of a block.
SHARD, SHARD_VALUES, QUERY_BLOCK = 16_384, 4_000_000, 256
#: Neighbours chosen per node, candidates when building and when searching.
M, EF_BUILD, EF_SEARCH = 16, 64, 160
#: Nodes inserted, or thinned, at a time; candidates of one search that are expanded in a step.
BATCH, WIDTH = 256, 4


def _level(vec_id: int, seed: int) -> int:
    """Level of a node, geometric with the usual 1 / ln M; a hash of the id, so that rebuilding agrees."""
    u = (xxhash.xxh3_64_intdigest(struct.pack("<q", vec_id), seed=seed) + 1) / 2.0**64
    return int(-np.log(u) / np.log(M))


def _diverse(x: np.ndarray, near: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row of candidates: nearest first, each nearer to the row's node than to any chosen one; then the nearest others.

    ``near`` holds positions (-1: none) by ascending squared distance ``d``.
    """
    said = near >= 0
    own = x[near]
    sq = np.einsum("bcd,bcd->bc", own, own)
    between = sq[:, :, None] + sq[:, None] - 2 * own @ own.transpose(0, 2, 1)
    chosen = np.zeros(near.shape, bool)
    count = np.zeros(len(near), int)
    for c in range(near.shape[1]):
        chosen[:, c] = said[:, c] & (count < most) & ~((between[:, c] <= d[:, c, None]) & chosen).any(1)
        count += chosen[:, c]
    others = said & ~chosen
    chosen |= others & (np.cumsum(others, 1) <= (most - count)[:, None])
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(near, order, 1), -1)


class Level:
    """One level of a graph: ``links[place[node]]`` are the neighbours of a node (-1: none)."""

    def __init__(self, n: int, members: np.ndarray, links: np.ndarray):
        self.members, self.links = members, links
        self.place = np.full(n, -1, np.int32)
        self.place[members] = np.arange(len(members), dtype=np.int32)


def beam(x: np.ndarray, level: Level, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (-1: none) and squared distances of the ``ef`` nearest nodes that each query finds from its entry, nearest first."""
    rows = len(q)
    ids, dist = np.full((rows, ef), -1), np.full((rows, ef), np.inf)
    ids[:, 0], dist[:, 0] = entry, ((x[entry] - q) ** 2).sum(1)
    todo = ids >= 0
    seen = np.zeros((rows, len(x)), bool)
    seen[np.arange(rows), entry] = True
    while todo.any():
        row, col = np.nonzero(todo & (np.cumsum(todo, 1) <= WIDTH))
        todo[row, col] = False
        near = level.links[level.place[ids[row, col]]]
        row, near = np.repeat(row, near.shape[1]), near.reshape(-1)
        new = near >= 0
        row, near = row[new], near[new]
        new = ~seen[row, near]
        key = np.unique(row[new].astype(np.int64) * len(x) + near[new])
        row, near = key // len(x), key % len(x)
        seen[row, near] = True
        d = ((x[near] - q[row]) ** 2).sum(1)
        better = d < dist[row, -1]
        row, near, d = row[better], near[better], d[better]
        if not len(row):
            continue
        at, start, count = np.unique(row, return_index=True, return_counts=True)
        slot = np.arange(len(row)) - np.repeat(start, count)
        line = np.repeat(np.arange(len(at)), count)
        more_ids, more_dist = np.full((len(at), count.max()), -1), np.full((len(at), count.max()), np.inf)
        more_ids[line, slot], more_dist[line, slot] = near, d
        every = np.concatenate([dist[at], more_dist], 1)
        order = np.argsort(every, axis=1, kind="stable")[:, :ef]
        dist[at] = np.take_along_axis(every, order, 1)
        ids[at] = np.take_along_axis(np.concatenate([ids[at], more_ids], 1), order, 1)
        todo[at] = np.take_along_axis(np.concatenate([todo[at], more_ids >= 0], 1), order, 1)
    return ids, dist


def descend(x: np.ndarray, upper: list[Level], q: np.ndarray) -> np.ndarray:
    """The node nearest to each query that greedy steps find on ``upper`` levels, the top one first."""
    entry = np.full(len(q), upper[0].members[0])
    for level in upper:
        entry = beam(x, level, q, entry, 1)[0][:, 0]
    return entry


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of their ids: first row of each distinct vector, rows node by node, and where each node's start."""
    _, first, node = np.unique(x, axis=0, return_index=True, return_inverse=True)
    turn = np.argsort(first)
    place = np.empty_like(turn)
    place[turn] = np.arange(len(turn))
    node = place[node.reshape(-1)]
    return first[turn], np.argsort(node, kind="stable"), np.r_[0, np.cumsum(np.bincount(node))]


def build(ids: np.ndarray, x: np.ndarray, seed: int = 5) -> list[Level]:
    """Levels from the top down to the ground.

    A level's nodes come in order of their own top level, ties by a hash of the id, BATCH at a time. A node's
    candidates are what a search of the level finds from where the levels above lead, and the nodes before it
    in its batch. Links go both ways; a list that is full is thinned by the same rule as the choice.
    """
    own = np.array([_level(int(i), seed) for i in ids])
    turn = np.array([xxhash.xxh3_64_intdigest(struct.pack("<q", int(i)), seed=seed + 1) for i in ids], np.uint64)
    turn = np.lexsort((turn, -own))
    done: list[Level] = []
    for number in range(int(own.max()) if len(ids) else -1, -1, -1):
        members = turn[own[turn] >= number]
        most = 2 * M if number == 0 else M
        level = Level(len(x), members, np.full((len(members), most), -1, np.int32))
        filled = np.zeros(len(members), int)
        for start in range(0, len(members), BATCH):
            nodes = members[start : start + BATCH]
            q = x[nodes]
            near, d = np.zeros((len(nodes), 0), int), np.zeros((len(nodes), 0))
            if start:
                entry = descend(x, done, q) if done else np.full(len(nodes), members[0])
                place = level.place[entry]
                near, d = beam(x, level, q, np.where((place >= 0) & (place < start), entry, members[0]), EF_BUILD)
            mates = np.tril(np.ones((len(nodes), len(nodes)), bool), -1)
            apart = np.where(mates, ((q[:, None] - q[None]) ** 2).sum(2), np.inf)
            every = np.concatenate([d, apart], 1)
            order = np.argsort(every, axis=1, kind="stable")[:, :EF_BUILD]
            d = np.take_along_axis(every, order, 1)
            near = np.take_along_axis(np.concatenate([near, np.where(mates, nodes[None], -1)], 1), order, 1)
            chosen = _diverse(x, near, d, M)
            level.links[start : start + len(nodes), : chosen.shape[1]] = chosen
            filled[start : start + len(nodes)] = (chosen >= 0).sum(1)
            line, slot = np.nonzero(chosen >= 0)
            _link_back(x, level, filled, level.place[chosen[line, slot]], nodes[line])
        done.append(level)
    return done


def _link_back(x: np.ndarray, level: Level, filled: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
    """Give the lists at places ``to`` the nodes ``new``; lists that would overflow are thinned with what they hold."""
    most = level.links.shape[1]
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    while len(to):
        at, start, count = np.unique(to, return_index=True, return_counts=True)
        turn = np.arange(len(to)) - np.repeat(start, count)
        now = turn < most  # the others come next time
        line, slot = np.repeat(np.arange(len(at)), count)[now], turn[now]
        more = np.full((len(at), min(most, int(count.max()))), -1)
        more[line, slot] = new[now]
        taken = np.minimum(count, most)
        room = filled[at] + taken <= most
        fits = room[line]
        level.links[at[line[fits]], filled[at[line[fits]]] + slot[fits]] = new[now][fits]
        filled[at[room]] += taken[room]
        full = np.flatnonzero(~room)
        for k in range(0, len(full), BATCH):
            some = full[k : k + BATCH]
            near = np.concatenate([level.links[at[some]], more[some]], 1)
            d = np.where(near >= 0, ((x[near] - x[level.members[at[some]]][:, None]) ** 2).sum(2), np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            level.links[at[some]] = _diverse(x, np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1), most)
            filled[at[some]] = most
        to, new = to[~now], new[~now]


class Shard:
    """A shard's row as arrays."""

    def __init__(self, ids: bytes, starts: bytes, vectors: bytes, dim: int, members: list[bytes], neighbours: list[bytes]):
        self.ids, self.starts = np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(-1, dim)
        self.levels = []
        for m, f in zip(members, neighbours):
            nodes = np.frombuffer(m, "<i4")
            self.levels.append(Level(len(self.vectors), nodes, np.frombuffer(f, "<i4").reshape(len(nodes), -1)))

    def least_ids(self, node: int, most: int) -> list[int]:
        """The smallest ids of a node's vector."""
        return self.ids[self.starts[node] : min(self.starts[node] + most, self.starts[node + 1])].tolist()

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Positions (-1: none) of the nearest nodes that each query finds."""
        *upper, ground = self.levels
        entry = descend(self.vectors, upper, q) if upper else np.full(len(q), ground.members[0])
        return beam(self.vectors, ground, q, entry, ef)[0]


INDEX = "dim int, shard int, ids binary, starts binary, vectors binary, members array<binary>, neighbours array<binary>"


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows that can be searched: id and vector not null, all components finite, not all zero."""
    v = F.col("v")
    rows = table.select(table[vec_id].cast("long").alias("vec_id"), table[vector].cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists(v, lambda x: x != 0))


def index(vectors: DataFrame, shard: int = SHARD, seed: int = 5) -> DataFrame:
    """One row for each shard, with its graph. Rows of one id are one vector (the smallest). Every vector is in a shard.

    A shard has about ``shard`` vectors, fewer where these are so long that it would hold more than SHARD_VALUES components.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    about = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    size = max(1, min(shard, SHARD_VALUES // max(1, about["dim"] or 1)))
    shards = max(1, -(-about["n"] // size))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["v"].to_numpy()).astype(np.float64)
        order = np.lexsort([*x.T[::-1], group["vec_id"].to_numpy()])
        ids = group["vec_id"].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ids, x = ids[first], x[order][first] + 0.0  # no negative zeros
        nodes, rows, starts = _distinct(x)
        levels = build(ids[nodes], x[nodes], seed)
        return pd.DataFrame(
            {
                "dim": [x.shape[1]],
                "shard": [group["shard"].iloc[0]],
                "ids": [ids[rows].astype("<i8").tobytes()],
                "starts": [starts.astype("<i8").tobytes()],
                "vectors": [x[nodes].astype("<f8").tobytes()],
                "members": [[level.members.astype("<i4").tobytes() for level in levels]],
                "neighbours": [[level.links.astype("<i4").tobytes() for level in levels]],
            }
        )

    dealt = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    return dealt.groupBy("dim", "shard").applyInPandas(run, INDEX)


def search(queries: DataFrame, indexed: DataFrame, k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score of the ``k`` nearest found for each query (vec_id, v).

    score is the Euclidean distance in double precision; ties go to the smaller vec_id; a query's
    own id is no candidate; with fewer candidates all are returned. Vectors of another length are none.
    """
    blocks = queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    count = max(1, queries.count())
    n_blocks = -(-count // QUERY_BLOCK)
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")).groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("qs"))
    shards = indexed.groupBy("dim").agg(F.collect_list("shard").alias("all")).withColumnRenamed("dim", "d")  # shard numbers only
    dealt = blocks.join(shards, F.col("dim") == F.col("d")).select("dim", F.explode("all").alias("shard"), "qs")
    met = dealt.join(indexed, ["dim", "shard"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                graph = Shard(row["ids"], row["starts"], row["vectors"], row["dim"], row["members"], row["neighbours"])
                asked = np.array([q["v"] for q in row["qs"]], float)
                found = graph.search(asked, max(ef, k + 1))
                out = []
                for q, x, at in zip(row["qs"], asked, found):
                    at = at[at >= 0]
                    exact = np.sqrt(((graph.vectors[at] - x) ** 2).sum(1))
                    best = sorted((d, i) for d, p in zip(exact.tolist(), at.tolist()) for i in graph.least_ids(p, k + 1) if i != q["vec_id"])[:k]
                    out += [(q["vec_id"], i, d) for d, i in best]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = met.select("dim", "qs", "ids", "starts", "vectors", "members", "neighbours").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each row whose id ``every`` divides, among all other rows. Unusable vectors take no part; an empty table gives no rows."""
    rows = usable(table, vec_id, vector)
    return search(rows.filter(F.col("vec_id") % every == 0), written(index(rows), "hnsw"), k)
