"""A stored flat vector index: blocks of unit vectors with their distances to a few pivots, ranked exactly.

    <path>/pivots  dim, pivot, v
    <path>/blocks  block, dim, n, low, high, zeros | ids, vectors

A block holds neighbouring vectors: those nearest to one pivot, by their distance to it. ``low`` and ``high`` are the ranges
of its vectors' distances to each pivot. By the triangle inequality no vector of a block is nearer to a query than the
query's own distance to a pivot lies outside of that range; so a search reads the ranges of all blocks (a few
numbers each), scores the most promising blocks, and then only those that may still hold one of the k best. The
ids and vectors of the others are not read. Vectors are added as further blocks, after the pivots that the first ones chose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import ship, written
from .retrieve import DIGITS, top_k

#: Pivots of each length of vectors, vectors of a block, and queries that meet a block together.
PIVOTS, BLOCK, ASKED = 16, 256, 512
#: Blocks of a query that are scored first.
FIRST = 4
_BLOCKS = "block long, dim int, n long, low array<double>, high array<double>, zeros boolean, ids array<long>, vectors array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _rows(column: pa.Array, n: int) -> np.ndarray:
    """The numbers of ``n`` vectors of one length, whether they are lists or lie behind one another; no object is made of any."""
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return _numbers(flat).astype(float).reshape(n, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _cell(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    """What the list in a row holds."""
    return batch.column(name).slice(row, 1).flatten()


def _by_dim(batch: pa.RecordBatch, at: int):
    """(dim, places) of the rows of each length of vectors."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        yield dim, pa.array(np.flatnonzero(sizes == dim))


class VectorIndex:
    """``create`` or ``open`` one, ``add`` vectors to it, ``search`` it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, vectors: DataFrame, path: str, pivots: int = PIVOTS, block: int = BLOCK) -> VectorIndex:
        """Store ``vectors`` (doc_id, v); null and empty ones, and rows without an id, are left out. Pivots are picked by hash from all vectors of a length."""
        out = cls(vectors.sparkSession, path)
        order = Window.partitionBy("dim").orderBy(F.xxhash64("doc_id"), "doc_id")
        # the number comes in the window's order of hashes, so a few rows of each task meet
        some = out._given(vectors).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= pivots)
        some.select("dim", (F.col("n") - 1).alias("pivot"), "v").write.mode("overwrite").parquet(f"{out.path}/pivots")
        out.add(vectors, block)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path)

    @staticmethod
    def _given(vectors: DataFrame) -> DataFrame:
        rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("v").cast("array<double>").alias("v"))
        return rows.filter("doc_id is not null and size(v) > 0").withColumn("dim", F.size("v"))

    def _pivots(self) -> dict[int, np.ndarray]:
        """A few vectors of each length."""
        found: dict[int, list] = {}
        for r in self.spark.read.parquet(f"{self.path}/pivots").orderBy("dim", "pivot").collect():
            found.setdefault(r["dim"], []).append(r["v"])
        return {d: unit(np.array(v, float)) for d, v in found.items()}

    def add(self, vectors: DataFrame, block: int = BLOCK) -> None:
        """Store more vectors. Ids must be new; a vector of a length without pivots has ranges that rule nothing out."""
        ship(self.spark)
        pivots = self._pivots()
        number = self._writes()

        def near(batches):
            for batch in batches:
                for dim, at in _by_dim(batch, 1):
                    own = batch.take(at)
                    x = unit(_rows(own.column(1), own.num_rows))
                    d = distances(x, pivots[dim]) if dim in pivots else np.zeros((len(x), 1))
                    zero = ~x.any(1)
                    first = np.where(zero, -1, d.argmin(1))
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0), own.column(1), pa.array(np.full(len(x), dim, np.int32)), pa.array(first.astype(np.int32)), pa.array(d.min(1))], names=["doc_id", "v", "dim", "pivot", "d"]
                    )

        def pack(batches):
            place, made, held, kind = (number << 40) + (TaskContext.get().partitionId() << 20), 0, [], None

            def out():
                dim, pivot = kind
                x = unit(np.array([v for _, v in held], float))
                d = distances(x, pivots[dim]) if dim in pivots else np.zeros((len(x), 0))
                head = [pa.array([c], t) for c, t in ((place + made, pa.int64()), (dim, pa.int32()), (len(held), pa.int64()))]
                columns = *head, _lists(d.min(0)[None]), _lists(d.max(0)[None]), pa.array([pivot < 0]), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), _lists(x.reshape(1, -1))
                return pa.RecordBatch.from_arrays(list(columns), names=[f.split()[0] for f in _BLOCKS.split(", ")])

            for batch in batches:
                ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                vectors = np.split(_numbers(batch.column(1).flatten()), ends[:-1]) if batch.num_rows else []
                for i, v, dim, pivot in zip(batch.column(0).to_pylist(), vectors, *(batch.column(k).to_pylist() for k in (2, 3))):
                    if held and ((dim, pivot) != kind or len(held) >= block):
                        yield out()
                        made, held = made + 1, []
                    kind = dim, pivot
                    held.append((i, v))
            if held:
                yield out()

        placed = self._given(vectors).select("doc_id", "v").mapInArrow(near, "doc_id long, v array<double>, dim int, pivot int, d double")
        placed = placed.repartitionByRange("dim", "pivot", "d", "doc_id").sortWithinPartitions("dim", "pivot", "d", "doc_id")
        placed.mapInArrow(pack, _BLOCKS).write.mode("append").parquet(f"{self.path}/blocks")

    def _writes(self) -> int:
        """A number that no block has in its upper bits."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/blocks")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return 0
        last = self.blocks().agg(F.max(F.shiftright("block", 40))).first()[0]
        return 0 if last is None else last + 1

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")

    def ids(self) -> DataFrame:
        """doc_id, block of all vectors."""
        return self.blocks().select(F.explode("ids").alias("doc_id"), "block")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """part, dim, query_id, qv, ds: queries with their distances to the pivots, in parts of a bounded number."""
        pivots = self._pivots()

        def run(batches):
            for batch in batches:
                for dim, at in _by_dim(batch, 1):
                    own = batch.take(at)
                    x = unit(_rows(own.column(1), own.num_rows))
                    d = distances(x, pivots[dim]) if dim in pivots else np.zeros((len(x), 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), dim, np.int32)), own.column(0), _lists(x), _lists(d)], names=["dim", "query_id", "qv", "ds"]
                    )

        q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qv").cast("array<double>").alias("qv")).filter("size(qv) > 0")
        parts = max(1, -(-q.count() // ASKED))
        rows = q.mapInArrow(run, "dim int, query_id long, qv array<double>, ds array<double>")
        return rows.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    def bounds(self, asked: DataFrame) -> DataFrame:
        """query_id, block, bound: no cosine of the query with a vector of the block is larger."""
        lists = asked.groupBy("dim", "part").agg(F.collect_list(F.struct("query_id", "ds")).alias("qs"))

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    asking, d = _cell(batch, "qs", r).flatten()
                    d = _rows(d, len(asking))
                    low, high = (_numbers(_cell(batch, name, r)) for name in ("low", "high"))
                    gap = np.maximum(np.maximum(low - d, d - high), 0).max(1, initial=0.0)
                    # a zero vector's cosine is 0; so is that of a zero query
                    bound = np.zeros(len(d)) if batch.column("zeros")[r].as_py() else np.maximum(1 - np.maximum(gap - 1e-9, 0) ** 2 / 2, 0)
                    yield pa.RecordBatch.from_arrays([asking, pa.array(np.full(len(d), batch.column("block")[r].as_py(), np.int64)), pa.array(bound)], names=["query_id", "block", "bound"])

        heads = self.blocks().select("block", "dim", "low", "high", "zeros")
        return heads.join(lists, "dim").select("block", "low", "high", "zeros", "qs").mapInArrow(run, "query_id long, block long, bound double")

    def _scored(self, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        wanted = pairs.join(asked.select("query_id", "part", "qv"), "query_id").groupBy("block", "part").agg(F.collect_list(F.struct("query_id", "qv")).alias("qs"))

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    asking, q = _cell(batch, "qs", r).flatten()
                    q, ids = _rows(q, len(asking)), _numbers(_cell(batch, "ids", r))
                    score = np.round(q @ _rows(_cell(batch, "vectors", r), len(ids)).T, DIGITS)
                    best = [np.lexsort((ids, -s))[:k] for s in score]
                    yield pa.RecordBatch.from_arrays(
                        [asking.take(pa.array(np.repeat(np.arange(len(asking)), [len(b) for b in best]))), pa.array(ids[np.concatenate(best)]), pa.array(np.concatenate([s[b] for s, b in zip(score, best)]))],
                        names=["query_id", "doc_id", "score"],
                    )

        met = wanted.join(self.blocks().select("block", "ids", "vectors"), "block").select("ids", "vectors", "qs")
        return top_k(met.mapInArrow(run, "query_id long, doc_id long, score double"), k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank: the ``k`` vectors of highest cosine for each query (query_id, qv), as a scan of all gives them.

        Equal (rounded) scores go to the smaller id; vectors of another length are no candidates, a zero vector's cosine is 0.
        """
        return self.ranked(queries, k)[0]

    def ranked(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What ``search`` gives, and query_id, blocks, read: how many blocks there are and how many were scored. Jobs run at plan time."""
        ship(self.spark)
        asked = written(self._asked(queries), "asked-vectors")
        bounds = written(self.bounds(asked), "vector-bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = written(bounds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIRST).select("query_id", "block"), "first-vectors")
        best = written(self._scored(asked, first, k), "best-vectors")
        reached = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        # what rounds to the score that was reached may still have a smaller id
        rest = bounds.join(reached, "query_id", "left").filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - 10.0**-DIGITS))
        rest = written(rest.join(first, ["query_id", "block"], "left_anti").select("query_id", "block"), "other-vectors")
        both = best.select("query_id", "doc_id", "score").unionByName(self._scored(asked, rest, k).select("query_id", "doc_id", "score"))
        read = first.unionByName(rest).groupBy("query_id").agg(F.count("*").alias("read"))
        return top_k(both, k), bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id")
