"""What a worker hands on at once doesn't grow with the batches it is given."""

import pyarrow as pa

from pyspark.sql import functions as F

from docmill.operators import chunking, stored_index
from docmill.plans.catalogue import QUERIES


def test_counts_leave_in_parts():
    n = 3 * stored_index.AT_ONCE + 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if k % 9 == 0 else f"a b{k} a" for k in range(n)])], names=["id", "text"])
    for weighing in (stored_index.BM25, stored_index.SPARSE):
        parts = list(stored_index._counts(weighing)(iter([batch, batch.slice(0, 0)])))
        assert max(len(set(p.column(0).to_pylist())) for p in parts) <= stored_index.AT_ONCE
        rows = [r for p in parts for r in zip(*(c.to_pylist() for c in p.columns))]
        assert sum(1 for r in rows if r[1] is None) == n and len(rows) == n + 2 * sum(k % 9 > 0 for k in range(n))
        assert {r[0]: r[3] for r in rows} == {k: 0 if k % 9 == 0 else 3 for k in range(n)}


def test_recursive_parts(spark, sf):
    d = spark.createDataFrame([(k, None if k % 7 == 0 else "" if k % 5 == 0 else f"one. two{k}\n\nthree " * (k % 40)) for k in range(2 * chunking.AT_ONCE + 3)], "doc_id long, text string").coalesce(1)
    want = d.select("doc_id", F.posexplode(chunking.recursive_split(50)("text")).alias("part", "text"))
    got = chunking.recursive_parts(d, "doc_id", size=50)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    t = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(chunking.recursive_split()("text")).alias("part", "text"))
    assert sorted(map(tuple, QUERIES["recursive_split"](spark, sf).collect())) == sorted(map(tuple, t.collect()))
