"""Registered queries over stores that are kept up: the inverted index, the maintained table; and the joins that need no scan of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchored, decisions, greedy, intervals, maintained, stored_index, stored_vectors
from ..sources import csv_pieces
from ..workers import new_path
from .catalogue_retrieval import BM25_SQL, COS_SQL, SPARSE_SQL, TOK, _vectors, questions
from .registry import query, read

LEFT = "documents AS (SELECT * FROM main.documents WHERE doc_id % 7 <> 0)"


def _kept_up(spark, sf_dir, weighing):
    """An index of all documents, made of two parts, from which every seventh document was removed again."""
    d = read(spark, sf_dir, "documents")
    index = stored_index.StoredIndex.create(d.filter("doc_id % 3 <> 0"), new_path(spark, "index"), weighing)
    index.add(d.filter("doc_id % 3 = 0"))
    index.remove(d.filter("doc_id % 7 = 0").select("doc_id"))
    return stored_index.StoredIndex.open(spark, index.path, weighing)


@query(f"WITH {LEFT}, {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm_ranked WHERE rank <= 20")
def stored_bm25_topk(spark, sf_dir):
    found = _kept_up(spark, sf_dir, stored_index.BM25).search(questions(spark, sf_dir), 20)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {LEFT}, {SPARSE_SQL} SELECT query_id, doc_id, score, rank FROM sp_ranked WHERE rank <= 20")
def stored_sparse_topk(spark, sf_dir):
    found = _kept_up(spark, sf_dir, stored_index.SPARSE).search(questions(spark, sf_dir), 20)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {LEFT} SELECT w AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK}) AS w FROM documents) GROUP BY w")
def stored_frequencies(spark, sf_dir):
    """Document frequencies as the segments' counts sum up to them."""
    return _kept_up(spark, sf_dir, stored_index.BM25).frequencies()


@query(f"WITH {COS_SQL} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 10")
def stored_cosine_topk(spark, sf_dir):
    """Nearest vectors from a stored index that was made of two parts."""
    q, v = _vectors(spark, sf_dir)
    index = stored_vectors.VectorIndex.create(v.filter("doc_id % 4 <> 0"), new_path(spark, "vectors"))
    index.add(v.filter("doc_id % 4 = 0"))
    found = stored_vectors.VectorIndex.open(spark, index.path).search(q, 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 <> 3),
b AS (SELECT * FROM a WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'N', o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 0),
c AS (SELECT * FROM b WHERE o_orderkey % 25 <> 0)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM c""")
def maintained_orders(spark, sf_dir):
    """Orders after an upsert, a delete, a patch, a batch that comes again, and compaction."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = maintained.MaintainedTable.create(o.filter("o_orderkey % 4 <> 3"), new_path(spark, "orders"), "o_orderkey")
    more = o.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    table.upsert(more, "more")
    table.delete(o.filter("o_orderkey % 25 = 0").select("o_orderkey"), "every 25th")
    table.compact("once")
    table.upsert(more, "more")  # it was there
    table.patch(o.filter("o_orderkey % 6 = 0").select("o_orderkey", F.lit("P").alias("o_orderstatus")), "status")
    return maintained.MaintainedTable.open(spark, table.path).read()


@query("""SELECT 0 AS snapshot, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 1, count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
UNION ALL SELECT 2, count(*), sum(c_custkey)::BIGINT FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_nationkey <> 5""")
def maintained_snapshots(spark, sf_dir):
    """A table as of each of its commits."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    table = maintained.MaintainedTable.create(c.filter("c_custkey % 2 = 0"), new_path(spark, "customers"), "c_custkey", buckets=8)
    table.upsert(c.filter("c_custkey % 3 = 0"), "thirds")
    table.delete_where(F.col("c_nationkey") == 5, "a nation")
    parts = [table.read(n).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit(n).alias("snapshot"), "n", "keys") for n in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def contained_passages(spark, sf_dir):
    """Which document holds which whole passage."""
    return anchored.contained(questions(spark, sf_dir), read(spark, sf_dir, "documents"))


@query("""WITH RECURSIVE n AS (SELECT source, doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) <> ''),
f AS (SELECT source, k, doc_id, true AS stays, [t] AS kept FROM n WHERE k = 1 UNION ALL
 SELECT source, k, doc_id, stays, CASE WHEN stays THEN list_append(kept, t) ELSE kept END AS kept FROM (SELECT n.source, n.k, n.doc_id, n.t, f.kept, len(list_filter(f.kept, lambda x: contains(x, n.t) OR contains(n.t, x))) = 0 AS stays FROM f JOIN n ON n.source = f.source AND n.k = f.k + 1))
SELECT source, doc_id FROM f WHERE stays""")
def containment_by_source(spark, sf_dir):
    """Among all documents of a source, in order, those that neither contain a kept one nor are part of one."""
    return greedy.containment_dedupe(read(spark, sf_dir, "documents"), "source", "doc_id", "text")


RANGES_SQL = """r AS (SELECT o_orderkey AS range_id, o_custkey % 50 AS k, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS a, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + o_orderkey % 60 - 5 AS b FROM orders),
p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS k, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS at FROM lineitem)"""


def _ranges(spark, sf_dir):
    """Ranges of days (some empty, most of them overlapping) and days, by a key that both have."""
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1990-01-01").cast("date")).cast("long")
    o, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    r = o.select(F.col("o_orderkey").alias("range_id"), (F.col("o_custkey") % 50).alias("k"), day("o_orderdate").alias("start"), (day("o_orderdate") + F.col("o_orderkey") % 60 - 5).alias("end"))
    return items.select(F.struct("l_orderkey", "l_linenumber").alias("row"), (F.col("l_suppkey") % 50).alias("k"), day("l_shipdate").alias("at")), r


@query(f"WITH {RANGES_SQL} SELECT l_orderkey, l_linenumber, min(range_id) AS range_id FROM p LEFT JOIN r ON p.k = r.k AND p.at BETWEEN a AND b GROUP BY ALL")
def first_overlapping_range(spark, sf_dir):
    """For each line the first of the orders whose days hold its own; null if none does."""
    points, ranges = _ranges(spark, sf_dir)
    found = intervals.first_range(points, ranges, ["k"], "row", ["range_id"], ["range_id"])
    return found.groupBy("row").agg(F.min("range_id").alias("range_id")).select("row.l_orderkey", "row.l_linenumber", "range_id")


@query(f"WITH {RANGES_SQL} SELECT range_id, count(*) AS n, min(l_orderkey) AS least FROM p JOIN r ON p.k = r.k AND p.at BETWEEN a AND b GROUP BY range_id")
def overlapping_range_counts(spark, sf_dir):
    """How many lines lie in each order's days."""
    points, ranges = _ranges(spark, sf_dir)
    met = intervals.counted(points.withColumn("order", F.col("row.l_orderkey")), ranges, ["k"], "order")
    return met.groupBy("range_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


@query()
def attempt_breaker(spark, sf_dir):
    """Events of a user as attempts, an hour's being one question's; errors are failures. Counts of answers by user."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_timestamp(F.date_trunc("hour", "ts")).alias("question"), (F.col("event_type") == "error").cast("int").alias("failed"))
    found = decisions.decided(e, "user_id", "ts", "event_id", decisions.Breaker(trip=1, cool=3600), ["question", "failed"])
    return found.groupBy("user_id", "answer").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))



@query("""SELECT row_number() OVER (ORDER BY o_orderkey) AS row, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'a, "b"' || chr(10) || 'c' WHEN o_orderkey % 11 = 0 THEN '""' WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS said FROM orders""")
def csv_in_pieces(spark, sf_dir):
    """All orders in CSV files in their order, with quotes, commas and line ends in cells, read in pieces: what stands below the headers, by their names."""
    o = read(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 5 == 0, 'a, "b"\nc\n').when(F.col("o_orderkey") % 11 == 0, '""').when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    path = new_path(spark, "csv")
    # ranges of orders are sorted and written by a task each; one file of all of them would be one task's
    out = o.select("o_orderkey", said.alias("said")).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    out.write.option("header", "true").option("escape", '"').option("quoteAll", "true").option("ignoreTrailingWhiteSpace", "false").option("ignoreLeadingWhiteSpace", "false").csv(path)
    rows = csv_pieces.csv_rows(spark, path)
    values = csv_pieces.in_order(csv_pieces.records_under(rows, csv_pieces.header_first_cell(rows, "o_orderkey")))
    return values.select("row", F.col("values")["o_orderkey"].cast("long").alias("o_orderkey"), F.col("values")["said"].alias("said"))
