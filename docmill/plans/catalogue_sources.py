"""Registered queries over sources and stores: tables are written as files into the shared folder and read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..workers import new_path
from .registry import query, read


@query("""SELECT 0 AS row, 'n_nationkey|n_name|said' AS cells UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), n_nationkey || '|' || n_name || '|' || CASE WHEN n_nationkey % 3 = 0 THEN 'a, "b"' || chr(10) || 'c' WHEN n_nationkey % 3 = 1 THEN '' ELSE 'x' END FROM nation""")
def csv_cells(spark, sf_dir):
    """Cells of a CSV file with quotes, commas and line ends in them."""
    n = read(spark, sf_dir, "nation")
    said = F.when(F.col("n_nationkey") % 3 == 0, 'a, "b"\nc').when(F.col("n_nationkey") % 3 == 1, " ").otherwise("x ")
    path = new_path(spark, "csv")
    n.select(
        "n_nationkey", "n_name", said.alias("said"),
    ).coalesce(1).sortWithinPartitions("n_nationkey").write.option("header", "true").option("escape", '"').option("quoteAll", "true").option("ignoreTrailingWhiteSpace", "false").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return files.csv_matrix(spark, path).select(F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells"))


@query("SELECT 'txt' AS suffix, CAST(r_regionkey AS BIGINT) AS region, 0 AS n, 'Region ' || r_name || ' is here' AS text FROM region UNION ALL SELECT 'txt', r_regionkey, 1, 'and its second part' FROM region")
def text_paragraphs(spark, sf_dir):
    """Paragraphs of plain text files, found by a scan of the folder; short ones are left out."""
    r = read(spark, sf_dir, "region").withColumn("value", F.concat(F.lit("Region  "), "r_name", F.lit("\n is here\n\nand its second part\n \nshort")))
    path = new_path(spark, "text")
    r.select("value", F.col("r_regionkey").alias("k")).write.partitionBy("k").text(path)
    parts = files.text_files(spark, path)
    key = F.regexp_extract("path", "k=([0-9]+)", 1).cast("long")
    found = files.scan(spark, path).select("suffix", F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("region"))
    return parts.select(key.alias("region"), F.col("n").cast("long").alias("n"), "text").join(found, "region").select("suffix", "region", "n", "text")


@query("SELECT 'label ' || label AS namespace, count(*) AS vectors FROM embeddings WHERE label % 4 <> 2 GROUP BY 1")
def namespace_counts(spark, sf_dir):
    """A vector store by namespace after some have been written twice and some cleared."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("label "), F.col("label")).alias("namespace"), "label")
    path = new_path(spark, "vectors")
    for _ in range(2):  # writing a namespace again replaces it
        e.drop("label").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)
    for r in e.filter("label % 4 = 2").select("namespace").distinct().collect():  # a row a label
        files.namespace_clear(spark, path, r["namespace"])
    return files.namespace_stats(spark, path)


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, text FROM conversations WHERE conv_id <> 3")
def stored_turns(spark, sf_dir):
    """The session store without a forgotten session."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "text")
    path, less = new_path(spark, "turns"), new_path(spark, "turns")
    files.append_turns(c.filter("turn % 2 = 0"), path)
    files.append_turns(c.filter("turn % 2 = 1"), path)
    files.forget_session(spark, path, less, "3")
    return spark.read.parquet(less)


@query("SELECT doc_id, lang FROM documents WHERE trim(text) <> ''")
def json_cache(spark, sf_dir):
    """Documents of a JSON cache; empty texts are left out."""
    d = read(spark, sf_dir, "documents")
    entry = F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    path = new_path(spark, "json")
    d.select(F.to_json(F.array(entry)).alias("value")).write.text(path)
    docs = files.json_documents(spark, path, lines=True)
    return docs.select(F.col("id").cast("long").alias("doc_id"), F.col("metadata")["lang"].alias("lang"))
