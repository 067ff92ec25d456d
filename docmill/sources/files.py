"""Files in and out: folder scans, CSV matrices, plain text, JSON document caches, session stores, score tables."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapsed
from ..operators import chunking

SUFFIXES = ("pdf", "csv", "txt", "md", "markdown")
SHORTEST_CHUNK = 10


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, suffix, length, modified of all files with a known suffix, below any depth. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1))
    return files.select("path", suffix.alias("suffix"), "length", F.col("modificationTime").alias("modified")).filter(F.col("suffix").isin(*suffixes))


def csv_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """file, row, cells: every cell as a trimmed string, whatever the header; a byte-order mark goes, empty rows have no number.

    Line ends and commas inside quotes belong to a cell. A file is read once from its start to its end.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
                rows = [[c.strip() for c in line] for line in lines if any(c.strip() for c in line) or len(line) > 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))],
                    names=["file", "row", "cells"],
                )

    return raw.mapInArrow(run, "file string, row int, cells array<string>")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, n, text: paragraphs of plain text and markdown files, without very short ones."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md,markdown}").withColumn("path", F.input_file_name())
    parts = raw.select("path", F.posexplode(F.split("value", "\n[ \\t]*\n")).alias("n", "part")).withColumn("text", collapsed(F.col("part")))
    return parts.filter(F.length("text") >= SHORTEST_CHUNK).select("path", "n", "text")


def json_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of a JSON cache, a list or an object with ``documents``, as a file or (``lines``) as each line of one; empty texts are left out."""
    raw = spark.read.text(path, wholetext=not lines)
    listed = F.from_json("value", "array<struct<id: string, text: string, metadata: map<string, string>>>")
    held = F.from_json("value", "documents array<struct<id: string, text: string, metadata: map<string, string>>>")["documents"]
    docs = raw.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(held)).alias("d")).select("d.*")
    return docs.filter(F.trim("text") != "")


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents as Parquet, by type, so that a search of one type reads its files only."""
    writer = docs.write.mode(mode)
    (writer.partitionBy("document_type") if "document_type" in docs.columns else writer).parquet(path)


def missing_captions(images: DataFrame, cache: DataFrame, prompt_version: str) -> DataFrame:
    """Images (path, content) whose content has no caption of this prompt version yet."""
    keyed = images.withColumn("image_hash", F.md5("content"))
    known = cache.filter(F.col("prompt_version") == prompt_version).select("image_hash").distinct()
    return keyed.join(known, "image_hash", "left_anti").drop("content")


def asset_gaps(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """page, missing: chunks that mention a figure or table but have no registered path, by page."""
    said = chunks.filter(F.lower("text").rlike("\\b(?:figure|table|chart|diagram)\\b"))
    return said.join(registry.select("path").distinct(), "path", "left_anti").groupBy("page").agg(F.count("*").alias("missing"))


def namespace_write(vectors: DataFrame, path: str, namespace: str) -> None:
    """A vector store by namespace: a namespace is a folder, and writing one replaces what it held."""
    vectors.withColumn("namespace", F.lit(namespace)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)


def namespace_read(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """The vectors of one namespace; files of others aren't read."""
    return spark.read.parquet(path).filter(F.col("namespace") == namespace).drop("namespace")


def namespace_clear(spark: SparkSession, path: str, namespace: str) -> None:
    """Remove a namespace; the others, and the store, stay."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/namespace={namespace}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def namespace_stats(spark: SparkSession, path: str) -> DataFrame:
    """namespace, vectors of each namespace."""
    return spark.read.parquet(path).groupBy("namespace").agg(F.count("*").alias("vectors"))


def append_turns(turns: DataFrame, path: str) -> None:
    """Session store: turns are appended, nothing is rewritten."""
    turns.write.mode("append").parquet(path)


def turns_of(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The turns of one session, in order."""
    return spark.read.parquet(path).filter(F.col("session_id") == session_id).orderBy("turn")


def forget_session(spark: SparkSession, path: str, to: str, session_id: str) -> None:
    """The store without one session, written to ``to``: files are never changed in place."""
    spark.read.parquet(path).filter(~F.col("session_id").eqNullSafe(session_id)).write.mode("overwrite").parquet(to)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.select("metric", "score").write.mode("overwrite").option("header", "true").csv(path)


def markdown_paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunking.paragraphs(docs, key)
