"""Lines of body text that look like headings."""

import os

from pyspark.sql import functions as F

from docmill.operators import structure
from docmill.plans.catalogue import QUERIES, SQL
from tests.compare import TABLES, compare


def test_body_is_no_heading(spark):
    rows = [("d", 0, 1, 3, "1.2 Topic of it", False), ("d", 1, 1, 4, "28.68.191.238 Den other", True), ("d", 2, 1, 1, "3 Three words here", None), ("d", 3, 1, 5, "Figure 3: shown", True)]
    b = spark.createDataFrame(rows, "doc string, n long, page long, place long, text string, body boolean")
    kinds = lambda d: [r.kind for r in structure.headings(d).orderBy("n").collect()]
    assert kinds(b) == ["section", "text", "chapter", "text"]
    assert kinds(b.drop("body")) == ["section", "subsection", "chapter", "skipped"]


def test_lines_like_headings_equal_sql(spark, sf, tmp_path):
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    text = "\n".join(["a", "28.68.191.238 Den other", "b", "Figure 3: x", "1.2 Topic", "c", "Note: y", "d", "e", "2.1.3 Deep one", "Chapter 9: Nine", "f", "g", "1 One more"])
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(2).withColumn("text", F.lit(text))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("section_state", "chapter_ranges"):
        assert compare(spark, str(tmp_path), name, QUERIES[name], SQL[name]) is None
