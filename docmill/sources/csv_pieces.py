"""Large quoted CSV files, read in parallel by pieces, and the ways to find their header.

Where a piece of a file begins, nobody knows whether that is inside of a quoted cell. But quotes inside of quotes are doubled, so
an odd number of quotes before a line means that it is. Each piece counts its quotes; the counts of a file's pieces,
summed in their order (a row a piece), tell the state in which each begins, and with it which of its lines begin a record.
Lines of a record then come together under its number, also those in later pieces. What Spark reads of a file in one task is
cut into pieces of a bounded number of lines, so a task sorts no more than these.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import ship


#: Lines of a piece at most are 2 to this power.
PIECE_BITS = 16


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """file, piece (a number that grows with the place in the file), id (in order within a piece), line, quotes."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    # the lower 33 bits of an id are the line's number in its task; a block of a file is read by one
    part = F.shiftright(F.col("id").bitwiseAND((1 << 33) - 1), PIECE_BITS)
    rows = rows.select("file", (F.shiftleft("start", 33 - PIECE_BITS) + part).alias("piece"), "id", "line")
    return rows.withColumn("quotes", (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).cast("long"))


def _records(lines: DataFrame) -> DataFrame:
    """file, piece (from 0), n (from 1), text: whole records, by the piece of the file that they begin in and their number there."""
    lines = lines.withColumn("before", F.coalesce(F.sum("quotes").over(Window.partitionBy("file", "piece").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # of each piece: quotes, and lines that begin a record if it is entered outside and inside of a cell
    parts = lines.groupBy("file", "piece").agg(F.sum("quotes").alias("all"), F.count_if(F.col("before") % 2 == 0).alias("outside"), F.count_if(F.col("before") % 2 == 1).alias("inside"))
    order = Window.partitionBy("file").orderBy("piece")
    parts = parts.withColumn("k", (F.row_number().over(order) - 1).cast("long"))
    parts = parts.withColumn("state", F.coalesce(F.sum("all").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    own = F.when(F.col("state") == 0, F.col("outside")).otherwise(F.col("inside"))
    # lines before a piece's first record belong to the last record of the last piece that has one
    parts = parts.withColumn("last", F.last(F.when(own > 0, F.struct(F.col("k").alias("piece"), own.alias("n"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    met = lines.join(parts.select("file", "piece", "k", "state", "last"), ["file", "piece"])
    begins = (F.col("before") + F.col("state")) % 2 == 0
    met = met.withColumn("n", F.count_if(begins).over(Window.partitionBy("file", "piece").orderBy("id")))
    at = F.when(F.col("n") > 0, F.struct(F.col("k").alias("piece"), "n")).otherwise(F.col("last"))
    met = met.select("file", at["piece"].alias("home"), at["n"].alias("n"), F.struct("k", "id", "line").alias("l"))
    whole = met.groupBy("file", F.col("home").alias("piece"), "n").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return whole.select("file", "piece", "n", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def csv_rows(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """file, row, cells: every cell as a trimmed string, as ``files.csv_matrix`` gives them, from files of any size.

    A byte-order mark goes, empty rows have no number, line ends and commas inside quotes belong to a cell. A task holds a
    piece's lines sorted on disk and one record; a quote that never ends makes one record of the rest of its file.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list, list] = [], [], [], []
            for file, piece, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text.removeprefix("\ufeff") if piece == 0 and n == 1 else text
                lines = [[c.strip() for c in line] for line in csv.reader(io.StringIO(text, newline=""))]
                kept = [x for x in lines if any(x) or len(x) > 1]
                if kept:
                    for column, x in zip(out, (file, piece, n, kept)):
                        column.append(x)
            kinds = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["file", "piece", "n", "found"])

    records = _records(_lines(spark, folder, pattern)).mapInArrow(run, "file string, piece long, n long, found array<array<string>>")
    per = records.groupBy("file", "piece").agg(F.sum(F.size("found")).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.coalesce(F.sum(F.size("found")).over(Window.partitionBy("file", "piece").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = records.withColumn("here", here).join(per.select("file", "piece", before.alias("before")), ["file", "piece"])
    return met.select("file", F.posexplode("found").alias("k", "cells"), "here", "before").select("file", (F.col("before") + F.col("here") + F.col("k")).alias("row"), "cells")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (file, row, ...) of files whose names sort in their order, with ``row`` counted from 1 through all of them."""
    per = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("row").alias("least"))
    # a row a file
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = per.select("file", (before - F.col("least") + 1).alias("shift"))
    return rows.join(shifts, "file").withColumn("row", F.col("row") + F.col("shift")).drop("shift")


# Ways to find a header: each gives file and row of the header of every file that has one


def _low(cells: str):
    return F.transform(cells, lambda x: F.lower(F.trim(x)))


def header_holding(rows: DataFrame, names: list[str], within: int = 50, otherwise: int | None = 0) -> DataFrame:
    """The first row among the first ``within`` that holds all ``names``, whatever the case; else row ``otherwise`` (None: no header)."""
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    hit = (F.col("row") < within) & (F.size(F.array_except(wanted, _low("cells"))) == 0)
    found = rows.groupBy("file").agg(F.min(F.when(hit, F.col("row"))).alias("found"))
    return found.select("file", F.coalesce("found", F.lit(otherwise).cast("long")).alias("row")).filter("row is not null")


def header_skipping(rows: DataFrame, skip: int = 4) -> DataFrame:
    """The row behind the first ``skip`` ones; a file of fewer rows has none."""
    return rows.filter(F.col("row") == skip).select("file", "row")


def header_first_cell(rows: DataFrame, name: str) -> DataFrame:
    """The first row whose first cell says ``name``, as it is written there."""
    said = F.trim(F.trim(F.get("cells", F.lit(0))), F.lit('"'))
    return rows.filter(said == name).groupBy("file").agg(F.min("row").alias("row"))


def header_seeking(rows: DataFrame, names: list[str], within: int = 4) -> DataFrame:
    """The first row among the first ``within`` in which every name stands somewhere, else the row behind these."""
    line = F.array_join("cells", ",")
    hit = F.col("row") < within
    for n in names:
        hit = hit & F.contains(line, F.lit(n))
    found = rows.groupBy("file").agg(F.min(F.when(hit, F.col("row"))).alias("found"), F.max("row").alias("most"))
    return found.withColumn("row", F.coalesce("found", F.lit(within).cast("long"))).filter("row <= most").select("file", "row")


def records_under(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """file, row, values (map): what stands below each file's header, by its names; short rows are filled up with empty cells, long ones cut."""
    names = rows.join(headers.select("file", F.col("row").alias("head")), "file").filter("row = head").select("file", "head", F.col("cells").alias("names"))
    below = rows.join(names, "file").filter("row > head")
    width = F.size("names")
    filled = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), F.lit(1), width)
    # of names that come twice the last one counts
    pairs = F.arrays_zip(F.col("names").alias("name"), filled.alias("value"))
    last = F.filter(F.transform(pairs, lambda p, k: F.struct(p["name"].alias("key"), p["value"].alias("value"), k.alias("k"))), lambda p: p["k"] == F.size("names") - F.array_position(F.reverse("names"), p["key"]))
    return below.select("file", "row", F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))).alias("values"))
