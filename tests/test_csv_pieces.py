"""Quoted CSV files in pieces against one pass, and the header finders."""

import csv
import io
import random

import pytest

from docmill.sources import csv_pieces, files


@pytest.fixture()
def pieces(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows_of(df):
    return sorted((r.file.rsplit("/", 1)[1], r.row, r.cells) for r in df.collect())


def test_pieces_equal_one_pass(spark, tmp_path, pieces):
    rng = random.Random(4)
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n"), ("c.csv", "\n")):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=end)
        for _ in range(150):
            w.writerow(["".join(rng.choice('ab ,"\n1é') for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4))])
        if name == "c.csv":  # one cell over many pieces, then more rows
            w.writerow(["x", 'line "one"\n' * 400, "y"])
            w.writerow(["after", "it"])
        (tmp_path / name).write_bytes(("﻿" if name == "b.csv" else "").encode() + out.getvalue().encode())
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n \n")
    got = csv_pieces.csv_rows(spark, f"file://{tmp_path}")
    assert csv_pieces._lines(spark, f"file://{tmp_path}", "*.csv").select("file", "piece").distinct().count() > 20
    assert rows_of(got) == rows_of(files.csv_matrix(spark, f"file://{tmp_path}"))


def test_header_finders(spark):
    rows = spark.createDataFrame(
        [
            ("a", 0, ["title", ""]), ("a", 1, ["Country Name", "Country Code", "1960"]), ("a", 2, ["Aruba", "ABW", "1"]), ("a", 3, ["Chad"]), ("a", 4, ["Peru", "PER", "2", "3"]),
            ("b", 0, ["x"]), ("b", 1, ["Key", "Key", "v"]), ("b", 2, ["1", "2", "3"]),
        ],
        "file string, row long, cells array<string>",
    )
    found = lambda df: {r.file: r.row for r in df.collect()}
    assert found(csv_pieces.header_holding(rows, ["country code", "country name"])) == {"a": 1, "b": 0}
    assert found(csv_pieces.header_holding(rows, ["country code"], within=1, otherwise=None)) == {}
    assert found(csv_pieces.header_skipping(rows, 4)) == {"a": 4}
    assert found(csv_pieces.header_first_cell(rows, "Key")) == {"b": 1}
    assert found(csv_pieces.header_seeking(rows, ["Country Name", "Country Code"])) == {"a": 1}
    assert found(csv_pieces.header_seeking(rows, ["Key"], within=2)) == {"a": 2, "b": 1}
    values = csv_pieces.records_under(rows, csv_pieces.header_holding(rows, ["country name"], otherwise=1))
    assert {(r.file, r.row): r.asDict()["values"] for r in values.collect()} == {
        ("a", 2): {"Country Name": "Aruba", "Country Code": "ABW", "1960": "1"}, ("a", 3): {"Country Name": "Chad", "Country Code": "", "1960": ""},
        ("a", 4): {"Country Name": "Peru", "Country Code": "PER", "1960": "2"}, ("b", 2): {"Key": "2", "v": "3"},
    }


def test_pieces_of_few_lines(spark, tmp_path, monkeypatch):
    """Pieces end after a bounded number of lines, wherever Spark cuts; a mark within a file is no byte-order mark."""
    monkeypatch.setattr(csv_pieces, "PIECE_BITS", 2)
    rng = random.Random(7)
    for name in ("a.csv", "b.csv"):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator="\n")
        for k in range(90):
            w.writerow([("﻿" if k % 4 == 0 else "") + "".join(rng.choice('ab ,"\n1é') for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))])
        w.writerow(["x", 'line "one"\n' * 40, "y"])
        (tmp_path / name).write_bytes(out.getvalue().encode())
    lines = csv_pieces._lines(spark, f"file://{tmp_path}", "*.csv")
    assert max(r["count"] for r in lines.groupBy("file", "piece").count().collect()) <= 4
    assert rows_of(csv_pieces.csv_rows(spark, f"file://{tmp_path}")) == rows_of(files.csv_matrix(spark, f"file://{tmp_path}"))


def test_orders_are_written_by_ranges(spark, sf, monkeypatch):
    from docmill.plans import catalogue_stored

    seen = []
    real = csv_pieces.csv_rows

    def spied(session, folder):
        seen.append(session.read.text(folder).select("_metadata.file_path").distinct().count())
        return real(session, folder)

    monkeypatch.setattr(csv_pieces, "csv_rows", spied)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = sorted(catalogue_stored.csv_in_pieces(spark, sf).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert seen[0] > 1
    assert [r.row for r in rows] == list(range(1, len(rows) + 1)) and [r.o_orderkey for r in rows] == sorted(r.o_orderkey for r in rows)
