"""Wide tables and structured lookups: headers, unpivot, summaries, constraint joins, extremes, markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_missing, normalised

# Header names that tell the kinds of files apart, and markers of aggregate rows.
HEADERS = {
    "world_bank_wide": ("country name", "country code", "indicator name", "indicator code"),
    "country_metadata": ("country code", "region", "incomegroup"), "indicator_metadata": ("indicator_code", "indicator_name"),
}
LEAST = {"world_bank_wide": 3, "country_metadata": 2, "indicator_metadata": 2}
AGGREGATES = (
    "income", "world", "africa", "europe", "asia", "middle east", "north america", "latin america", "caribbean", "union", "fragile", "small states",
    "dividend", "ida", "ibrd", "total", "countries", "economies", "aggregate",
)


def header_row(cells: DataFrame, file: str = "file", row: str = "row", values: str = "cells", scan: int = 25) -> DataFrame:
    """file, row, kind of each file's header: the row among the first ``scan`` with most of a kind's names, the first among equals."""
    low = F.transform(values, lambda x: F.lower(F.trim(x)))
    rows = cells.filter(F.col(row) < scan).withColumn("_low", low)
    rows = rows.filter(F.exists("_low", lambda x: x != "") & ~F.coalesce(F.get("_low", F.lit(0)), F.lit("")).isin("data source", "last updated date"))
    scores = [F.struct(F.size(F.array_intersect("_low", F.array(*map(F.lit, names)))).alias("score"), F.lit(LEAST[kind]).alias("least"), F.lit(kind).alias("kind")) for kind, names in HEADERS.items()]
    rows = rows.withColumn("_s", F.explode(F.array(*scores))).filter("_s.score >= _s.least")
    return rows.groupBy(file).agg(F.max_by(F.struct(F.col(row).alias("row"), F.col("_s.kind").alias("kind")), F.struct(F.col("_s.score"), -F.col(row))).alias("h")).select(file, "h.row", "h.kind")


def unique_headers(headers: DataFrame, by: list[str], pos: str = "pos", name: str = "name") -> DataFrame:
    """Blank headers become column_<pos + 1>, repeated ones get _2, _3, ..."""
    base = F.when(is_missing(F.col(name)), F.concat(F.lit("column_"), F.col(pos) + 1)).otherwise(F.trim(name))
    rows = headers.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy(*by, "_base").orderBy(pos))
    return rows.withColumn("header", F.when(n > 1, F.concat_ws("_", "_base", n)).otherwise(F.col("_base"))).drop("_base")


def padded(cells: Column, width: int) -> Column:
    """A ragged row cut or filled up with empty cells."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)


def parse_value(c: Column) -> Column:
    """Numbers with thousands commas; what is missing or isn't a number is null, never 0."""
    return F.when(~is_missing(c), F.replace(c, F.lit(","), F.lit("")).try_cast("double"))


def wide_to_long(wide: DataFrame, keys: list[str], years: list[str]) -> DataFrame:
    """keys, year, value: one row for each year column that isn't missing."""
    long = wide.unpivot(keys, years, "_year", "_raw")
    return long.select(*keys, F.regexp_extract("_year", "([0-9]{4})", 1).cast("int").alias("year"), parse_value(F.col("_raw").cast("string")).alias("value")).filter("value is not null")


def decades(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, decade, n, facts: the values of each decade with data, in order."""
    rows = long.withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    facts = F.array_sort(F.collect_list(F.struct("year", "value")))
    grouped = rows.groupBy(*keys, "decade").agg(F.count("*").alias("n"), facts.alias("_f"))
    said = F.array_join(F.transform("_f", lambda x: F.concat(x["year"].cast("string"), F.lit(" = "), x["value"].cast("decimal(20,2)").cast("string"))), "; ")
    return grouped.select(*keys, "decade", "n", said.alias("facts"))


def summaries(long: DataFrame, keys: list[str], total: int) -> DataFrame:
    """keys, available, first_year, last_year, missing of each series."""
    return long.groupBy(*keys).agg(
        F.count_distinct("year").alias("available"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        (F.lit(total) - F.count_distinct("year")).alias("missing"),
    )


def aggregate_entity(name: Column, code: Column) -> Column:
    return F.lower(F.concat_ws(" ", name, code)).rlike("|".join(AGGREGATES))


def lookup(constraints: DataFrame, facts: DataFrame) -> DataFrame:
    """First fact for each constraint (cid, code, name, metric, year), by code or by name: two equi joins instead of an OR."""
    f = facts.select("code", normalised(F.col("name")).alias("fname"), "metric", "year", "value", "ord")
    by_code = constraints.join(f, ["code", "metric", "year"]).select("cid", "value", "ord")
    c = constraints.withColumn("fname", normalised(F.col("name"))).drop("code", "name")
    by_name = c.join(f.drop("code"), ["fname", "metric", "year"]).select("cid", "value", "ord")
    return by_code.unionByName(by_name).groupBy("cid").agg(F.min_by("value", "ord").alias("value"))


def missing(constraints: DataFrame, found: DataFrame) -> DataFrame:
    return constraints.join(found.select("cid"), "cid", "left_anti")


def with_metadata(facts: DataFrame, metadata: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Left join of facts with a metadata table; what isn't there is the default."""
    out = facts.join(metadata, key, "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def extremes(rows: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Largest, smallest and sum of a value and who has them, over all rows."""
    return rows.groupBy(*by).agg(
        F.max_by(
            name, F.struct(F.col(value), -F.col(name)),
        ).alias("most"), F.max(value).alias("largest"), F.min_by(name, F.struct(value, name)).alias("least"), F.min(value).alias("smallest"), F.round(F.sum(value), 2).alias("total")
    )


def alias_matches(questions: DataFrame, aliases: DataFrame, longest: int = 4) -> DataFrame:
    """query_id, name, pos: aliases in a text as n-grams of its words, leftmost first, longest first; each name once.

    Both sides are normalised and lose a plural s, so that names in s match too.
    """
    singular = lambda c: F.regexp_replace(normalised(c), "([a-z]{2,})s\\b", "$1")
    words = F.split(singular(F.col("text")), " ")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda k: F.struct(k.alias("pos"), n.alias("n"), F.array_join(F.slice(words, k, n), " ").alias("gram")))))
    g = questions.select("query_id", F.explode(F.array_distinct(grams)).alias("g")).select("query_id", "g.pos", "g.n", "g.gram")
    met = g.join(aliases.select(singular(F.col("alias")).alias("gram"), "name"), "gram").filter("gram <> ''")
    return met.groupBy("query_id", "name").agg(F.min(F.struct(F.col("pos"), -F.col("n"))).alias("at")).select("query_id", "name", F.col("at.pos").alias("pos"))


def row_sentence(name: Column, code: Column, indicator: Column, year: Column, value: Column) -> Column:
    return F.concat(F.lit("In "), year.cast("string"), F.lit(", "), indicator, F.lit(" of "), name, F.lit(" ("), code, F.lit(") was "), value, F.lit("."))


def markdown_rows(c: Column) -> Column:
    """Rows of cells of the first markdown table in a text, header first, without the separator."""
    ls = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike("^[|:\\- ]+$"))
    return F.transform(ls, lambda x: F.transform(F.split(F.regexp_replace(x, "^\\||\\|$", ""), "\\|"), lambda y: F.trim(y)))


def csv_to_markdown(c: Column) -> Column:
    """A comma (or, if there are more, semicolon) table without quotes as markdown, rows as wide as the header."""
    ls = F.filter(F.split(c, "\r?\n"), lambda x: F.trim(x) != "")
    semi = F.size(F.split(ls[0], ";")) > F.size(F.split(ls[0], ","))
    cells = lambda x: F.transform(F.when(semi, F.split(x, ";")).otherwise(F.split(x, ",")), lambda y: F.replace(F.trim(y), F.lit("|"), F.lit("\\|")))
    width = F.size(cells(ls[0]))
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(cells(x), F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.array(row(ls[0]), rule), F.transform(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))), row)), "\n")


def table_summary(c: Column) -> Column:
    rows = markdown_rows(c)
    return F.struct(F.array_join(F.get(rows, F.lit(0)), ", ").alias("headers"), F.greatest(F.size(rows) - 1, F.lit(0)).alias("rows"))


def healed(row: Column, fields: dict[str, list[str]]) -> Column:
    """A struct of ``fields`` from a map, each from the first of its names that the map has."""
    return F.struct(*[F.coalesce(*[F.nullif(F.trim(row[n]), F.lit("")) for n in names]).alias(f) for f, names in fields.items()])
