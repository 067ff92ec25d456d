"""Event-time windows; the same functions serve tables and streams (with a watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late else events


def tumbling(events: DataFrame, ts: str, width: str, by: list[str] = [], value: str = "value", late: str | None = None) -> DataFrame:
    g = _marked(events, ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, by: list[str] = [], late: str | None = None) -> DataFrame:
    g = _marked(events, ts, late).groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    g = _marked(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
