"""Sessions and ordered rows: history windows, sticky values, rate limits, costs, page runs, nearest captions."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import jaccard

# Prices per million tokens (in, out), request cap and window of the limiter.
PRICES = {"large": (5.0, 15.0), "small": (0.15, 0.60)}
CAP, SECONDS = 5, 60


def last_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def transcript(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last ``n`` turns of each session as lines 'role: text' in order."""
    lists = last_n(rows, by, order, n).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("ts"))
    return lists.select(by, F.array_join(F.transform("ts", lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n").alias("transcript"))


def sticky(rows: DataFrame, by: list[str], order: str, value: Column, inherits: Column) -> DataFrame:
    """Rows that inherit get the last value seen before them in their group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sticky", F.when(inherits & value.isNull(), F.last(value, ignorenulls=True).over(w)).otherwise(value))


def pulled_assets(rows: DataFrame, by: str, order: str, assets: str, pronoun: Column, reach: int = 4) -> DataFrame:
    """For turns that refer back: the newest non-empty asset list among the last ``reach`` turns."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(reach - 1), 0)
    newest = F.last(F.when(F.size(assets) > 0, F.col(assets)), ignorenulls=True).over(w)
    return rows.withColumn("pulled", F.when(pronoun, newest))


def attach_to_last(rows: DataFrame, by: str, order: str, role: str = "role") -> DataFrame:
    """Marks each session's last turn if it is the assistant's."""
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc())) == 1
    return rows.withColumn("attach", last & (F.col(role) == "assistant"))


def repeats(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Whether a shown key equals the one shown before; rows that show nothing (null) don't reset it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("repeated", F.coalesce(F.col(key) == F.last(key, ignorenulls=True).over(w), F.lit(False)))


# Words that name no topic, and the likeness under which a repeated result is a stuck one.
TOPICLESS = "show chart figure figures table visual diagram about what does from world development report".split()
STUCK = 0.35


def topic_likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the words of two questions, 0 if one of them names no topic."""

    def words(c: Column) -> Column:
        every = F.split(F.trim(F.regexp_replace(F.lower(c), "[\\s-]+", " ")), " ")
        return F.array_distinct(F.filter(every, lambda w: (F.length(w) > 2) & ~w.isin(*TOPICLESS)))

    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(jaccard(x, y))


def stuck(rows: DataFrame, by: str, order: str, key: str, asked: str) -> DataFrame:
    """``repeats``, and whether a repeated key answers a question (``asked``) unlike the one it was shown for before."""
    rows = repeats(rows, by, order, key)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col(key).isNotNull(), F.col(asked)), ignorenulls=True).over(w)
    return rows.withColumn("_before", before).withColumn("stuck", F.coalesce(F.col("repeated") & (topic_likeness(F.col("_before"), F.col(asked)) < STUCK), F.lit(False))).drop("_before")


def rate_limited(events: DataFrame, by: str, ts: str, key: str, cap: int = CAP, seconds: int = SECONDS) -> DataFrame:
    """by, key, accepted: at most ``cap`` accepted requests within ``seconds``; only accepted ones count.

    The decision depends on earlier ones, so each session's requests are read in order, ties by key. They pass by
    as a sorted stream: what is held is the ``cap`` times accepted last, however many requests a session has.
    """
    rows = events.select(F.col(by).alias(by), F.col(key).alias(key), F.col(ts).cast("timestamp").cast("double").alias("t"))
    ordered = rows.repartition(by).sortWithinPartitions(by, "t", key)

    def run(batches):
        now, recent = None, deque(maxlen=cap)
        for batch in batches:
            flags = []
            for session, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if (session,) != now:
                    now, recent = (session,), deque(maxlen=cap)
                fits = len(recent) < cap or t - recent[0] > seconds
                if fits:
                    recent.append(t)
                flags.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(flags)], names=[by, key, "accepted"])

    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("accepted", T.BooleanType())]))


def counts_within(events: DataFrame, by: str, ts: str, seconds: int = SECONDS) -> DataFrame:
    """All requests, rejected ones too, of the last ``seconds``; times count to the nearest second, halves to the even one."""
    w = Window.partitionBy(by).orderBy(F.rint(F.col(ts).cast("timestamp").cast("double")).cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("within", F.count("*").over(w))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a call; unknown models cost nothing, negative counts are zero."""
    cost = F.lit(0.0)
    for name, (a, b) in PRICES.items():
        cost = F.when(model == name, F.greatest(tokens_in, F.lit(0)) / 1e6 * a + F.greatest(tokens_out, F.lit(0)) / 1e6 * b).otherwise(cost)
    return cost


def page_runs(pages: DataFrame, by: str, page: str, most: int) -> DataFrame:
    """first, last, n of runs of at most ``most`` consecutive pages."""
    order = Window.partitionBy(by).orderBy(page)
    rows = pages.select(by, page).distinct().withColumn("_i", F.col(page) - F.row_number().over(order))
    rows = rows.withColumn("_w", F.floor((F.row_number().over(Window.partitionBy(by, "_i").orderBy(page)) - 1) / most))
    return rows.groupBy(by, "_i", "_w").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("n")).drop("_i", "_w")


def nearest_within(rows: DataFrame, by: str, order: str, is_target: Column, is_source: Column, reach: int = 4) -> DataFrame:
    """For each source row the nearest target row at most ``reach`` places away, the earlier one on ties."""
    s = rows.filter(is_source).select(by, F.col(order).alias("at"), F.explode(F.sequence(F.col(order) - reach, F.col(order) + reach)).alias(order))
    near = s.join(rows.filter(is_target).select(by, order), [by, order])
    return near.groupBy(by, "at").agg(F.min(F.struct(F.abs(F.col(order) - F.col("at")).alias("d"), F.col(order).alias("o"))).alias("m")).select(by, "at", F.col("m.o").alias("nearest"))


def sections_of_pages(pages: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """Range join of pages with disjoint ranges (by, start, end, section) as a union and one ordered pass."""
    marks = ranges.select(by, F.col("start").alias("page"), F.struct("end", "section").alias("r"), F.lit(None).cast("long").alias("row_id"))
    every = marks.unionByName(pages.select(by, "page", F.lit(None).cast(marks.schema["r"].dataType).alias("r"), "row_id"))
    w = Window.partitionBy(by).orderBy("page", F.col("row_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = every.withColumn("r", F.last("r", ignorenulls=True).over(w)).filter("row_id is not null")
    return met.select("row_id", F.when(F.col("page") <= F.col("r.end"), F.col("r.section")).alias("section"))
