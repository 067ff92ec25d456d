"""Range joins with ranges that overlap, as equi-joins on dyadic bins.

A range of length n is the union of at most 2 log2(n) + 2 bins, each of 2**level numbers and beginning at a multiple of that;
a point lies in one bin of each level. So "point in range" is an equi-join on (level, bin), exact without a check
afterwards, and a row is multiplied by the logarithm of the longest range at most, wherever the ranges lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shift(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level)


def dyadic(start: Column, end: Column, levels: int) -> Column:
    """The bins (level, bin) whose union is start..end (both inside), for ranges shorter than 2**levels."""

    def of(level: Column) -> Column:
        first = -_shift(-start.cast("long"), level)  # rounded up
        last = _shift(end.cast("long") + 1, level)  # the first one behind
        left = F.when((first < last) & (first.bitwiseAND(1) == 1), F.struct(level.alias("level"), first.alias("bin")))
        right = F.when((first < last) & (last.bitwiseAND(1) == 1), F.struct(level.alias("level"), (last - 1).alias("bin")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)))


def _levels(ranges: DataFrame, start: str, end: str) -> int:
    longest = ranges.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long"))).first()[0]
    return max(0, int(longest or 0) + 1).bit_length()


def _binned(ranges: DataFrame, by: list[str], start: str, end: str, levels: int) -> DataFrame:
    return ranges.filter(F.col(start) <= F.col(end)).withColumn("_b", F.explode(dyadic(F.col(start), F.col(end), levels))).withColumns({"_level": F.col("_b.level"), "_bin": F.col("_b.bin")}).drop("_b")


def _points(points: DataFrame, at: str, levels: int) -> DataFrame:
    return points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_bin", _shift(F.col(at).cast("long"), F.col("_level")))


def in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Every point with every range of its ``by`` that holds it (start and end inside); empty and null ranges hold nothing.

    Columns of both, those of ``by`` once. One job at plan time finds the longest range.
    """
    levels = _levels(ranges, start, end)
    return _points(points, at, levels).join(_binned(ranges, by, start, end, levels), [*by, "_level", "_bin"]).drop("_level", "_bin")


def first_range(points: DataFrame, ranges: DataFrame, by: list[str], key: str, order: list[str], take: list[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """``key``, ``take``: for each point the range that holds it and comes first in ``order`` (null if none does).

    Of the ranges in one bin only the first can be the answer, so a bin keeps one row before the join, however many
    ranges overlap there; a point meets one row a level and keeps the first of them. Points in one place are looked up once.
    """
    levels = _levels(ranges, start, end)
    best = F.min_by(F.struct(*take), F.struct(*order))
    bins = _binned(ranges, by, start, end, levels).groupBy(*by, "_level", "_bin").agg(F.min(F.struct(*order)).alias("_order"), best.alias("_take"))
    met = _points(points.select(*by, at).distinct(), at, levels).join(bins, [*by, "_level", "_bin"])
    first = met.groupBy(*by, at).agg(F.min_by("_take", "_order").alias("_take"))
    return points.select(key, *by, at).join(first, [*by, at], "left").select(key, *[F.col(f"_take.{c}").alias(c) for c in take])


def counted(points: DataFrame, ranges: DataFrame, by: list[str], value: str, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """``ranges`` that hold a point, with n: how many they hold, and least: the smallest ``value`` of these.

    The bins of a range share no point, so points are summed up by bin and a range adds its bins up: no point meets a range.
    Equal ranges are looked up once.
    """
    levels = _levels(ranges, start, end)
    places = points.groupBy(*by, at).agg(F.count("*").alias("n"), F.min(value).alias("least"))
    added = F.sum("n").alias("n"), F.min("least").alias("least")
    bins = _points(places, at, levels).groupBy(*by, "_level", "_bin").agg(*added)
    met = _binned(ranges.select(*by, start, end).distinct(), by, start, end, levels).join(bins, [*by, "_level", "_bin"])
    return ranges.join(met.groupBy(*by, start, end).agg(*added), [*by, start, end])
