"""Index maintenance: identifiers, upsert, delete, patch, and the three deduplications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; of equal versions the new one, then the one that sorts last.

    Idempotent when the same rows come again, and the same however rows are dealt.
    """
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.col(f"`{c}`").desc() for c in old.columns if c not in (key, version)]
    order = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc(), *rest)
    return every.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_new")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or null."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Take new values of ``columns`` where ``changes`` has the key; ``changed`` marks rows that differ then.

    Of several changes of one key the one with the greatest values counts, so rows are never multiplied.
    """
    new = changes.groupBy(key).agg(F.max(F.struct(*columns)).alias("_to"))
    new = new.select(key, *[F.col(f"_to.{c}").alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    met = rows.join(new, key, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in columns])
    changed = F.coalesce(F.col("_hit") & differs, F.lit(False))
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return met.select(*out, changed.alias("changed"))


def exact_dedupe(rows: DataFrame, text: str, key: str) -> DataFrame:
    """One row per content: its smallest key, the number of copies and the content id; texts themselves are not shuffled."""
    return rows.groupBy(F.sha1(text).alias("content_id")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def keep_first(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def containment_dedupe(rows: DataFrame, query: str, order: str, text: str) -> DataFrame:
    """Greedy, in order: drop a candidate that contains, or is contained in, one kept before it.

    Empty and null texts are no candidates, and a place that is taken twice counts once. A query has a
    bounded list of candidates; it is folded in one array, so chains are greedy as defined.
    """
    plain = F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))
    rows = rows.select(query, F.col(order).alias("o"), plain.alias("t")).filter("t <> ''").groupBy(query, "o").agg(F.min("t").alias("t"))
    lists = rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("xs"))
    kept = F.aggregate(
        "xs",
        F.slice(F.col("xs"), 1, 0),
        lambda s, x: F.when(F.exists(s, lambda k: F.contains(k["t"], x["t"]) | F.contains(x["t"], k["t"])), s).otherwise(F.concat(s, F.array(x))),
    )
    return lists.select(query, F.explode(kept).alias("k")).select(query, F.col("k.o").alias(order))
