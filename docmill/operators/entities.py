"""Assets and cross references: registry joins, companions, tiered matches, path checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_ids(chunks: DataFrame, key: str, ids: str) -> DataFrame:
    return chunks.select(key, F.explode(F.array_distinct(ids)).alias("entity"))


def with_assets(chunks: DataFrame, registry: DataFrame, key: str, ids: str) -> DataFrame:
    """Paths of the registry's assets for each chunk's entities, sorted."""
    met = explode_ids(chunks, key, ids).join(registry, "entity")
    return met.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def companions(rows: DataFrame, key: str, identifier: str, kind: str) -> DataFrame:
    """Keys of the other kind with the same identifier, for each identifier as a list and not pair by pair."""
    groups = rows.groupBy(identifier, kind).agg(F.min(key).alias("first"), F.count("*").alias("n"))
    a, b = groups, groups.select(identifier, F.col(kind).alias("other"), F.col("first").alias("companion"), F.col("n").alias("companions"))
    return a.join(b, identifier).filter(F.col(kind) != F.col("other")).select(identifier, kind, "first", "companion", "companions")


def co_retrieved(candidates: DataFrame, store: DataFrame, by: str, k: int) -> DataFrame:
    """Up to ``k`` rows of the store that share an entity with a query's candidates and aren't among them, smallest ids first.

    Of an entity that many rows share only the first k + (most candidates of a query) are looked at: more of them can't be wanted.
    """
    most = candidates.groupBy(by).agg(F.count_distinct("chunk_id").alias("n")).agg(F.max("n")).first()[0] or 0
    first = store.select("entity", "chunk_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("chunk_id")))
    wanted = candidates.select(by, "entity").distinct().join(first.filter(F.col("n") <= k + most), "entity").select(by, "chunk_id").distinct()
    new = wanted.join(candidates.select(by, "chunk_id"), [by, "chunk_id"], "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("chunk_id"))).filter(F.col("n") <= k)


def tiered_unique(candidates: DataFrame, assets: DataFrame, key: str, tiers: list[list[str]]) -> DataFrame:
    """The asset of the first tier (a list of join columns) in which a candidate has exactly one.

    Assets are counted by the columns of a tier first, so that a candidate meets one row and not each asset.
    """
    parts = []
    for n, columns in enumerate(tiers):
        alone = assets.groupBy(*columns).agg(F.count("*").alias("hits"), F.min("asset").alias("asset")).filter("hits = 1")
        parts.append(candidates.select(key, *columns).join(alone, columns).select(key, "asset", F.lit(n).alias("tier")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.min_by("asset", "tier").alias("asset"), F.min("tier").alias("tier"))


def either_update(rows: DataFrame, changes: DataFrame, key: str, paths: list[list[str]]) -> DataFrame:
    """Latest change of each row that matches by one or another set of columns: an equi join for each, then the newest.

    Of the changes with the same columns only the newest (of one version the one with the largest value) can be a row's, so
    a row meets one change a path.
    """
    newest = F.max(F.struct("version", "value")).alias("newest")
    parts = [rows.select(key, *cols).join(changes.groupBy(*cols).agg(newest), cols).select(key, "newest") for cols in paths]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.max("newest").alias("newest")).select(key, F.col("newest.value").alias("value"))


def exclusive_fields(kind: Column, fields: dict[str, Column]) -> Column:
    """A struct in which only the field of the primary kind keeps its value."""
    return F.struct(*[F.when(kind == name, c).alias(name) for name, c in fields.items()])


def bound_paths(paths: Column, label: Column) -> Column:
    """Paths whose file stem is the label's."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return F.filter(paths, lambda p: plain(F.regexp_extract(p, "([^/]+?)(?:[.][^./]*)?$", 1)) == plain(label))


def safe_path(path: Column, roots: list[str], endings: list[str]) -> Column:
    """Within an approved folder, without steps upwards, with an approved ending."""
    return F.coalesce(~path.rlike("(?:^|/)[.][.](?:/|$)") & path.rlike("^(?:" + "|".join(roots) + ")/") & F.lower(path).rlike("[.](?:" + "|".join(endings) + ")$"), F.lit(False))
