"""Connected components by alternating large-star and small-star steps.

Every step groups edges by one end and points the neighbours at the smallest of them; no step
gathers a neighbourhood in one place: the minimum is a partial aggregate and is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.filter("v > u").join(least, F.col("u") == F.col("w"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    near = down.join(least, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every edge points down, from a node that has no other edge down and isn't pointed at."""
    ends = edges.select(F.col("u").alias("n"), (F.col("v") < F.col("u")).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(None).cast("boolean").alias("down")))
    bad = ends.groupBy("n").agg(F.count_if(F.col("down")).alias("out"), F.count_if(F.col("down").isNull()).alias("held"), F.count_if(~F.col("down")).alias("up"))
    return not bad.filter("up > 0 OR out > 1 OR (out = 1 AND held > 0)").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node reachable) of every node of ``edges`` (u, v long).

    Loops and repeated edges don't matter; edges with a null end are left out; no edges give no
    rows. The steps are written tables in the shared folder, so a lost executor costs no more than
    the step at hand.
    """
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    while not _is_forest_of_stars(now):
        after = written(_small_star(_large_star(now)), "edges")
        forget(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
