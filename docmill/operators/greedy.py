"""Greedy containment over lists of any length: in order, drop what contains, or is contained in, something kept before.

Pairs of texts of which one contains the other come from the containment join by anchors, so no list is compared
all with all. Kept is then the lexicographically first maximal independent set of these pairs, found in rounds: whatever has no
undecided earlier partner is kept, its later partners go. A round is two joins of what is still undecided; there are as
many as the longest chain of texts that alternately keep and drop each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import remove, written
from .anchored import contained_in_others, keyed


def first_independent(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id: of ``nodes`` (id, o) those that, taken by ``o``, have no partner in ``pairs`` (a, b) among those taken before.

    Pairs may come either way round, and twice. Jobs run at plan time, some for each round.
    """
    earlier = F.struct(F.col("oa"), F.col("a")) < F.struct(F.col("ob"), F.col("b"))
    both = pairs.filter("a <> b").join(nodes.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(nodes.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b")
    edges = both.select(F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("v")).distinct()
    edges = written(edges, "pairs")
    gone: list[DataFrame] = []
    while edges.limit(1).count():
        # among the undecided: a first partner that is nobody's later one is kept
        kept = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        out = written(edges.join(kept, "u", "left_semi").select("v").distinct(), "dropped")
        gone.append(out)
        dropped, old = out.select(F.col("v").alias("x")), edges
        left = edges.join(dropped.withColumnRenamed("x", "u"), "u", "left_anti").join(dropped.withColumnRenamed("x", "v"), "v", "left_anti")
        edges = written(left, "pairs")
        remove(edges.sparkSession, old._docmill_path)
    rest = nodes.select("id")
    for part in gone:
        rest = rest.join(part.select(F.col("v").alias("id")), "id", "left_anti")
    return rest


def containment_dedupe(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """by, order of what stays of each list, as ``index.containment_dedupe`` has it, for lists of any length.

    Texts are compared in lower case with single spaces. Empty and null ones are no candidates, a place that is taken twice
    counts once, by its smallest text; of equal texts only the first can stay.
    """
    plain = rows.select(F.col(by).alias("of_list"), F.col(order).alias("o"), F.trim(F.regexp_replace(F.lower(text), "\\s+", " ")).alias("text")).filter("text <> ''")
    # the one copy of the texts; what follows moves digests
    plain = written(plain.select("*", *keyed("text", "of_list")), "candidates", compression="zstd")
    places = plain.select("of_list", "o", "digest", "pid")
    twice = written(places.groupBy("of_list", "o").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select(F.col("of_list").alias("l"), F.col("o").alias("p")), "twice")
    if twice.limit(1).count():
        there = F.col("of_list").eqNullSafe(F.col("l")) & F.col("o").eqNullSafe(F.col("p"))
        least = plain.join(twice, there, "left_semi").groupBy("of_list", "o").agg(F.min(F.struct("text", "digest", "pid")).alias("t"))
        places = places.join(twice, there, "left_anti").unionByName(least.select("of_list", "o", "t.digest", "t.pid"))
    # equal texts: what drops the first of them drops the others
    nodes = written(places.groupBy("of_list", "digest", F.col("pid").alias("id")).agg(F.min("o").alias("o")), "nodes")
    found = contained_in_others(plain)
    kept = nodes if found is None else nodes.join(first_independent(nodes.select("id", "o"), found), "id", "left_semi")
    remove(plain.sparkSession, plain._docmill_path)
    return kept.select(F.col("of_list").alias(by), F.col("o").alias(order))
