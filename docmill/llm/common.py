"""Shared folders, written intermediate tables and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import shared_dir, ship

#: Rows of an Arrow batch handed to Python; texts may be long, so fewer than Spark's default.
ARROW_ROWS = 400


def small_batches(spark: SparkSession) -> None:
    """Get the session ready for Python workers: the package at hand, and small batches of whole texts."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def own_folder(spark: SparkSession) -> str:
    """The folder in the shared one that holds this application's intermediate tables; it is removed when Python ends."""
    context = spark.sparkContext
    if not hasattr(context, "_docmill_folder"):
        context._docmill_folder = f"{shared_dir(spark)}/docmill-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        context._docmill_paths = []

        def clear() -> None:
            if context._jsc is not None:  # else the session has ended, and with it the way to the folder
                _remove(spark, context._docmill_folder)

        atexit.register(clear)
    return context._docmill_folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext._docmill_paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    The files outlive any executor. ``forget`` and ``forget_since`` remove them once nothing reads them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docmill_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove the files behind frames that ``written`` made."""
    for df in frames:
        path = getattr(df, "_docmill_path", None)
        if path:
            _remove(df.sparkSession, path)


def mark(spark: SparkSession) -> int:
    """What ``forget_since`` goes back to."""
    own_folder(spark)
    return len(spark.sparkContext._docmill_paths)


def forget_since(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Remove all tables written since ``mark``, except the one behind ``but``."""
    paths = spark.sparkContext._docmill_paths
    for path in paths[since:]:
        if path != but._docmill_path:
            _remove(spark, path)
    paths[since:] = [but._docmill_path]


def narrowed(df: DataFrame, keep: tuple[str, ...], own: str, *inputs: Column) -> tuple[DataFrame, list[str], T.StructType]:
    """Columns ``keep`` and then ``inputs`` of ``df``, the names of the kept ones and the schema of kept and ``own`` columns.

    A kept column that has the name of one of the operator's own (a DDL string) gets ``_given`` behind its
    name. Columns are found by their place, so no name of a table can clash with another.
    """
    made = T.StructType.fromDDL(own)
    names: list[str] = []
    for c in keep:
        name = c
        while name in made.names or name in names:
            name += "_given"
        names.append(name)
    source = df.select(*[F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)], *[c.alias(f"input_{k}") for k, c in enumerate(inputs)])
    kept = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, source.schema.fields)]
    return source, names, T.StructType(kept + made.fields)


#: Bits for each key of a bitmap, and the most bits of one: 2**27 are two million words of 64 bits.
BITS_PER_KEY, MOST_BITS = 16, 2**27


def parted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key may be one of ``keys`` (one column), and those whose key surely isn't (null keys too).

    A bitmap of key hashes, bounded in size whatever the number of keys, is broadcast. So rows that carry
    whole texts needn't be shuffled to meet the few that have a key; the others still have to be joined.
    """
    name = keys.columns[0]
    bits = min(MOST_BITS, max(1024, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = keys.select(at(F.col(name)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), at(F.col(f"`{key}`")).alias("place"), F.col(f"`{key}`").isNotNull().alias("said"))
    met = held.join(F.broadcast(words), F.shiftright("place", 6) == F.col("word"), "left")  # at most MOST_BITS / 64 rows
    maybe = F.col("said") & F.coalesce(F.expr("(shiftright(bits, cast(place & 63 as int)) & 1L) = 1L"), F.lit(False))
    return met.filter(maybe).select("row.*"), met.filter(~maybe).select("row.*")


def ranked(rows: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``rows`` with n, their place in ``order`` (a total one), and sum_<c> for each of ``sums``, over all rows up to their own.

    Rows are sorted into ranges; a range's rows meet in one task, and only one row for each range in a single one.
    """
    at = F.monotonically_increasing_id()  # in sorted rows: the range's number, and the place within the range
    rows = written(rows.orderBy(*order).withColumn("at", at), name).withColumn("range", F.shiftright("at", 33))
    own = Window.partitionBy("range").orderBy("at")
    here = rows.withColumns({f"sum_{c}": F.sum(c).over(own) for c in sums} | {"n": F.row_number().over(own).cast("long")})
    each = rows.groupBy("range").agg(F.count("*").alias("rows_n"), *[F.sum(c).alias(f"rows_{c}") for c in sums])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(F.col("range").alias("r"), *[F.coalesce(F.sum(f"rows_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in ["n", *sums]])
    met = here.join(each, F.col("range") == F.col("r"))
    return met.withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"before_{c}") for c in sums} | {"n": F.col("n") + F.col("before_n")}).drop("at", "range", "r", "before_n", *[f"before_{c}" for c in sums])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
