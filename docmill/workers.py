"""What Python workers need: the folder that all machines share, tables written into it, and the package itself."""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_FALLBACK = "file:///tmp/checkpoints"
#: Bytes of an Arrow batch handed to Python. Rows may be whole texts or blocks of vectors, so their number bounds nothing.
BATCH_BYTES = 4 * 2**20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; it may be unset on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def own_folder(spark: SparkSession) -> str:
    """The folder in the shared one that holds this application's tables and files; it is removed when Python ends."""
    context = spark.sparkContext
    if not hasattr(context, "_docmill_folder"):
        context._docmill_folder = f"{shared_dir(spark)}/docmill-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        context._docmill_paths = []

        def clear() -> None:
            if context._jsc is not None:  # else the session has ended, and with it the way to the folder
                remove(spark, context._docmill_folder)

        atexit.register(clear)
    return context._docmill_folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext._docmill_paths.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again. The files outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docmill_path = path
    return out


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers by way of the shared folder, wherever the driver found it; and bound what they are handed at once."""
    given = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_docmill_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((top / "docmill").rglob("*.py")):
            z.write(f, f.relative_to(top))
    path = f"{own_folder(spark)}/docmill.zip"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path)
    context._docmill_shipped = True
