"""A keyed table that is changed by small batches: base files, delta files with deletes, numbered snapshots, compaction.

    <path>/log/<number>.json      one commit each: what it did, the batch's name, the buckets it touched, where each bucket's base is
    <path>/data/<folder>/bucket=b the rows a commit wrote, in a folder of its own

A row's bucket is a hash of its key. A commit writes the rows and the keys that it changes, nothing else, and then its entry in
the log, which can be made only once (where the store can create a file only if it isn't there, as HDFS does): of two
writers of the same number one fails with ``Conflict`` and may try again. A batch whose name is in the log already changes nothing. A read takes the base of each bucket without the keys that later commits have changed,
and those keys' newest rows; buckets that no later commit has touched are read as they are. ``compact`` writes a new base for
the touched buckets alone. Files are never changed, so a snapshot can be read as long as ``vacuum`` hasn't removed it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, GONE = "put", "gone"


@dataclass
class Commit:
    number: int
    operation: str
    batch: str
    touched: list[int] = field(default_factory=list)
    #: Rows that the commit wrote: put and gone.
    rows: dict[str, int] = field(default_factory=dict)
    #: Folder that is the base of each bucket; buckets that aren't named have none.
    base: dict[int, str] = field(default_factory=dict)
    #: Folder of what the commit wrote.
    data: str = ""


class Conflict(Exception):
    """Another writer has made the commit of this number."""


class MaintainedTable:
    """Rows of one schema by ``key``, dealt to ``buckets``; see the module. Rows without a key aren't kept.

    ``create`` and ``open`` make one. All changes take a batch name; ``read`` takes a snapshot's number.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    # files

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _put(self, name: str, text: str) -> None:
        fs, p = self._file(name)
        try:
            out = fs.create(p, False)  # fails if it is there
        except Exception as e:
            raise Conflict(name) from e
        out.write(bytearray(text.encode()))
        out.close()

    def commits(self, snapshot: int | None = None) -> list[Commit]:
        """The log up to ``snapshot``, oldest first."""
        rows = self.spark.read.text(f"{self.path}/log", wholetext=True).collect()  # one small row a commit
        made = sorted((Commit(**json.loads(r["value"], object_hook=lambda d: {int(k) if k.isdigit() else k: v for k, v in d.items()})) for r in rows), key=lambda c: c.number)
        return [c for c in made if snapshot is None or c.number <= snapshot]

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 32, batch: str = "create") -> MaintainedTable:
        """A new table with the rows of ``rows``, one for each key: of several the one that sorts last."""
        table = cls(rows.sparkSession, path, key, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]), buckets)
        table._put("table.json", json.dumps({"key": key, "schema": table.schema.jsonValue(), "buckets": buckets}))
        data, wrote, touched = table._write(0, table._one_each(rows).withColumn("_what", F.lit(PUT)))
        table._commit(Commit(0, "create", batch, [], wrote, {b: data for b in touched}, data))
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> MaintainedTable:
        said = json.loads(spark.read.text(f"{path}/table.json", wholetext=True).first()["value"])
        return cls(spark, path, said["key"], T.StructType.fromJson(said["schema"]), said["buckets"])

    # writing

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _one_each(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]).filter(F.col(self.key).isNotNull())
        order = Window.partitionBy(self.key).orderBy(*[F.col(f"`{f.name}`").desc_nulls_last() for f in self.schema.fields if f.name != self.key] or [F.lit(1)])
        return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")

    def _write(self, number: int, rows: DataFrame) -> tuple[str, dict[str, int], list[int]]:
        """Write rows with a column _what: the folder, how many there are of each kind, and the buckets that they are in."""
        data = f"{number:010d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/data/{data}"
        rows.withColumn("bucket", self._bucket()).repartitionByRange("bucket", self.key).sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(at)
        counts = self._data(data).groupBy("_what", "bucket").agg(F.count("*").alias("n")).collect()  # two rows a bucket at most
        wrote: dict[str, int] = {}
        for r in counts:
            wrote[r["_what"]] = wrote.get(r["_what"], 0) + r["n"]
        return data, wrote, sorted({r["bucket"] for r in counts})

    def _commit(self, commit: Commit) -> Commit:
        self._put(f"log/{commit.number:010d}.json", json.dumps(commit.__dict__))
        return commit

    def _change(self, operation: str, batch: str, rows) -> Commit:
        made = self.commits()
        for c in made:
            if c.batch == batch:
                return c  # it came before
        number = made[-1].number + 1
        data, wrote, touched = self._write(number, rows())
        return self._commit(Commit(number, operation, batch, touched, wrote, made[-1].base, data))

    def upsert(self, rows: DataFrame, batch: str) -> Commit:
        """Put rows in; a row whose key is there replaces it whole. Of several rows of a key the one that sorts last counts."""
        return self._change("upsert", batch, lambda: self._one_each(rows).withColumn("_what", F.lit(PUT)))

    def delete(self, keys: DataFrame, batch: str) -> Commit:
        """Take out the rows whose key is among ``keys`` (one column); keys that aren't there are no matter."""
        gone = keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).filter(F.col(self.key).isNotNull()).distinct()
        rest = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in self.schema.fields]
        return self._change("delete", batch, lambda: gone.select(*rest, F.lit(GONE).alias("_what")))

    def delete_where(self, condition, batch: str) -> Commit:
        """Take out the rows for which ``condition`` is true."""
        return self.delete(self.read().filter(condition).select(self.key), batch)

    def patch(self, changes: DataFrame, batch: str) -> Commit:
        """Set columns of the rows whose key ``changes`` has: its columns besides the key. Rows that don't differ aren't written.

        Of several changes of one key the one that sorts last counts; only buckets that have a changed key are read.
        """

        def rows() -> DataFrame:
            names = [c for c in changes.columns if c != self.key]
            to = changes.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*names)).alias("_to"))
            asked = [r[0] for r in to.select(self._bucket().alias("b")).distinct().collect()]
            now = self.read(buckets=asked).join(to, self.key)
            differs = F.lit(False)
            for c in names:
                differs = differs | ~F.col(c).eqNullSafe(F.col(f"_to.{c}").cast(self.schema[c].dataType))
            return now.filter(differs).select(*[F.col(f"_to.{f.name}").cast(f.dataType).alias(f.name) if f.name in names else F.col(f.name) for f in self.schema.fields], F.lit(PUT).alias("_what"))

        return self._change("patch", batch, rows)

    def compact(self, batch: str) -> Commit:
        """Give the buckets touched since their base a base of their own; other buckets keep theirs."""
        made = self.commits()
        for c in made:
            if c.batch == batch:
                return c
        touched, number = self._touched(made), made[-1].number + 1
        data, wrote, full = self._write(number, self.read(buckets=touched).withColumn("_what", F.lit(PUT)))
        base = {b: d for b, d in made[-1].base.items() if b not in touched} | {b: data for b in full}
        return self._commit(Commit(number, "compact", batch, [], wrote, base, data))

    def vacuum(self) -> list[int]:
        """Remove data that the newest snapshot doesn't read; older snapshots can't be read then. Numbers of the commits whose data went."""
        made = self.commits()
        used = {*made[-1].base.values(), *(c.data for c in self._deltas(made))}
        gone = [c for c in made if c.data not in used]
        for c in gone:
            fs, p = self._file(f"data/{c.data}")
            fs.delete(p, True)
        return [c.number for c in gone]

    # reading

    def _data(self, data: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_what", T.StringType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{data}")

    def _deltas(self, made: list[Commit]) -> list[Commit]:
        since = max((c.number for c in made if c.operation in ("create", "compact")), default=0)
        return [c for c in made if c.number > since]

    def _touched(self, made: list[Commit]) -> list[int]:
        return sorted({b for c in self._deltas(made) for b in c.touched})

    def read(self, snapshot: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of commit ``snapshot`` (else the newest); with ``buckets`` only theirs.

        Base rows are shuffled only in buckets that a later commit has touched, and there only to meet changed keys.
        """
        made = self.commits(snapshot)
        deltas, touched = self._deltas(made), set(self._touched(made))
        wanted = set(range(self.buckets)) if buckets is None else set(buckets)
        parts: list[DataFrame] = []
        columns = [F.col(f"`{f.name}`") for f in self.schema.fields]
        newest = None
        for c in deltas:
            if here := sorted(wanted & set(c.touched)):
                rows = self._data(c.data).filter(F.col("bucket").isin(here)).withColumn("_commit", F.lit(c.number))
                newest = rows if newest is None else newest.unionByName(rows)
        if newest is not None:
            order = Window.partitionBy(self.key).orderBy(F.desc("_commit"))
            newest = newest.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
            parts.append(newest.filter(F.col("_what") == PUT).select(*columns))
        homes: dict[tuple[str, bool], list[int]] = {}
        for b, data in made[-1].base.items():
            if b in wanted:
                homes.setdefault((data, b in touched), []).append(b)
        for (data, changed), here in sorted(homes.items()):
            rows = self._data(data).filter(F.col("bucket").isin(here)).select(*columns)
            parts.append(rows.join(newest.select(self.key), self.key, "left_anti").select(*columns) if changed else rows)
        out = parts[0] if parts else self.spark.createDataFrame([], self.schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
