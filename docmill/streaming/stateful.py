"""Stateful operators on streams: exact rate limiting, deduplicated delivery, resumable ingest, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.session import CAP, SECONDS


class RateLimiter(StatefulProcessor):
    """Keeps the times of the requests accepted last for each session; rejected ones take no quota.

    Rows (key, event, t) of a batch are decided in order of time; state is at most ``cap`` numbers.
    """

    def __init__(self, by: str, key: str, cap: int = CAP, seconds: float = SECONDS):
        self.by, self.key, self.cap, self.seconds = by, key, cap, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", self.key], kind="stable")
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        flags = []
        for t in batch["t"]:
            recent = [x for x in recent if t - x <= self.seconds]
            fits = len(recent) < self.cap
            if fits:
                recent.append(t)
            flags.append(fits)
        self.recent.update((recent,))
        yield pd.DataFrame({self.by: batch[self.by], self.key: batch[self.key], "accepted": flags})

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, by: str, ts: str, key: str, cap: int = CAP, seconds: float = SECONDS) -> DataFrame:
    """Streaming face of the exact limiter; events of a session must not arrive out of order across batches."""
    rows = events.select(by, key, F.col(ts).cast("timestamp").cast("double").alias("t"))
    schema = f"{by} {rows.schema[by].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, accepted boolean"
    return rows.groupBy(by).transformWithStateInPandas(RateLimiter(by, key, cap, seconds), schema, "Append", "None")


class InTimeOrder(StatefulProcessor):
    """Holds the requests of a key until the watermark has passed them, and then decides them in order of time.

    Requests may come late and in any order, as far as the watermark allows; state is those that wait and the machine's own.
    """

    def __init__(self, by: str, key: str, machine, facts: int):
        self.by, self.key, self.machine, self.facts = by, key, machine, facts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, key bigint, facts array<double>")
        self.now = handle.getValueState("now", "numbers array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        facts = batch[[f"fact_{k}" for k in range(self.facts)]].to_numpy(float)
        self.waiting.appendList([(float(t), int(k), [float(x) for x in f]) for t, k, f in zip(batch["t"], batch[self.key], facts)])
        self.handle.registerTimer(int(batch["t"].min() * 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((t, k, list(f)) for t, k, f in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in held if x[0] * 1000 <= mark], [x for x in held if x[0] * 1000 > mark]
        if not due:
            return
        state = list(self.now.get()[0]) if self.now.exists() else self.machine.start()
        answers = []
        for t, _, f in due:
            state, answer = self.machine.step(state, t, *f)
            answers.append(answer)
        self.now.update(([float(x) for x in state],))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(int(later[0][0] * 1000))
        else:
            self.waiting.clear()
        yield pd.DataFrame({self.by: [key[0]] * len(due), self.key: [k for _, k, _ in due], "answer": answers})

    def close(self) -> None:
        pass


def decided_stream(events: DataFrame, by: str, ts: str, key: str, machine, facts: list[str] = [], late: str = "10 minutes") -> DataFrame:
    """by, key (a number), answer: ``operators.decisions.decided`` of a stream whose events are late by ``late`` at most.

    A request is answered once the watermark has passed it; one that comes later than that is dropped, as the watermark
    says. A key's state is what waits within that time, and the machine's few numbers.
    """
    rows = events.select(by, key, F.col(ts).cast("timestamp").alias("at"), F.col(ts).cast("timestamp").cast("double").alias("t"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"fact_{k}") for k, c in enumerate(facts)])
    schema = f"{by} {rows.schema[by].dataType.simpleString()}, {key} bigint, answer string"
    return rows.withWatermark("at", late).groupBy(by).transformWithStateInPandas(InTimeOrder(by, key, machine, len(facts)), schema, "Append", "EventTime")


def delivered_once(chunks: DataFrame, key: str = "chunk_id", ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Drops redelivered chunks; with an event time only ids within the watermark are remembered."""
    if ts:
        return chunks.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return chunks.dropDuplicates([key])


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 64) -> None:
    """Resumable ingest of new Parquet files: what the checkpoint has seen isn't read again, and a repeated batch isn't written twice."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_turns(turns: DataFrame, sink: str, checkpoint: str) -> None:
    """Conversation memory as an append-only table by session."""
    turns.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cached_answers(entries: DataFrame, sink: str, checkpoint: str) -> None:
    """Semantic cache: batches of (query_id, qv, response) are kept by batch and then found by the cosine lookup.

    A batch is a folder of its own, so one that is replayed replaces itself.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["query_id"]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    entries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
