"""Decisions that depend on those made before: requests of a key, in order of time, by a small state machine.

A machine has ``start()``, its first state (a list of numbers), and ``step(state, t, *facts)``, the new state and the answer to
a request at time t. Tables pass through it as sorted streams (``decided``); streams with late events through
``streaming.stateful.decided_stream``, which gives the same answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ship

#: Attempts that one question may make.
BUDGET = 3


@dataclass(frozen=True)
class Limiter:
    """At most ``cap`` accepted requests within ``seconds``; rejected ones take no quota. The state is the times accepted last."""

    cap: int = 5
    seconds: float = 60

    def start(self) -> list[float]:
        return []

    def step(self, state: list[float], t: float) -> tuple[list[float], str]:
        state = [x for x in state if t - x <= self.seconds]
        return (state + [t], "accepted") if len(state) < self.cap else (state, "rejected")


@dataclass(frozen=True)
class Breaker:
    """Attempts of questions at a service that may fail: a budget for each question and a circuit for the service.

    Closed, attempts are sent; ``trip`` failures in a row open the circuit. Open, nothing is sent for ``cool`` seconds; the
    next attempt after that is a trial: if it fails the circuit opens again, else it is closed. A question
    that has made ``budget`` attempts makes no more; what isn't sent takes no budget. Questions come one after the other.
    """

    trip: int = 2
    cool: float = 600
    budget: int = BUDGET

    def start(self) -> list[float]:
        return [0, 0, 0, 0, 0]  # failures in a row, open, since when, question known, attempts of it; the question comes last

    def step(self, state: list[float], t: float, question: float, failed: float) -> tuple[list[float], str]:
        fails, is_open, since, known, attempts, *last = state
        if not known or last != [question]:
            attempts = 0
        trial = bool(is_open) and t - since >= self.cool
        if is_open and not trial:
            return [fails, 1, since, 1, attempts, question], "open"
        if attempts >= self.budget:
            return [fails, is_open, since, 1, attempts, question], "budget"
        fails = fails + 1 if failed else 0
        opens = bool(failed) and (trial or fails >= self.trip)
        return [fails, int(opens), t if opens else since, 1, attempts + 1, question], "trial" if trial else "sent"


def facts_of(events: DataFrame, by: str, ts: str, key: str, facts: list[str]) -> DataFrame:
    """by, key, time and the facts as numbers."""
    return events.select(F.col(by).alias(by), F.col(key).alias(key), F.col(ts).cast("timestamp").cast("double").alias("t"), *[F.col(c).cast("double").alias(f"fact_{k}") for k, c in enumerate(facts)])


def decided(events: DataFrame, by: str, ts: str, key: str, machine, facts: list[str] = []) -> DataFrame:
    """by, key, answer: each request's answer, requests of a ``by`` taken by time, ties by ``key``.

    A key's requests pass by in order; what is held is one state, however many they are. Null facts are 0.
    """
    ship(events.sparkSession)
    rows = facts_of(events, by, ts, key, facts).na.fill(0.0, [f"fact_{k}" for k in range(len(facts))])
    ordered = rows.repartition(by).sortWithinPartitions(by, "t", key)

    def run(batches):
        now, state = None, []
        for batch in batches:
            answers = []
            for one, t, *rest in zip(*(batch.column(k).to_pylist() for k in (0, *range(2, batch.num_columns)))):
                if (one,) != now:
                    now, state = (one,), machine.start()
                state, answer = machine.step(state, t, *rest)
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(answers, pa.string())], names=[by, key, "answer"])

    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("answer", T.StringType())]))
