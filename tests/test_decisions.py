"""State machines over ordered requests: tables and streams with late events against a restatement."""

import random

from pyspark.sql import functions as F

from docmill.operators import decisions, session
from docmill.streaming import stateful


def requests(rng, n, keys=4):
    return [(rng.randrange(keys), k, 1_700_000_000 + rng.randrange(0, 4000) + rng.choice([0.0, 0.25, 0.5]), rng.random() < 0.5) for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(b, k, float(t), int(f), int(t // 300)) for b, k, t, f in rows], "who long, id long, s double, failed int, question long").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))


def breaker_by_hand(rows, trip, cool, budget):
    out = {}
    for who in {r[0] for r in rows}:
        mode, streak, since, question, made = "closed", 0, None, None, 0
        for _, k, t, failed in sorted((r for r in rows if r[0] == who), key=lambda r: (r[2], r[1])):
            if t // 300 != question:
                question, made = t // 300, 0
            if mode == "open" and t - since >= cool:
                mode = "half"
            if mode == "open":
                out[k] = "open"
            elif made >= budget:
                out[k] = "budget"
                mode = "open" if mode == "half" else mode
            else:
                made += 1
                out[k] = "trial" if mode == "half" else "sent"
                streak = streak + 1 if failed else 0
                if failed and (mode == "half" or streak >= trip):
                    mode, since = "open", t
                else:
                    mode = "closed"
    return out


def test_limiter_is_the_table_s(spark):
    rows = requests(random.Random(1), 400)
    got = decisions.decided(table(spark, rows), "who", "ts", "id", decisions.Limiter(5, 60))
    want = session.rate_limited(table(spark, rows), "who", "ts", "id", 5, 60)
    assert {r.id: r.answer == "accepted" for r in got.collect()} == {r.id: r.accepted for r in want.collect()}


def test_breaker_by_hand(spark):
    rows = requests(random.Random(2), 600)
    for trip, cool, budget in ((2, 100, 3), (1, 700, 2), (3, 5, 1)):
        got = decisions.decided(table(spark, rows), "who", "ts", "id", decisions.Breaker(trip, cool, budget), ["question", "failed"])
        assert {r.id: r.answer for r in got.collect()} == breaker_by_hand(rows, trip, cool, budget)
    assert decisions.decided(table(spark, rows).limit(0), "who", "ts", "id", decisions.Breaker(), ["question", "failed"]).count() == 0


def test_late_events_are_decided_in_order(spark, tmp_path):
    """Shuffled within the watermark's time over several batches, a stream gives the table's answers."""
    rng = random.Random(3)
    rows = requests(rng, 240)
    order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 500))
    ends = [(who, 10_000 + 100 * n + who, 1_700_000_000 + 10_000 + 5000 * n, False) for n in range(2) for who in range(4)]  # the watermark passes all others
    for n, part in enumerate([order[k : k + 60] for k in range(0, 240, 60)] + [ends[:4], ends[4:]]):
        table(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    schema = "who long, id long, s double, failed int, question long, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, machine, facts in (("limits", decisions.Limiter(5, 60), []), ("breaks", decisions.Breaker(2, 100, 3), ["question", "failed"])):
        spark.sql(f"DROP VIEW IF EXISTS {name}")
        # files in the order of their batches
        files = sorted(str(p) for p in tmp_path.glob("in/part=*/*.parquet"))
        source = tmp_path / f"source_{name}"
        source.mkdir()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = stateful.decided_stream(stream, "who", "ts", "id", machine, facts, "600 seconds")
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        for n, f in enumerate(files):
            (source / f"{n}.tmp").write_bytes(open(f, "rb").read())
            (source / f"{n}.tmp").rename(source / f"{n}.parquet")
            q.processAllAvailable()
        q.stop()
        got = {r.id: r.answer for r in spark.table(name).collect() if r.id < 10_000}
        want = {r.id: r.answer for r in decisions.decided(table(spark, rows), "who", "ts", "id", machine, facts).collect()}
        assert got == want
