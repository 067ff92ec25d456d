"""Ordered folds and identifiers against plain restatements; streams against tables; files."""

import random
import uuid

from pyspark.sql import functions as F

from docmill.functions import guard, quality, text, understand
from docmill.operators import assets, chunking, index, session, tabular
from docmill.plans import pipelines
from docmill.sources import files
from docmill.streaming import stateful, windows


def packed(parts, size, overlap):
    out, now = [], []
    for p in parts:
        if now and len("\n\n".join(now)) + len(p) + 1 > size:
            out.append("\n\n".join(now))
            keep = 0
            while keep < len(now) and len("\n\n".join(now[len(now) - keep - 1 :])) <= overlap:
                keep += 1
            now = now[len(now) - keep :]
        now = [*now, p]
    return out + (["\n\n".join(now)] if now else [])


def test_pack_equals_restatement(spark):
    rng = random.Random(1)
    lists = [["x" * rng.randint(1, 90) for _ in range(rng.randint(0, 25))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, ps array<string>")
    got = {r.id: r.out for r in df.select("id", chunking.pack(F.col("ps"), 200, 60).alias("out")).collect()}
    assert all(got[k] == packed(ps, 200, 60) for k, ps in enumerate(lists))


def limited(times, cap, seconds):
    recent, out = [], []
    for t in times:
        recent = [x for x in recent if t - x <= seconds]
        out.append(len(recent) < cap)
        if out[-1]:
            recent.append(t)
    return out


def events(n=400, seed=2):
    rng = random.Random(seed)
    return [(f"s{rng.randint(0, 6)}", k, float(rng.randint(0, 600))) for k in range(n)]


def expected(rows, cap, seconds):
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((t, k) for x, k, t in rows if x == s)
        want |= dict(zip([k for _, k in own], limited([t for t, _ in own], cap, seconds)))
    return want


def test_rate_limit_equals_restatement(spark):
    rows = events()
    df = spark.createDataFrame(rows, "sid string, id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: r.accepted for r in session.rate_limited(df, "sid", "ts", "id", 5, 60).collect()}
    assert got == expected(rows, 5, 60)
    assert not all(got.values())


def test_streamed_rate_limit_equals_table(spark, tmp_path):
    rows = events(200, 3)
    df = spark.createDataFrame(rows, "sid string, id long, t double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stateful.rate_limited_stream(stream, "sid", "ts", "id").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.accepted for r in spark.table("limited").collect()} == expected(rows, 5, 60)


def test_stream_windows_and_resumed_ingest(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    want = {(r.start, r.event_type): r.n for r in windows.tumbling(e, "ts", "1 hour", ["event_type"]).collect()}
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "1 hour", ["event_type"], late="1 day").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start, r.event_type): r.n for r in spark.table("counts").collect()} == want
    ddl = "event_id bigint, ts timestamp, event_type string, value double"
    for _ in range(2):  # the second run finds nothing new
        stateful.ingest(spark, str(tmp_path / "in"), ddl, str(tmp_path / "out"), str(tmp_path / "c2"), lambda d: d.filter("event_id >= 0"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()


def test_uuid5_equals_python(spark):
    names = ["", "a", "äöü ß", "x" * 500, "日本"]
    df = spark.createDataFrame([(x,) for x in names], "t string").select("t", text.uuid5(F.col("t")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.t)) for r in df.collect())


def test_recursive_split_bounds_parts(spark):
    rows = ["a" * 300, "word " * 100, "one. two. " * 40, "", None, "p\n\nq" * 60]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select("t", chunking.recursive_split(50)("t").alias("ps"))
    for r in df.collect():
        assert all(0 < len(p) <= 50 for p in r.ps)
        assert "".join("".join(r.ps).split()).replace(".", "") == "".join((r.t or "").split()).replace(".", "")


def test_guard_columns(spark):
    rows = ["call +1 555-123-4567 or a@b.co", "x" * 30, "hello there", "Table 2.1 of World Bank has 12% and 12%"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    got = df.select(guard.redacted(F.col("t")).alias("r"), guard.weak_content(F.col("t")).alias("w"), guard.entities(F.col("t")).alias("e"), guard.redacted(guard.redacted(F.col("t"))).alias("rr")).collect()
    assert got[0].r == "call [REDACTED_PHONE] or [REDACTED_EMAIL]"
    assert [x.w for x in got] == [None, "run", None, None]
    assert got[3].e == ["12%", "Table 2.1", "World Bank"]
    assert all(x.r == x.rr for x in got)


def test_clean_text_and_understanding(spark):
    df = spark.createDataFrame([("inter-\nnational long - term and pre - and x\r\na / b\n\n\n\nc",)], "t string")
    assert df.select(chunking.clean_text(F.col("t"))).first()[0] == "international longterm and pre - and x\na/b\n\nc"
    q = spark.createDataFrame([("show figure 2.1 of Chapter IV in 2020",)], "t string")
    r = q.select(understand.entity_labels(F.col("t")).alias("e"), understand.chapter(F.col("t")).alias("c"), understand.year(F.col("t")).alias("y")).first()
    assert (r.e, r.c, r.y) == (["Figure_2.1"], 4, "2020")
    assert q.filter(understand.filter_from({"t": ["x"], "u": None})).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, source_type string")
    assert pipelines.ingest(docs).count() == 0
    assert quality.judged(docs).count() == 0
    assert index.exact_dedupe(docs, "text", "doc_id").count() == 0


def test_answer_contexts_and_checks(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    docs = d.select("doc_id", "text", F.when(F.col("lang") == "en", "csv").otherwise("pdf").alias("source_type"))
    qs = d.filter("doc_id < 3").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 80).alias("text"))
    out = pipelines.answer_contexts(qs, docs, 3).collect()
    assert out and max(r["rank"] for r in out) <= 3
    a = spark.createDataFrame([('He said "never seen"', "other words here"), ("plain words here", "plain words here")], "answer string, source string")
    assert [r.verdict.passed for r in pipelines.checked_answers(a).collect()] == [False, True]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text('﻿Country Name,Country Code,Indicator Name,Indicator Code,1960\nIndia,IND,"GDP, total",G,"1,234"\n', encoding="utf-8")
    (tmp_path / "y.md").write_text("# Head\n\nA paragraph long enough to keep.\n\nno\n")
    (tmp_path / "z.bin").write_text("-")
    (tmp_path / "d.json").write_text('{"documents": [{"id": "1", "text": "t", "metadata": {"k": "v"}}, {"id": "2", "text": " "}]}')
    assert {r.suffix for r in files.scan(spark, str(tmp_path)).collect()} == {"csv", "md"}
    m = files.csv_matrix(spark, str(tmp_path))
    assert tabular.header_row(m).first().kind == "world_bank_wide"
    assert m.filter("row = 1").first().cells == ["India", "IND", "GDP, total", "G", "1,234"]
    assert spark.range(1).select(tabular.parse_value(F.lit("1,234")).alias("v"), tabular.parse_value(F.lit("..")).alias("w")).first() == (1234.0, None)
    assert [r.text for r in files.text_files(spark, str(tmp_path)).collect()] == ["A paragraph long enough to keep."]
    assert [r.id for r in files.json_documents(spark, str(tmp_path / "d.json")).collect()] == ["1"]
    images = spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2"))], "path string, content binary")
    cache = images.filter("path = 'p'").select(F.md5("content").alias("image_hash"), F.lit("v1").alias("prompt_version"))
    assert [r.path for r in files.missing_captions(images, cache, "v1").collect()] == ["q"]


def test_token_packing_and_isolation_equal_restatements(spark):
    rng = random.Random(9)

    def pack(parts, most):
        out, now = [], []
        for p in parts:
            ws = p.split()
            if len(ws) > most:
                out += [" ".join(now)] * bool(now) + [" ".join(ws[k : k + most]) for k in range(0, len(ws), most)]
                now = []
            elif len(now) + len(ws) > most:
                out, now = out + [" ".join(now)] * bool(now), ws
            else:
                now = now + ws
        return out + [" ".join(now)] * bool(now)

    def isolate(t, label, reach):
        at, spans = t.find(label), []
        while at >= 0:
            lo, hi = max(at - reach, 0), at + len(label) + reach
            if spans and spans[-1][1] >= at - reach:
                spans[-1][1] = hi
            else:
                spans.append([lo, hi])
            at = t.find(label, at + len(label))
        return " ... ".join(t[a:b] for a, b in spans)

    lists = [[" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    texts = ["".join(rng.choice("xer ") for _ in range(rng.randint(0, 120))) for _ in range(40)]
    df = spark.createDataFrame([(k, lists[k], texts[k]) for k in range(40)], "id int, ps array<string>, t string")
    for r in df.select("id", assets.packed_tokens(F.col("ps"), 10).alias("p"), assets.isolated(F.col("t"), "er", 5).alias("i")).collect():
        assert r.p == pack(lists[r.id], 10)
        assert r.i == isolate(texts[r.id], "er", 5)
