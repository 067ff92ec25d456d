"""Many questions that meet many rows: what is joined grows with rows and questions, not with their product."""

import pytest
from pyspark.sql import functions as F

from docmill.operators import entities, exact, session
from tests.plans import most_joined

N = 400


def _asks(spark):
    return spark.range(N).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "Figure 1.2 and Table 3").otherwise("fig 1.2").alias("text"))


def _store(spark):
    k = F.col("id")
    payload = F.create_map(F.lit("label"), F.when(k % 3 == 0, "Figure 1.2").when(k % 3 == 1, "table_3").otherwise("chart 9"))
    image = F.when(k % 5 == 0, F.concat(F.lit("img/full-page "), k)).when(k % 5 == 1, F.concat(F.lit("img/"), k)).otherwise("")
    return spark.range(N).select("id", F.when(k % 7 != 0, "said").otherwise(" ").alias("text"), payload.alias("payload"), image.alias("image"), (k % 4 == 0).alias("chart"), (k % 20).alias("parent_id"))


def _priority(i):
    return (i % 5 > 1, i % 4 != 0, i % 5 == 0, i)


def _hits(q):
    return [i for i in range(N) if i % 7 and (i % 3 == 0 or (i % 3 == 1 and q % 2 == 0))]


def test_exact_values(spark):
    names = ["india", "china", "new zealand"]
    q = spark.createDataFrame([(i, f"GDP of {names[i % 3]} and india in 2001" if i % 4 else "total gdp in 2001" if i % 8 else "gdp, 2001") for i in range(N)], "query_id long, text string")
    facts = [(i // 2, "CSV" if i % 7 else "pdf", ["India", "China", "New Zealand", "Nowhere"][i % 4], "abc", "gdp", "2001") for i in range(N)]
    f = spark.createDataFrame(facts, "ord long, source_type string, name string, code string, metric string, year string")
    aliases = spark.createDataFrame([(n, n) for n in names], "alias string, value string")
    df = exact.exact_values(q, f, aliases, "ord")
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.ord))

    def wanted(i):
        # words of three letters are names too: without a country none fits, and so none is found
        asked = {names[i % 3], "india"} if i % 4 else set()
        return [o for o, kind, name, *_ in sorted(facts) if kind == "CSV" and name.lower() in asked][:5]

    assert {i: [o for _, o in sorted(v)] for i, v in got.items()} == {i: wanted(i) for i in range(N) if wanted(i)}
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert most_joined(df) <= 20 * N


def test_exact_values_without_a_name(spark):
    """A code or a word of a name fits, null names don't, equal facts count each; without a name at all any fact fits."""
    q = spark.createDataFrame([(1, "CO2 emissions, 1999"), (2, "emissions xyz 1999"), (3, "emissions in 1999")], "query_id long, text string")
    rows = [(5, "A", "xyz"), (5, "A", "xyz"), (3, None, None), (4, "xyz b", "xyz"), (2, "", "q"), (9, "b", "xyz"), (8, "b", "xyz")]
    f = spark.createDataFrame([(o, "csv", n, c, "co2", "1999") for o, n, c in rows], "ord long, source_type string, name string, code string, metric string, year string")
    df = exact.exact_values(q, f, spark.createDataFrame([], "alias string, value string"), "ord")
    got = sorted((r.query_id, r["rank"], r.ord) for r in df.collect())
    assert [o for i, _, o in got if i == 2] == [4, 5, 5, 8, 9]
    assert [o for i, _, o in got if i == 3] == [2, 3, 4, 5, 5]
    assert not [o for i, _, o in got if i == 1]  # co2 itself is a word of three letters


def test_exact_figures(spark):
    asked = spark.range(N).select(F.col("id").alias("query_id"), F.concat(F.lit(" Fig-"), F.col("id") % 2).alias("figure_id"))
    docs = spark.range(N).select("id", F.lit("fig-1").alias("figure_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("source"), F.lit("7").alias("page"))
    df = exact.exact_figures(asked.unionByName(asked), docs, "id")
    assert sorted((r.query_id, r.id) for r in df.collect()) == [(q, i) for q in range(1, N, 2) for i in range(3)]
    assert most_joined(df) <= 3 * N


def test_exact_scan(spark):
    df = exact.exact_scan(_asks(spark), _store(spark), 3)
    got = sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    assert got == [(q, n + 1, i) for q in range(N) for n, i in enumerate(sorted(_hits(q)[:32], key=_priority)[:3])]
    assert most_joined(df) <= 5 * N
    assert sorted((r.query_id, r.id) for r in exact.exact_scan(_asks(spark).limit(2), _store(spark), None).collect()) == sorted((q, i) for q in range(2) for i in _hits(q))


def test_step_three(spark):
    df = exact.step_three(_asks(spark), _store(spark), 2)
    want = []
    for q in range(N):
        first = {}
        for i in _hits(q):
            first.setdefault(i % 20, i)
        best = sorted(first.values(), key=_priority)[: 4 if q % 2 == 0 else 2]
        want += [(q, n + 1, i % 20, i) for n, i in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.parent_id, r.id) for r in df.collect()) == want
    assert most_joined(df) <= 4 * N


def test_either_update(spark):
    rows = spark.range(N).select("id", (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"))
    changes = spark.range(N).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 50).alias("version"), F.concat(F.lit("v"), "id").alias("value"))
    df = entities.either_update(rows, changes, "id", [["a"], ["b"]])
    fits = lambda i: max((c % 50, f"v{c}") for c in range(N) if c % 2 == i % 2 or c % 3 == i % 3)[1]
    assert sorted(tuple(r) for r in df.collect()) == [(i, fits(i)) for i in range(N)]
    assert most_joined(df) <= N


def test_spellings_are_made_once(spark):
    """Rows that meet the same entities are compared with finished spellings."""
    es = exact.hard_entities(F.lit("Figure 1.2, Table 3 and Figure O.4"))
    for strict in (True, False):
        said = spark.createDataFrame([(x,) for x in ["Figure 1.2", "figure_1.2", "1.2", "table 3", "Figure 0.4", "0.4", "Chart 3", None]], "said string")
        wanted = spark.range(1).select(exact.spellings(es, strict).alias("w"))
        got = said.crossJoin(wanted).select("said", exact.says([F.array("said")], F.col("w")).alias("x"), exact.names_entity([F.array("said")], es, strict).alias("y")).collect()
        assert [r.x for r in got] == [r.y for r in got] and any(r.x for r in got)


@pytest.mark.parametrize("half", [0.5, 0.499999, 0.500001])
def test_counts_within_rounds_seconds(spark, half):
    """Seconds are rounded, halves to the even one, as the SQL's cast does it."""
    at = [0.0, 3600 + half, 3601 + half, 7200.25, 7201 + half]
    e = spark.createDataFrame([(k, 1, x) for k, x in enumerate(at)], "event_id long, user_id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    got = [r.within for r in session.counts_within(e, "user_id", "ts", 3600).orderBy("event_id").collect()]
    t = [round(x) for x in at]
    assert got == [sum(0 <= y - x <= 3600 for x in t) for y in t]
