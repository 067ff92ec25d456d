"""Registered queries: structured lookups, sessions, entities, evaluation and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anchored, entities, evaluate, retrieve, session, tabular
from ..streaming import windows
from .catalogue_retrieval import BM25_SQL, questions
from .probes import probes, PROBES_SQL
from .registry import query, read

YEARS = list(range(1992, 1999))
WIDE_SQL = "wide AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def _wide(spark, sf_dir):
    """Order value by nation with a column for each year, numbers as text, gaps as '..'."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.select(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("y"), "o_totalprice").groupBy("k").pivot("y", YEARS).agg(F.round(F.sum("o_totalprice"), 2))
    return p.select("k", *[F.coalesce(F.format_number(F.col(str(y)), 2), F.lit("..")).alias(f"y{y}") for y in YEARS])


def _long(spark, sf_dir):
    return tabular.wide_to_long(_wide(spark, sf_dir), ["k"], [f"y{y}" for y in YEARS])


@query(f"WITH {WIDE_SQL} SELECT k, y::INT AS year, v::DOUBLE AS value FROM wide WHERE y BETWEEN 1992 AND 1998")
def wide_to_long(spark, sf_dir):
    return _long(spark, sf_dir)


@query(f"WITH {WIDE_SQL} SELECT k, (y // 10 * 10)::INT AS decade, count(*) AS n, string_agg(y || ' = ' || v::DECIMAL(20,2)::VARCHAR, '; ' ORDER BY y) AS facts FROM wide WHERE y BETWEEN 1992 AND 1998 GROUP BY k, y // 10")
def decade_chunks(spark, sf_dir):
    return tabular.decades(_long(spark, sf_dir), ["k"])


@query(f"WITH {WIDE_SQL} SELECT k, count(DISTINCT y) AS available, min(y)::INT AS first_year, max(y)::INT AS last_year, 7 - count(DISTINCT y) AS missing FROM wide WHERE y BETWEEN 1992 AND 1998 GROUP BY k")
def summary_chunks(spark, sf_dir):
    return tabular.summaries(_long(spark, sf_dir), ["k"], len(YEARS))


CONSTRAINTS_SQL = f"{WIDE_SQL}, c AS (SELECT n_nationkey * 10 + y - 1992 AS cid, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE -1 END AS code, n_name AS name, y AS year FROM nation, generate_series(1992, 2000) t(y)), facts AS (SELECT k AS code, n_name AS name, y AS year, v FROM wide JOIN nation ON k = n_nationkey WHERE y BETWEEN 1992 AND 1998)"


def _lookup(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    years = F.explode(F.sequence(F.lit(1992), F.lit(2000)))
    c = nation.select("n_nationkey", "n_name", years.alias("year"))
    c = c.select(
        (F.col("n_nationkey") * 10 + F.col("year") - 1992).alias("cid"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).otherwise(-1).alias("code"), F.lower("n_name").alias("name"),
        F.lit("v").alias("metric"), "year",
    )
    facts = _long(spark, sf_dir).join(nation, F.col("k") == F.col("n_nationkey")).select(
        F.col("k").alias("code"), F.col("n_name").alias("name"), F.lit("v").alias("metric"), "year", "value", F.col("year").alias("ord"),
    )
    return c, tabular.lookup(c, facts)


@query(f"WITH {CONSTRAINTS_SQL} SELECT cid, v::DOUBLE AS value FROM c JOIN facts f ON f.year = c.year AND (f.code = c.code OR f.name = c.name)")
def structured_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir)[1].select("cid", "value")


@query(f"WITH {CONSTRAINTS_SQL} SELECT cid, year FROM c WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.year = c.year AND (f.code = c.code OR f.name = c.name))")
def missing_constraints(spark, sf_dir):
    c, found = _lookup(spark, sf_dir)
    return tabular.missing(c, found).select("cid", F.col("year").cast("long").alias("year"))


@query("SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS most, max(c_acctbal)::DOUBLE AS largest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS least, min(c_acctbal)::DOUBLE AS smallest, round(sum(c_acctbal), 2)::DOUBLE AS total FROM customer GROUP BY c_nationkey")
def exact_extremum(spark, sf_dir):
    return tabular.extremes(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal")


@query("SELECT n_nationkey, n_name, coalesce(r_name, 'unknown') AS region, regexp_matches(lower(n_name || ' ' || coalesce(r_name, 'unknown')), 'income|world|africa|europe|asia|middle east|north america|latin america|caribbean|union|fragile|small states|dividend|ida|ibrd|total|countries|economies|aggregate') AS is_group FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def metadata_lookup_join(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "rk")
    r = read(spark, sf_dir, "region").filter("r_regionkey <> 2").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"))
    out = tabular.with_metadata(n, r, "rk", {"region": "unknown"})
    return out.select("n_nationkey", "n_name", "region", tabular.aggregate_entity(F.col("n_name"), F.col("region")).alias("is_group"))


@query(f"WITH {WIDE_SQL} SELECT k, y::INT AS year, 'In ' || y || ', orders of ' || n_name || ' (' || k || ') was ' || v::DECIMAL(20,2)::VARCHAR || '.' AS said FROM wide JOIN nation ON k = n_nationkey WHERE y BETWEEN 1992 AND 1998")
def row_sentences(spark, sf_dir):
    j = _long(spark, sf_dir).join(read(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"))
    return j.select("k", "year", tabular.row_sentence(F.col("n_name"), F.col("k").cast("string"), F.lit("orders"), F.col("year"), F.col("value").cast("decimal(20,2)").cast("string")).alias("said"))


_NAMED = "CASE c_custkey % 3 WHEN 0 THEN 'Orders of the ' || n_name || 's' WHEN 1 THEN 'What did ' || n_name || ' and ' || r_name || ' buy?' ELSE 'Nothing here' END"


@query(f"""WITH p AS (SELECT c_custkey AS query_id, {_NAMED} AS text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
n AS (SELECT query_id, ' ' || regexp_replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '([a-z]{{2,}})s\\b', '\\1', 'g') || ' ' AS t FROM p),
a AS (SELECT DISTINCT name, regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '([a-z]{{2,}})s\\b', '\\1', 'g') AS alias FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region))
SELECT query_id, name, length(t[:position(' ' || alias || ' ' IN t)]) - length(replace(t[:position(' ' || alias || ' ' IN t)], ' ', '')) AS pos FROM n, a WHERE contains(t, ' ' || alias || ' ')""")
def alias_match(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    c = read(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    names = n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name"))).distinct()
    asked = c.select(F.col("c_custkey").alias("query_id"), F.expr(_NAMED).alias("text"))
    return tabular.alias_matches(asked, names.select(F.col("name").alias("alias"), "name")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT n_nationkey AS file, n_nationkey % 4 AS row, CASE n_regionkey % 3 WHEN 0 THEN 'world_bank_wide' WHEN 1 THEN 'country_metadata' ELSE 'indicator_metadata' END AS kind FROM nation""")
def header_detect(spark, sf_dir):
    """A table for each nation: title, blank and data rows around the header of one of three kinds."""
    named = F.element_at(
        F.array(F.array(*map(F.lit, ("Country Name", " country code", "Indicator Name", "1960"))), F.array(*map(F.lit, ("Country Code", "Region", "IncomeGroup"))), F.array(*map(F.lit, ("INDICATOR_CODE", "INDICATOR_NAME", "note")))),
        (F.col("n_regionkey") % 3 + 1).cast("int"),
    )
    rows = read(spark, sf_dir, "nation").withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    other = F.when(
        F.col("row") == 0, F.array(F.lit("Data Source"), F.lit("Country Code"), F.lit("Region")),
    ).when(F.col("row") % 2 == 1, F.array(F.lit(""), F.lit(" "))).otherwise(F.array("n_name", F.lit("region"), F.lit("7")))
    cells = F.when(F.col("row") == F.col("n_nationkey") % 4, named).otherwise(other)
    return tabular.header_row(rows.select(F.col("n_nationkey").alias("file"), "row", cells.alias("cells")))


_NAMES = "CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 5 = 0 THEN ' ' || l_returnflag ELSE l_returnflag END"


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN trim({_NAMES}) = '' THEN 'column_' || (l_linenumber + 1) ELSE trim({_NAMES}) END AS base FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS header FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, base ORDER BY l_linenumber) AS n FROM h)""")
def unique_headers(spark, sf_dir):
    """The lines of an order as a header row."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_NAMES).alias("name"))
    return tabular.unique_headers(li, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "header")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def history_last_n(spark, sf_dir):
    return session.last_n(read(spark, sf_dir, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id")
def history_transcript(spark, sf_dir):
    return session.transcript(read(spark, sf_dir, "conversations"), "conv_id", "turn", 6)


@query("SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 1 THEN last_value(CASE WHEN turn % 3 = 0 THEN 'asset' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END, '') AS pulled FROM conversations")
def relative_ref_assets(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    assets = F.when(F.col("turn") % 3 == 0, F.array(F.concat(F.lit("asset"), "turn"))).otherwise(F.array().cast("array<string>"))
    out = session.pulled_assets(c.withColumn("assets", assets), "conv_id", "turn", "assets", F.col("turn") % 2 == 1)
    return out.select("conv_id", "turn", F.coalesce(F.array_join("pulled", ","), F.lit("")).alias("pulled"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1 AND role = 'assistant'")
def attach_sources(spark, sf_dir):
    return session.attach_to_last(read(spark, sf_dir, "conversations"), "conv_id", "turn").filter("attach").select("conv_id", "turn")


@query("SELECT event_id, coalesce(k = last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS repeated FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN event_type END AS k FROM events)")
def adjacent_repeat(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_id") % 4 != 0, F.col("event_type")))
    return session.repeats(e, "user_id", "event_id", "k").select("event_id", "repeated")


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sticky FROM events")
def sticky_fill(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return session.sticky(e, ["user_id"], "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")), F.lit(True)).select("event_id", "sticky")


@query()
def rate_limit_exact(spark, sf_dir):
    """Sliding-window limiter: rejected requests take no quota, so it is a fold; tested against a plain restatement."""
    return session.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5, 3600)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS within FROM events")
def rate_count_window(spark, sf_dir):
    return session.counts_within(read(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "within")


@query("SELECT user_id, round(sum(CASE event_type WHEN 'click' THEN value / 1e6 * 5 WHEN 'view' THEN value / 1e6 * 0.15 ELSE 0 END), 6)::DOUBLE AS cost, count(*) AS calls FROM events GROUP BY user_id")
def session_cost(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    model = F.when(F.col("event_type") == "click", "large").when(F.col("event_type") == "view", "small")
    cost = session.token_cost(model, F.col("value"), F.lit(0))
    return e.groupBy("user_id").agg(F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("cost"), F.count("*").alias("calls"))


@query("SELECT user_id, round(sum(value), 4)::DOUBLE AS total, round(sum(CASE WHEN contains(event_type, 'i') THEN value ELSE 0 END), 4)::DOUBLE AS with_i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5 GROUP BY user_id")
def last5_breakdown(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    e = read(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 5")
    return e.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.when(F.contains("event_type", F.lit("i")), F.col("value")).otherwise(0.0)), 4).alias("with_i"))


@query("WITH p AS (SELECT DISTINCT o_custkey AS k, (o_orderkey // 4) % 60 AS page FROM orders), i AS (SELECT *, page - row_number() OVER (PARTITION BY k ORDER BY page) AS g FROM p), w AS (SELECT *, (row_number() OVER (PARTITION BY k, g ORDER BY page) - 1) // 3 AS w FROM i) SELECT k, min(page) AS first, max(page) AS last, count(*) AS n FROM w GROUP BY k, g, w")
def page_windows(spark, sf_dir):
    p = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.floor(F.col("o_orderkey") / 4) % 60).alias("page"))
    return session.page_runs(p, "k", "page", 3)


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type FROM events) SELECT s.user_id, s.pos AS at, arg_min(t.pos, (abs(t.pos - s.pos), t.pos)) AS nearest FROM e s JOIN e t ON s.user_id = t.user_id AND abs(t.pos - s.pos) <= 4 AND t.event_type = 'view' WHERE s.event_type = 'click' GROUP BY ALL")
def nearest_caption(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return session.nearest_within(rows, "user_id", "pos", F.col("event_type") == "view", F.col("event_type") == "click").select(
        "user_id", F.col("at").cast("long").alias("at"), F.col("nearest").cast("long").alias("nearest"),
    )


@query("SELECT event_id AS row_id, coalesce('s' || (event_id % 100 // 20), '') AS section FROM events WHERE event_id % 100 % 20 < 15 UNION ALL SELECT event_id, '' FROM events WHERE event_id % 100 % 20 >= 15")
def range_join_sections(spark, sf_dir):
    """Pages to chapters with disjoint page ranges, some pages between them."""
    pages = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 100).alias("page"), F.col("event_id").alias("row_id"))
    ranges = pages.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    ranges = ranges.select("user_id", (F.col("k") * 20).alias("start"), (F.col("k") * 20 + 14).alias("end"), F.concat(F.lit("s"), "k").alias("section"))
    return session.sections_of_pages(pages, ranges, "user_id").select("row_id", F.coalesce("section", F.lit("")).alias("section"))


@query("SELECT conv_id, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM (SELECT conv_id, 'img/' || (turn % 3) || '.png' AS p FROM conversations WHERE turn % 3 < 2) GROUP BY conv_id")
def asset_join(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit("Figure_"), (F.col("turn") % 3))).alias("ids"))
    registry = spark.createDataFrame([("Figure_0", "img/0.png"), ("Figure_1", "img/1.png")], "entity string, path string")
    return entities.with_assets(c, registry, "conv_id", "ids")


@query("WITH g AS (SELECT l_partkey AS ident, l_returnflag AS kind, min(l_orderkey) AS first, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a.ident, a.kind, a.first, b.first AS companion, b.n AS companions FROM g a JOIN g b ON a.ident = b.ident AND a.kind <> b.kind")
def companions(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ident"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("k"))
    return entities.companions(li, "k", "ident", "kind")


@query(f"""WITH {BM25_SQL}, c AS (SELECT query_id, doc_id AS chunk_id, doc_id % 50 AS entity FROM bm_ranked WHERE rank <= 3), s AS (SELECT DISTINCT c.query_id, d.doc_id AS chunk_id FROM c JOIN documents d ON d.doc_id % 50 = c.entity WHERE d.doc_id NOT IN (SELECT chunk_id FROM c c2 WHERE c2.query_id = c.query_id))
SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM s) WHERE n <= 5""")
def co_retrieval(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    r = retrieve.bm25(questions(spark, sf_dir), d, 3).select("query_id", F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("entity"))
    store = d.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("entity"))
    return entities.co_retrieved(r, store, "query_id", 5).select("query_id", "chunk_id")


@query("""WITH a AS (SELECT s_suppkey AS asset, s_nationkey AS n, s_suppkey % 7 AS m FROM supplier), t0 AS (SELECT c_custkey, min(asset) AS asset FROM customer JOIN a ON n = c_nationkey AND m = c_custkey % 7 GROUP BY 1 HAVING count(*) = 1), t1 AS (SELECT c_custkey, min(asset) AS asset FROM customer JOIN a ON n = c_nationkey GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, asset, 0::INT AS tier FROM t0 UNION ALL SELECT c_custkey, asset, 1 FROM t1 WHERE c_custkey NOT IN (SELECT c_custkey FROM t0)""")
def tiered_unique_match(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 7).alias("m"))
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 7).alias("m"))
    return entities.tiered_unique(c, a, "c_custkey", [["n", "m"], ["n"]])


@query("SELECT c_custkey, arg_max(v, (ver, v)) AS value FROM (SELECT c_custkey, s_suppkey AS ver, s_name AS v FROM customer JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT c_custkey, s_suppkey, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 5 = s_suppkey % 5) GROUP BY 1")
def either_key_update(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("figure"), (F.col("c_custkey") % 5).alias("page"))
    s = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("figure"), (F.col("s_suppkey") % 5).alias("page"),
        F.col("s_suppkey").alias("version"), F.col("s_name").alias("value"),
    )
    return entities.either_update(c, s, "c_custkey", [["path"], ["figure", "page"]])


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS safe FROM supplier")
def path_safety(spark, sf_dir):
    p = F.element_at(F.array(F.lit("assets/a.png"), F.lit("assets/../b.png"), F.lit("etc/c.png")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", entities.safe_path(p, ["assets", "images"], ["png", "jpg"]).alias("safe"))


@query("SELECT conv_id, array_to_string(list(DISTINCT text ORDER BY text), '|') AS body, count(*) AS children FROM conversations WHERE turn < 0 GROUP BY conv_id UNION ALL SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY k), sum(n)::BIGINT FROM (SELECT conv_id, text, min(turn) AS k, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def parent_text(spark, sf_dir):
    """Distinct child texts in order of their first turn, joined by an empty line."""
    once = read(spark, sf_dir, "conversations").groupBy("conv_id", "text").agg(F.min("turn").alias("k"), F.count("*").alias("n"))
    lists = once.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("ts"), F.sum("n").alias("children"))
    return lists.select("conv_id", F.array_join(F.transform("ts", lambda x: x["text"]), "\n\n").alias("body"), "children")


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY l_orderkey")
def child_ids(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"))
    return li.select("l_orderkey", F.array_join(F.col("xs").cast("array<string>"), ",").alias("ids"))


RELEVANT = "rel AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {BM25_SQL}, {RELEVANT} SELECT rel.query_id, round(count(b.rank) / count(*), 6)::DOUBLE AS recall FROM rel LEFT JOIN (SELECT * FROM bm_ranked WHERE rank <= 5) b ON b.query_id = rel.query_id AND b.doc_id = rel.doc_id GROUP BY rel.query_id")
def recall_at_k(spark, sf_dir):
    """Recall at 5 of BM25, where the documents that hold a question's whole text are the relevant ones."""
    q, d = questions(spark, sf_dir), read(spark, sf_dir, "documents")
    return evaluate.recall_at_k(retrieve.bm25(q, d, 5), anchored.contained(q, d), 5).withColumn("recall", F.round("recall", 6))


@query("SELECT source, count(*) AS n, round(avg((quality = 1)::INT), 3)::DOUBLE AS good, round(avg((toxic = 1)::INT), 3)::DOUBLE AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source")
def label_rates(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.rates(j, ["source"], {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality IS NULL) AS no_quality, count(*) FILTER (source IS NULL OR source = '') AS no_source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def completeness(spark, sf_dir):
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.completeness(j, ["lang"], ["quality", "source"])


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT (source, lang)) AS cells, count(DISTINCT sha1(text)) AS contents FROM documents")
def coverage_audit(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("source", "lang").alias("cells"), F.count_distinct(F.sha1("text")).alias("contents"))


@query("WITH m AS (SELECT source, avg(n_chars) FILTER (lang = 'en') AS base, avg(n_chars) FILTER (lang <> 'en') AS other FROM documents GROUP BY source) SELECT source, round(CASE WHEN base = 0 THEN 0 ELSE (other - base) / base * 100 END, 4)::DOUBLE AS delta FROM m")
def ab_delta(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("source").agg(
        F.avg(F.when(F.col("lang") == "en", F.col("n_chars"))).alias("base"), F.avg(F.when(F.col("lang") != "en", F.col("n_chars"))).alias("other"),
    )
    return d.select("source", F.round(evaluate.delta_percent(F.col("base"), F.col("other")), 4).alias("delta"))


@query("SELECT doc_id, (CASE WHEN n_chars > 2000 THEN 30 ELSE 0 END + CASE WHEN lang <> 'en' THEN 20 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END)::INT AS score, array_to_string(list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents")
def caption_queue(spark, sf_dir):
    s = evaluate.scored({"long": (30, F.col("n_chars") > 2000), "foreign": (20, F.col("lang") != "en"), "even": (5, F.col("doc_id") % 2 == 0)})
    return read(spark, sf_dir, "documents").select("doc_id", s["score"].alias("score"), s["reasons"].alias("reasons"))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def source_list(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return d.select("lang", F.array_join("s", ",").alias("sources"))


@query("SELECT conv_id, min(turn) AS turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5 GROUP BY conv_id, role")
def citation_list(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 5")
    return c.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    out = windows.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])
    return out.select("start", "event_type", "n", "total")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN epoch(ts) - epoch(before) < 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "start", "n")


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def sliding_counts(spark, sf_dir):
    return windows.sliding(read(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes").select("start", "n")
