"""Registered queries: payloads, visual assets, boosts, captions, charts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import understand
from ..operators import assets, chunking, entities, retrieve
from .catalogue_retrieval import BM25_SQL, questions
from .probes import ASKED_SQL, asked, quoted
from .registry import query, read

G = quoted


@query("SELECT page_id, left(CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN html ELSE 'p' || page_id END, 500) AS page, CASE WHEN page_id % 2 = 0 THEN left(url, 500) ELSE 'unknown.csv' END AS source, CASE WHEN page_id % 2 = 0 THEN CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'unknown' END ELSE 'csv' END AS source_type FROM pages")
def payload_normalise(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    k = F.col("page_id") % 3
    raw = F.create_map(
        F.lit("page_no"), F.when(k == 0, F.col("url")).otherwise(""), F.lit("page"), F.when(k == 1, F.col("html")), F.lit("source_page"),
        F.concat(F.lit("p"), "page_id"), F.lit("filename"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("unknown.csv"),
    )
    out = assets.payload(raw)
    return p.select("page_id", out["page"].alias("page"), out["source"].alias("source"), understand.source_type(F.lit(None).cast("string"), out["source"]).alias("source_type"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) < 3 THEN true ELSE false END AS low_value,
 lang <> 'fr' AND n_chars / 10000 >= 0.3 AND NOT (doc_id % 3 = 0) AND NOT (lang = 'en' AND doc_id % 3 = 1) AS gated FROM documents""")
def visual_gates(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    low = assets.low_value_visual(F.col("text"), none, F.when(F.col("doc_id") % 2 == 1, F.lit("caption")))
    quality = F.when(F.col("doc_id") % 3 == 0, "chart_expanded_low_quality").when(F.col("doc_id") % 3 == 1, "figure_layout_region_accepted")
    gate = assets.visual_gate(F.when(F.col("lang") == "fr", "paragraph").when(F.col("lang") == "en", "figure").otherwise("chart"), F.col("n_chars") / 10000, quality)
    return d.select("doc_id", low.alias("low_value"), gate.alias("gated"))


_RWORD = "list_distinct(regexp_extract_all(lower({0}), '{1}'))"
_TAB = "[" + ", ".join(f"'{w}'" for w in assets.TABULAR_WORDS) + "]"
_TSTOP = "[" + ", ".join(f"'{w}'" for w in assets.TABULAR_STOPWORDS) + "]"
_RSTOP = "[" + ", ".join(f"'{w}'" for w in assets.RELEVANCE_STOPWORDS) + "]"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, u.text || CASE WHEN a.turn % 2 = 0 THEN ' Table ' || a.conv_id ELSE '' END AS asked, a.text || CASE WHEN a.conv_id % 3 = 0 THEN ' table ' || a.conv_id ELSE '' END AS said FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1),
w AS (SELECT *, {_RWORD.format('asked', '[a-z0-9_-]+')} AS own, {_RWORD.format('said', '[a-z0-9_-]+')} AS here, list_filter({_RWORD.format('asked', '[a-z][a-z0-9_-]{2,}')}, lambda x: NOT list_contains({_RSTOP}, x)) AS meaning, {_RWORD.format('said', '[a-z][a-z0-9_-]{2,}')} AS words FROM p)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN list_has_any(CASE WHEN list_has_any(own, {_TAB}) THEN list_intersect(own, {_TAB}) ELSE list_filter(own, lambda x: NOT list_contains({_TSTOP}, x) AND length(x) > 2) END, here) OR (regexp_matches(asked, '[0-9]') AND regexp_matches(said, '[0-9]'))
 WHEN 1 THEN conv_id % 2 = 0 ELSE CASE WHEN turn % 2 = 0 THEN contains(lower(said), 'table ' || conv_id) ELSE list_has_any(meaning, words) END END AS relevant FROM w""")
def minimum_relevance(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    intent = F.element_at(F.array(F.lit("TABULAR_NUMERIC"), F.lit("ASSET_VISUAL"), F.lit("CONCEPTUAL_TEXTUAL")), (F.col("turn") % 3 + 1).cast("int"))
    p = c.join(u, ["conv_id", "turn"])
    label = F.concat(F.lit("Table "), F.col("conv_id"))
    asked_ = F.when(F.col("turn") % 2 == 0, F.concat("asked", F.lit(" "), label)).otherwise(F.col("asked"))
    said = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" "), F.lower(label))).otherwise(F.col("text"))
    labels = F.when(F.col("turn") % 2 == 0, F.array(label)).otherwise(F.array().cast("array<string>"))
    return p.select("conv_id", "turn", assets.relevant_enough(intent, asked_, said, F.col("conv_id") % 2 == 0, labels).alias("relevant"))


@query(f"WITH {BM25_SQL}, r AS (SELECT *, doc_id % 4 = 0 AS ok FROM bm_ranked WHERE rank <= 4), e AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS hit FROM r) SELECT query_id, doc_id FROM e WHERE ok OR NOT hit")
def prerank_filter(spark, sf_dir):
    """Only candidates of the asked asset, unless none is."""
    r = retrieve.bm25(questions(spark, sf_dir), read(spark, sf_dir, "documents"), 4)
    return assets.unless_empty(r, F.col("doc_id") % 4 == 0).select("query_id", "doc_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS figure, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS tbl, CASE WHEN c_custkey % 2 = 0 THEN 'img/figure_3_1.png' ELSE '' END AS bound FROM customer")
def asset_fields(spark, sf_dir):
    """Only the primary kind keeps its field; only paths named like the label stay."""
    c = read(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "figure").when(F.col("c_custkey") % 3 == 1, "tbl").otherwise("none")
    f = entities.exclusive_fields(kind, {"figure": F.col("c_name"), "tbl": F.col("c_mktsegment")})
    label = F.when(F.col("c_custkey") % 2 == 0, F.lit("Figure 3.1")).otherwise(F.lit("Table 9"))
    paths = F.array(F.lit("img/figure_3_1.png"), F.lit("img/figure_3_11.png"), F.lit("img/x.png"))
    return c.select("c_custkey", f["figure"].alias("figure"), f["tbl"].alias("tbl"), F.array_join(entities.bound_paths(paths, label), ",").alias("bound"))


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score + CASE WHEN contains(lower(text), 'er') THEN 25.0 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'summary|header') THEN 0.05 ELSE 0 END, 4) AS boosted FROM bm_ranked JOIN documents USING (doc_id) WHERE rank <= 5")
def score_boosts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    r = retrieve.bm25(questions(spark, sf_dir), d, 5).join(d.select("doc_id", "text"), "doc_id")
    return r.select("query_id", "doc_id", F.round(assets.boosted(F.col("score"), F.col("text"), F.lit(True), F.contains(F.lower("text"), F.lit("er"))), 4).alias("boosted"))


@query("""WITH w AS (SELECT item_id, text, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and')), lambda x: CASE WHEN length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END))) AS ws FROM benchmark),
c AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS low FROM conversations WHERE turn = 0)
SELECT item_id, conv_id, round(len(list_filter(ws, lambda x: contains(low, ' ' || x))) * 3.5, 2)::DOUBLE AS points FROM w JOIN c ON item_id = conv_id""")
def keyword_points(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", assets.query_words(F.col("text"), ["the", "and"]).alias("ws"))
    c = read(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", "text")
    return b.join(c, F.col("item_id") == F.col("conv_id")).select("item_id", "conv_id", F.round(assets.prefix_points(F.col("text"), F.col("ws")), 2).alias("points"))


@query("""WITH w AS (SELECT item_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and')), lambda x: CASE WHEN length(x) > 3 THEN regexp_replace(x, 's$', '') ELSE x END))) AS ws FROM benchmark),
c AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' main evidence (see 1).' WHEN 1 THEN ' this is a panel com-' ELSE '' END AS said FROM conversations),
n AS (SELECT *, ' ' || trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')) || ' ' AS low FROM c),
q AS (SELECT *, least(length(said) * 1000 / 10000.0::DOUBLE, 80) + CASE WHEN turn % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN regexp_matches(low, ' (main|summary|compliance|recommendations|typology|evidence) ') THEN 12 ELSE 0 END
 - CASE WHEN regexp_matches(low, ' (panel|yields|chapter|this is|based on|cannot convert) ') THEN 25 ELSE 0 END - CASE WHEN contains(said, ').') OR said LIKE '%com-' OR said LIKE '%sev-' THEN 18 ELSE 0 END AS quality FROM n)
SELECT item_id, turn, round(quality, 4) AS quality, round(quality * 0.05 + 10 * len(list_filter(CASE WHEN turn = 3 THEN [] ELSE ws END, lambda x: contains(low, ' ' || x))) + CASE WHEN turn = 3 THEN 1 ELSE 0 END, 4) AS points FROM w JOIN q ON item_id = conv_id""")
def topic_points(spark, sf_dir):
    """Quality of pictures (here turns of conversations) and their points for the question of the same number; the fourth turn is asked for nothing."""
    b = read(spark, sf_dir, "benchmark").select("item_id", assets.query_words(F.col("text"), ["the", "and"]).alias("ws"))
    c = read(spark, sf_dir, "conversations")
    said = F.concat("text", F.when(F.col("turn") % 3 == 0, " main evidence (see 1).").when(F.col("turn") % 3 == 1, " this is a panel com-").otherwise(""))
    c = c.select("conv_id", "turn", said.alias("said")).join(b, F.col("item_id") == F.col("conv_id"))
    quality = assets.visual_quality(F.length("said") * 1000, F.col("turn") % 2 == 0, F.col("said"))
    words = F.when(F.col("turn") == 3, F.slice("ws", 1, 0)).otherwise(F.col("ws"))
    return c.select("item_id", "turn", F.round(quality, 4).alias("quality"), F.round(assets.topic_points(F.col("said"), words, quality), 4).alias("points"))


@query("""WITH r AS (SELECT 'L' || (s_suppkey % 5) AS label, s_nationkey AS kind, s_name AS path, s_suppkey % 2 = 0 AS reg FROM supplier WHERE s_suppkey % 7 <> 0),
m AS (SELECT c_custkey, path, CASE WHEN 'L' || (c_custkey % 5) = r.label THEN 100 ELSE 20 END + CASE WHEN reg THEN 90 ELSE 0 END AS score FROM customer JOIN r ON kind = c_nationkey)
SELECT c_custkey, arg_max(path, (score, path)) AS path, max(score)::INT AS score FROM m GROUP BY c_custkey""")
def asset_resolution(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("L"), F.col("c_custkey") % 5).alias("label"), F.col("c_nationkey").alias("kind"))
    s = read(spark, sf_dir, "supplier")
    r = s.select(
        F.concat(F.lit("L"), F.col("s_suppkey") % 5).alias("label"), F.col("s_nationkey").alias("kind"), F.col("s_name").alias("path"),
        (F.col("s_suppkey") % 2 == 0).alias("registered"), (F.col("s_suppkey") % 7 != 0).alias("exists"),
    )
    return assets.resolved(c, r, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'locked' WHEN c_custkey % 3 = 0 THEN 'vision' WHEN c_custkey % 2 = 0 THEN 'pool' ELSE 'fallback' END AS image FROM customer")
def image_binding(spark, sf_dir):
    k = F.col("c_custkey")
    pick = assets.bound_image(F.when(k % 4 == 0, "locked"), F.when(k % 3 == 0, "vision").otherwise(" "), F.when(k % 2 == 0, "pool"), F.lit("fallback"))
    return read(spark, sf_dir, "customer").select("c_custkey", pick.alias("image"))


_CAP = "'Figure ' || (turn + 1) || '.' || conv_id || ': ' || text || ' Source: x'"


@query(f"""WITH c AS (SELECT conv_id, turn, {_CAP} AS cap FROM conversations) SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(regexp_replace(cap, '[ \\t\\n\\r\\f]+', ' ', 'g')), '(?i)^(?:figure|fig[.]?|table|chart|box|map)\\s+[0-9]+(?:[.][0-9]+)?[a-z]?\\s*[:.-]?\\s*', ''), '(?i)\\s*source:.*$', '')) AS clean, (turn + 1) || '.' || conv_id AS figure FROM c""")
def caption_clean(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("cap", F.expr(_CAP))
    return c.select("conv_id", "turn", assets.clean_caption(F.col("cap")).alias("clean"), assets.figure_of_caption(F.col("cap")).alias("figure"))


@query("""SELECT conv_id, turn, (100 - CASE WHEN length(text) < 40 THEN 30 ELSE 0 END - CASE WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 10 ELSE 0 END - CASE WHEN len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) * 2 < len(regexp_extract_all(lower(text), '[a-z0-9]+')) THEN 25 ELSE 0 END - CASE WHEN regexp_matches(text, '[#{}|]{2,}') THEN 20 ELSE 0 END)::INT AS score FROM conversations""")
def caption_scores(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", assets.caption_score(F.col("text")).alias("score"))


_ANCHORED = "CASE turn % 5 WHEN 1 THEN 'As Figure 2.' || conv_id || ' shows' WHEN 2 THEN 'Source: chart 3 of it' WHEN 3 THEN 'see www.example.org doi' ELSE text END"


@query(f"""WITH b AS (SELECT conv_id, turn, {_ANCHORED} AS t FROM conversations), n AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9.]+', ' ', 'g')) AS nt FROM b),
p AS (SELECT *, CASE WHEN contains(nt, 'figure 2.' || conv_id) THEN 10 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)\\b(?:figure|table|chart|diagram|image|map)\\s+[0-9]') THEN 3 ELSE 0 END + CASE WHEN contains(nt, 'chart') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)^(?:Source|Sources|Note|Notes)\\s*:\\s*.+$') THEN 1 ELSE 0 END AS pts,
 regexp_matches(t, '(?i)\\b(?:http|www\\.|reproducibility|replication|github|bibliography|references|copyright|doi|isbn|issn)\\b') AS boiler FROM n),
a AS (SELECT conv_id, arg_max(turn, (pts, -turn)) AS anchor FROM p GROUP BY conv_id), w AS (SELECT p.conv_id, turn, anchor, boiler, bool_or(NOT boiler) OVER (PARTITION BY p.conv_id) AS other FROM p JOIN a ON a.conv_id = p.conv_id WHERE abs(turn - anchor) <= 2)
SELECT conv_id, turn, anchor FROM w WHERE NOT boiler OR (NOT other AND turn = anchor)""")
def anchor_window(spark, sf_dir):
    """Blocks around the one that is most about a figure, without boilerplate."""
    c = read(spark, sf_dir, "conversations").withColumn("t", F.expr(_ANCHORED))
    points = assets.anchor_points(F.col("t"), F.concat(F.lit("Figure_2."), F.col("conv_id")), F.lit("chart"))
    return assets.best_anchor(c, "conv_id", "turn", points, boilerplate=F.col("t").rlike(assets.BOILERPLATE)).select("conv_id", "turn", "anchor")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE conv_id END AS a FROM conversations")
def json_fallbacks(spark, sf_dir):
    """Objects as they are, fenced, within prose, or none."""
    obj = F.concat(F.lit('{"a": '), F.col("conv_id").cast("string"), F.lit("}"))
    said = F.element_at(F.array(obj, F.concat(F.lit("so:\n```json\n"), obj, F.lit("\n```")), F.concat(F.lit("I say "), obj, F.lit(" ok")), F.lit("nothing")), (F.col("turn") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", assets.parsed_json(said, "a bigint")["a"].alias("a"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'GDP' ELSE c_mktsegment END AS series, CASE WHEN c_custkey % 2 = 0 THEN '2001' ELSE '1999' END AS category, (c_custkey * 1000)::DOUBLE AS value FROM customer")
def chart_rows(spark, sf_dir):
    k = F.col("c_custkey")
    value = F.concat(F.format_number(k * 1000, 0), F.lit("%"))
    row = F.when(k % 2 == 0, F.create_map(F.lit("line"), F.lit("2001"), F.lit("label"), F.lit("GDP"), F.lit("y"), value)).otherwise(F.create_map(F.lit("series"), F.col("c_mktsegment"), F.lit("year"), F.lit("1999"), F.lit("value"), value))
    r = assets.chart_row(row)
    return read(spark, sf_dir, "customer").select("c_custkey", r["series"].alias("series"), r["category"].alias("category"), r["value"].alias("value"))


@query(f"""WITH {ASKED_SQL} SELECT query_id, CASE WHEN regexp_matches(lower(text), 'scatter') THEN 'scatter' WHEN regexp_matches(lower(text), 'bar') THEN 'bar' WHEN regexp_matches(lower(text), 'line|trend') THEN 'line' WHEN regexp_matches(lower(text), 'pie|share') THEN 'pie' ELSE 'table' END AS kind,
 coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '\\b(?:figure|table|chart)\\b'))[1]), '') AS title, regexp_matches(lower(text), '\\b(?:compare|comparison|versus|vs|difference between|higher than|lower than)\\b') AS comparative FROM asked""")
def chart_inference(spark, sf_dir):
    c = assets.chart_of(F.col("text"))
    return asked(spark, sf_dir).select("query_id", c["kind"].alias("kind"), F.coalesce(c["title"], F.lit("")).alias("title"), understand.comparative(F.col("text")).alias("comparative"))


@query("""WITH t AS (SELECT lang, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 END AS e, list_filter([CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END, CASE WHEN doc_id % 3 = 0 THEN (doc_id + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END) % 7 END], lambda x: x IS NOT NULL) AS r FROM documents)
SELECT lang, count(*) AS n, round(avg(coalesce(r[1] = e, false)::INT), 3)::DOUBLE AS top1, round(avg(coalesce(list_contains(r, e), false)::INT), 3)::DOUBLE AS hit, coalesce(round(avg(CASE WHEN e IS NOT NULL THEN list_contains(r, e)::INT END), 3), 0)::DOUBLE AS expected_hit, round(avg((e IS NULL AND len(r) > 0)::INT), 3)::DOUBLE AS false_positive, round(avg((len(r) = 0)::INT), 3)::DOUBLE AS no_match, round(avg((len(list_distinct(r)) < len(r))::INT), 3)::DOUBLE AS repeated FROM t GROUP BY lang""")
def visual_rates(spark, sf_dir):
    k = F.col("doc_id")
    returned = F.array_compact(F.array(F.when(k % 2 == 0, k % 7), F.when(k % 3 == 0, (k + F.when(k % 4 == 0, 0).otherwise(1)) % 7)))
    d = read(spark, sf_dir, "documents").select("lang", F.when(k % 5 > 0, k % 7).alias("expected"), returned.alias("returned"))
    return assets.visual_rates(d, ["lang"])


@query("""WITH p AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 5))[1:10] AS ws0 FROM documents WHERE doc_id < 0) SELECT doc_id, 0::BIGINT AS page FROM p
UNION ALL SELECT doc_id, min(page) FROM (SELECT a.doc_id, a.need, b.page, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w, greatest(2, least(4, len(ws))) AS need FROM (SELECT doc_id, list(w ORDER BY k)[1:10] AS ws FROM (SELECT doc_id, w, min(k) AS k FROM (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)) WHERE length(w) >= 5 GROUP BY ALL) GROUP BY doc_id)) a
JOIN (SELECT DISTINCT doc_id, k // 50 AS page, w FROM (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents))) b ON a.doc_id = b.doc_id AND a.w = b.w GROUP BY ALL) WHERE n >= need GROUP BY doc_id""")
def page_inference(spark, sf_dir):
    """Pages of 50 words each; the page a document's first long words point to."""
    from ..functions.text import tokens

    d = read(spark, sf_dir, "documents")
    words = d.select("doc_id", tokens(F.col("text")).alias("t")).filter("size(t) > 0")
    pages = words.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 50))).alias("page")).select(
        "doc_id", F.col("page").cast("long").alias("page"),
        F.array_join(F.slice("t", (F.col("page") * 50 + 1).cast("int"), 50), " ").alias("page_text"),
    )
    return assets.pages_of(d.select("doc_id", F.lit(1).alias("one"), "text"), pages.withColumnRenamed("doc_id", "doc_id"), "doc_id", "one").select("doc_id", "page")


@query()
def token_packing(spark, sf_dir):
    """Lines packed into chunks of at most 100 words: an ordered fold, tested against a plain restatement."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(assets.packed_tokens(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 100)).alias("part", "body"))


@query()
def isolated_mentions(spark, sf_dir):
    """Stretches around each mention of a label, merged where they overlap; tested against a plain restatement."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", assets.isolated(F.col("text"), "er", 20).alias("stretches"), chunking.without_brackets(F.col("text")).alias("plain"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('de', 'fr') GROUP BY ALL")
def manifest_counts(spark, sf_dir):
    """What a namespace holds, by source; the filter is on the partition column."""
    return read(spark, sf_dir, "documents").filter(understand.filter_from({"lang": ["de", "fr"]})).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
