"""Registered queries: redaction, scans, budgets, grounding, verdicts, query understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guard, text, understand
from .probes import ASKED_SQL, asked, quoted
from .registry import query, read

G = quoted


def _any(patterns) -> str:
    return f"regexp_matches(text, {G(guard.any_of(patterns))})"


def _redacted_sql(upto: int = 3, c: str = "text") -> str:
    for pattern, token in guard.REDACTIONS[:upto]:
        c = f"regexp_replace({c}, {G(pattern)}, {G(token)}, 'g')"
    return c


_COUNT = " + ".join(f"len(regexp_extract_all({_redacted_sql(k)}, {G(guard.REDACTIONS[k][0])}))" for k in range(3))


@query(f"WITH {ASKED_SQL} SELECT query_id, {_redacted_sql()} AS clean, CAST({_COUNT} AS BIGINT) AS hits FROM asked")
def pii_redact(spark, sf_dir):
    a = asked(spark, sf_dir)
    return a.select("query_id", guard.redacted(F.col("text"), phones=False).alias("clean"), guard.redaction_count(F.col("text"), phones=False).alias("hits"))


@query(f"SELECT doc_id, {_redacted_sql()} AS clean, CAST({_COUNT} AS BIGINT) AS hits FROM documents")
def pii_redact_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", guard.redacted(F.col("text"), phones=False).alias("clean"), guard.redaction_count(F.col("text"), phones=False).alias("hits"))


@query()
def pii_redact_phone(spark, sf_dir):
    """All four patterns; the phone pattern looks around, which the check's engine can't."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", guard.redacted(F.col("text")).alias("clean"), guard.redaction_count(F.col("text")).alias("hits"))


_MARKS = " + ".join(f"(length(text) - length(replace(text, {G(m)}, ''))) / {len(m)}" for m in guard.MARKERS)


@query(f"WITH {ASKED_SQL} SELECT query_id, {_any(guard.INJECTION)} OR ({_MARKS}) >= 2 AS injected, {_any(guard.DATA_LEAK)} AS data_leak, {_any(guard.PROMPT_LEAK)} AS prompt_leak FROM asked")
def scan_flags(spark, sf_dir):
    t = F.col("text")
    return asked(spark, sf_dir).select("query_id", guard.injected(t).alias("injected"), guard.data_leak(t).alias("data_leak"), guard.prompt_leak(t).alias("prompt_leak"))


_WORDS = "len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))"
_EST = f"greatest(1, {_WORDS}, CAST(ceil(length(text) / 4) AS BIGINT))"


@query(f"WITH {ASKED_SQL} SELECT query_id, CAST({_EST} AS BIGINT) AS tokens, length(text) > 2000 AS too_long, {_EST} > 500 AS too_many FROM asked")
def budget_flags(spark, sf_dir):
    t = F.col("text")
    return asked(spark, sf_dir).select("query_id", text.token_estimate(t).alias("tokens"), guard.over_length(t).alias("too_long"), guard.over_tokens(t).alias("too_many"))


@query(f"""WITH {ASKED_SQL}, w AS (SELECT query_id, trim(text) AS t, regexp_extract_all(lower(trim(text)), '[a-z0-9][a-z0-9_.-]*') AS ws FROM asked),
m AS (SELECT *, len(ws) AS n, coalesce(list_max(map_values(list_histogram(ws))), 0) AS most, len(list_distinct(ws)) AS d, len(list_filter(ws, lambda w: length(w) >= 3 AND regexp_matches(w, '[a-z]') AND length(replace(w, w[1], '')) > 0)) AS good FROM w)
SELECT query_id, coalesce(CASE WHEN t = '' THEN 'empty' WHEN n = 0 THEN 'no_tokens' WHEN n < 8 AND length(t) < 80 THEN NULL WHEN most >= 0.7 * n THEN 'dominant' WHEN n >= 25 AND d < 0.15 * n THEN 'few_distinct' WHEN good < 0.2 * n THEN 'few_meaningful' END, 'fine') AS content FROM m""")
def semantic_content(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.coalesce(guard.weak_content(F.col("text"), runs=False), F.lit("fine")).alias("content"))


@query()
def semantic_content_runs(spark, sf_dir):
    """With the test for repeated characters, a back-reference that the check's engine lacks."""
    return asked(spark, sf_dir).select("query_id", F.coalesce(guard.weak_content(F.col("text")), F.lit("fine")).alias("content"))


_EXH = f"len(regexp_extract_all(text, {G('(?i)' + guard.EXHAUSTIVE)}))"
_LONG = f"coalesce(list_max(list_transform(regexp_extract_all(text, {G('(?i)' + guard.LARGE_OUTPUT)}, 1), lambda x: CAST(replace(x, ',', '') AS BIGINT))) > 3000, false)"


@query(f"""WITH {ASKED_SQL} SELECT query_id, (regexp_matches(text, {G('(?i)' + guard.WHOLE_DOCUMENT)}) AND ({_EXH} >= 2 OR {_LONG})) OR (regexp_matches(text, {G('(?i)' + guard.BROAD)}) AND {_LONG} AND {_EXH} >= 2)
 OR regexp_matches(text, {G('(?i)' + guard.WHOLE_CHAPTER)}) OR regexp_matches(text, {G('(?i)' + guard.CHAPTER_DUMP)}) AS too_broad FROM asked""")
def retrieval_coverage(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", guard.over_coverage(F.col("text")).alias("too_broad"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.ANSWER_STOPWORDS) + "]"


def _content(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z][a-z0-9_-]{{2,}}')), lambda x: NOT list_contains({_STOP}, x))"


PAIRS_SQL = f"pairs AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS question, {_content('a.text')} AS a, {_content('u.text')} AS u FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')"


def answers(spark, sf_dir):
    """Assistant turns beside the user turn before them."""
    c = read(spark, sf_dir, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return a.join(u, ["conv_id", "turn"])


@query(f"WITH {PAIRS_SQL}, f AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN NULL WHEN len(u) = 0 THEN 1.0 ELSE len(list_intersect(a, u)) / len(a) END AS v FROM pairs) SELECT conv_id, turn, round(coalesce(v, -1), 6)::DOUBLE AS faithful, coalesce(v, -1) < 0.4 AS violated FROM f")
def faithfulness(spark, sf_dir):
    v = F.coalesce(guard.faithfulness(F.col("answer"), F.col("question")), F.lit(-1.0))
    return answers(spark, sf_dir).select("conv_id", "turn", F.round(v, 6).alias("faithful"), (v < guard.FAITHFUL).alias("violated"))


@query(f"""WITH {PAIRS_SQL}, j AS (SELECT conv_id, turn, a, u FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(u) = 0 THEN 1 ELSE len(list_intersect(u, a)) / len(u) END, 6)::DOUBLE AS answer_relevance,
 round(CASE WHEN len(list_distinct(list_concat(a, u))) = 0 THEN 0 ELSE len(list_intersect(a, u)) / len(list_distinct(list_concat(a, u))) END, 6)::DOUBLE AS jaccard FROM j""")
def rag_triad(spark, sf_dir):
    a, u = text.content_tokens(F.col("answer")), text.content_tokens(F.col("question"))
    return answers(spark, sf_dir).select("conv_id", "turn", F.round(text.overlap(u, a), 6).alias("answer_relevance"), F.round(text.jaccard(a, u), 6).alias("jaccard"))


_QUOTING = "'He said \"' || CASE turn % 3 WHEN 0 THEN replace(replace(text, '\"', ''), chr(10), ' ') WHEN 1 THEN translate(replace(replace(text, '\"', ''), chr(10), ' '), 'aeiou', 'AEIOU') ELSE 'words of nobody ' || conv_id END || '\" and \"abc\"'"


@query(f"""WITH s AS (SELECT conv_id, turn, text, {_QUOTING} AS said FROM conversations), q AS (SELECT conv_id, turn, text, unnest(regexp_extract_all(said, {G(guard.QUOTE)}, 1)) AS quote FROM s)
SELECT conv_id, turn, quote, contains(text, quote) AS exact, contains(lower(text), lower(quote)) AS anchored FROM q""")
def quote_anchor(spark, sf_dir):
    """Quotes of true, of shouted and of made-up words, against the turn they are said to be from."""
    s = read(spark, sf_dir, "conversations").withColumn("said", F.expr(_QUOTING.replace("chr(10)", "char(10)")))
    q = s.select("conv_id", "turn", "text", F.explode(guard.quotes(F.col("said"))).alias("quote"))
    return q.select("conv_id", "turn", "quote", F.contains("text", "quote").alias("exact"), F.contains(F.lower("text"), F.lower("quote")).alias("anchored"))


@query(f"""WITH {PAIRS_SQL}, n AS (SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '[0-9]+(?:[.][0-9]+)?'), lambda x: x::DOUBLE) AS a, list_transform(regexp_extract_all(question, '[0-9]+(?:[.][0-9]+)?'), lambda x: x::DOUBLE) AS q FROM pairs)
SELECT conv_id, turn, len(list_filter(a, lambda v: len(list_filter(q, lambda x: abs(x - v) < 0.0001)) = 0)) = 0 AS close FROM n""")
def numeric_anchor(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", guard.numbers_close(F.col("answer"), F.col("question")).alias("close"))


@query()
def entity_extract(spark, sf_dir):
    """Facts that an answer states; the patterns look around, which the check's engine can't. Tests restate them."""
    return asked(spark, sf_dir).select("query_id", F.explode(guard.entities(F.col("text"))).alias("entity"))


@query("SELECT vec_id, list_sort([abs(embedding[1]), abs(embedding[2])]) = [abs(embedding[1]), abs(embedding[2])] AND abs(embedding[3]) <= abs(embedding[4]) IS NOT NULL AND abs(embedding[1]) <= abs(embedding[3]) AND abs(embedding[2]) <= abs(embedding[4]) AS valid FROM embeddings")
def bbox_valid(spark, sf_dir):
    box = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x))
    ordered = box[0] <= box[1]
    return read(spark, sf_dir, "embeddings").select("vec_id", (ordered & guard.valid_box(box)).alias("valid"))


_OPEN = {m: f"((length(text) - length(replace(text, {G(m)}, ''))) // {len(m)})" for m in ("**", "`", "[", "]", "(", ")")}


_ROW = "CASE WHEN starts_with({0}, '|') OR length({0}) - length(replace({0}, '|', '')) >= 2 THEN trim(regexp_replace(CASE WHEN starts_with({0}, '|') THEN '' ELSE '| ' END || {0} || CASE WHEN ends_with({0}, '|') THEN '' ELSE ' |' END, '\\s*\\|\\s*', ' | ', 'g')) ELSE x END".replace(
    "{0}", "trim(x, ' ' || chr(9))",
)
_TABLED = "text || CASE query_id % 4 WHEN 0 THEN chr(10) || 'a | b|c' || chr(10) || '|--|' WHEN 1 THEN ' one | pipe' WHEN 2 THEN chr(10) || '  |x' ELSE '' END"


@query(f"""WITH {ASKED_SQL}, t AS (SELECT query_id, {_TABLED} AS text FROM asked), r AS (SELECT query_id, text || CASE WHEN {_OPEN['**']} % 2 = 1 THEN '**' ELSE '' END || CASE WHEN {_OPEN['`']} % 2 = 1 THEN '`' ELSE '' END
 || repeat(']', greatest({_OPEN['[']} - {_OPEN[']']}, 0)) || repeat(')', greatest({_OPEN['(']} - {_OPEN[')']}, 0)) AS r FROM t), l AS (SELECT query_id, string_split(r, chr(10)) AS ls FROM r)
SELECT query_id, array_to_string(list_transform(CASE WHEN len(ls) > 1 AND ls[-1] = '' THEN ls[:-2] ELSE ls END, lambda x: {_ROW}), chr(10)) AS repaired FROM l""")
def markdown_repair(spark, sf_dir):
    t = asked(spark, sf_dir).withColumn("text", F.expr(_TABLED.replace("chr(10)", "char(10)")))
    return t.select("query_id", guard.repaired_markdown(F.col("text")).alias("repaired"))


_LAYERS = (
    ("injection", True, f"{_any(guard.INJECTION)} OR ({_MARKS}) >= 2"),
    ("budget", True, f"length(text) > 2000 OR {_EST} > 500"),
    ("content", False, "trim(text) = ''"),
    ("paths", True, "query_id % 17 = 3"),
    ("markdown", True, "query_id % 13 = 5"),
    ("prompt_leak", True, _any(guard.PROMPT_LEAK)),
    ("data_leak", True, _any(guard.DATA_LEAK)),
)
_FAILED = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, critical, c in _LAYERS if critical) + " ELSE 'none' END"
_WARNED = " OR ".join(f"({c})" for _, critical, c in _LAYERS if not critical)


@query(f"WITH {ASKED_SQL} SELECT query_id, {_FAILED} AS failed, CASE WHEN {_FAILED} <> 'none' THEN 0.0 WHEN {_WARNED} THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM asked")
def gauntlet_verdict(spark, sf_dir):
    """Layers that SQL can say, in their order: critical ones short-circuit, warnings cap the confidence."""
    t = F.col("text")
    holds = {
        "injection": guard.injected(t), "budget": guard.over_length(t) | guard.over_tokens(t), "content": F.trim(t) == "", "paths": F.col("query_id") % 17 == 3,
        "markdown": F.col("query_id") % 13 == 5, "prompt_leak": guard.prompt_leak(t), "data_leak": guard.data_leak(t),
    }
    v = guard.verdict([(n, critical, holds[n]) for n, critical in guard.LAYERS.items() if n in holds])
    return asked(spark, sf_dir).select("query_id", F.coalesce(v["failed_layer"], F.lit("none")).alias("failed"), v["confidence"].alias("confidence"))


@query()
def gauntlet_full(spark, sf_dir):
    """All thirteen layers on answers of the conversations, with payloads of paths and boxes; tests say the verdicts of each layer."""
    a = answers(spark, sf_dir)
    box = F.when(F.col("turn") % 3 == 0, F.array(*map(F.lit, (0.1, 0.2, 0.7, 0.9)))).otherwise(F.array(*map(F.lit, (0.9, 0.2, 0.7, 0.9))))
    path = F.when(F.col("turn") % 5 == 0, "img/none.png").otherwise("img/a.png")
    json = F.to_json(F.struct(F.struct(path.alias("image_path"), F.array(box).alias("boxes")).alias("metadata")))
    h = guard.harvested(json)
    v = guard.gauntlet(F.col("question"), F.col("answer"), F.concat_ws("\n", "answer", "question"), h["paths"], F.array(F.lit("img/a.png")), h["boxes"], F.lit(True), F.col("turn") < 100)
    return a.select("conv_id", "turn", F.coalesce(v["failed_layer"], F.lit("none")).alias("failed"), v["warnings"].alias("warnings"), v["confidence"].alias("confidence"))


@query("""SELECT conv_id, turn, CASE WHEN json_valid(j) THEN CASE WHEN json_extract(j, '$.answer') IS NULL THEN 'missing_answer' WHEN json_type(j, '$.answer') <> 'VARCHAR' THEN 'type_answer' WHEN json_type(j, '$.sources') IS NULL THEN 'missing_sources' WHEN json_type(j, '$.sources') <> 'ARRAY' THEN 'type_sources' ELSE 'ok' END ELSE 'not_json' END AS fault
FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '{"answer": "a", "sources": ["s"]}' WHEN 1 THEN '{"answer": 3, "sources": ["s"]}' WHEN 2 THEN '{"sources": []}' WHEN 3 THEN 'plain' ELSE '{"answer": "a", "sources": "s"}' END AS j FROM conversations)""")
def output_schema(spark, sf_dir):
    j = F.element_at(
        F.array(*[F.lit(x) for x in ('{"answer": "a", "sources": ["s"]}', '{"answer": 3, "sources": ["s"]}', '{"sources": []}', "plain", '{"answer": "a", "sources": "s"}')]),
        (F.col("turn") % 5 + 1).cast("int"),
    )
    c = read(spark, sf_dir, "conversations").withColumn("j", j)
    return c.select("conv_id", "turn", F.coalesce(guard.schema_fault(F.col("j"), {"answer": "STRING", "sources": "ARRAY"}), F.lit("ok")).alias("fault"))


@query("WITH c AS (SELECT *, text || ' [REDACTED_EMAIL] [REDACTED_SSN]' AS src, CASE WHEN turn % 2 = 0 THEN text || ' [REDACTED_SSN]' ELSE text END AS ans FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[REDACTED_EMAIL]' ELSE '[REDACTED_EMAIL],[REDACTED_SSN]' END AS lost FROM c")
def carried_markers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    src = F.concat("text", F.lit(" [REDACTED_EMAIL] [REDACTED_SSN]"))
    ans = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" [REDACTED_SSN]"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.array_join(guard.carried_markers(ans, src), ",").alias("lost"))


_N = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_TOKS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NUMERICAL = f"(regexp_matches(text, '[0-9]') OR list_has_any({_TOKS}, {_list(understand.NUMERICAL)}))"
_EXPLAIN = f"(list_has_any({_TOKS}, {_list(understand.EXPLANATORY)}) OR (regexp_matches(lower(text), '^what (is|are) ') AND NOT {_NUMERICAL}))"


@query(f"WITH {ASKED_SQL} SELECT query_id, CASE WHEN {_NUMERICAL} AND {_EXPLAIN} THEN 'mixed' WHEN {_NUMERICAL} THEN 'numerical' WHEN {_EXPLAIN} THEN 'explanatory' ELSE 'balanced' END AS intent FROM asked")
def query_intent(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", understand.intent(F.col("text")).alias("intent"))


@query(f"""WITH {ASKED_SQL} SELECT query_id, CASE WHEN regexp_matches(lower(text), '{understand.ASSET_WORDS}') THEN 'ASSET_VISUAL' WHEN regexp_matches(lower(text), '{understand.TABLE_WORDS}') THEN 'TABULAR_NUMERIC' ELSE 'CONCEPTUAL_TEXTUAL' END AS structural,
 CASE WHEN regexp_matches(lower(text), '{understand.CSV_MARKERS}') AND regexp_matches(lower(text), '{understand.TEXT_MARKERS}') THEN 'COMBINED' WHEN regexp_matches(lower(text), '{understand.CSV_MARKERS}') THEN 'CSV-ONLY' ELSE 'TEXT/VISUAL-ONLY' END AS orchestrated FROM asked""")
def structural_route(spark, sf_dir):
    t = F.col("text")
    return asked(spark, sf_dir).select("query_id", understand.structural_intent(t).alias("structural"), understand.orchestrated(t)["route"].alias("orchestrated"))


_YEARS = "list_distinct(regexp_extract_all(text, '\\b((?:19|20)[0-9]{2})\\b', 1))"
_METRICS = f"list_filter([CASE WHEN contains({_N}, 'gdp') THEN 'gdp' END, CASE WHEN regexp_matches({_N}, 'co2|carbon dioxide|emission') THEN 'co2' END], lambda x: x IS NOT NULL)"
_TOPIC = f"CASE WHEN regexp_matches({_N}, 'regulation|regulatory') THEN 'regulations' WHEN contains({_N}, 'standard') THEN 'standards' WHEN regexp_matches({_N}, 'emission|co2') THEN 'emissions' WHEN regexp_matches({_N}, 'growth|gdp') THEN 'growth' ELSE '' END"


@query(f"WITH {ASKED_SQL} SELECT query_id, coalesce(CASE WHEN len({_YEARS}) = 1 THEN {_YEARS}[1] END, '') AS year, array_to_string({_METRICS}, ',') AS metrics, {_TOPIC} AS topic FROM asked")
def constraints_of_question(spark, sf_dir):
    t = F.col("text")
    return asked(spark, sf_dir).select(
        "query_id", F.coalesce(understand.year(t), F.lit("")).alias("year"), F.array_join(understand.metrics(t), ",").alias("metrics"),
        understand.topic(t).alias("topic"),
    )


_SHAPED = f"(regexp_matches({_N}, 'gdp|co2|carbon dioxide|emission') AND regexp_matches({_N}, '[0-9]'))"
_VIS = f"list_has_any(string_split({_N}, ' '), {_list(understand.VISUAL)})"
_EXP = f"regexp_matches({_N}, '{'|'.join(understand.ROUTE_EXPLANATORY)}')"
_HAS = f"(len({_YEARS}) = 1 AND len({_METRICS}) > 0)"
_STRUCT = f"({_HAS} OR ({_SHAPED} AND NOT {_EXP} AND NOT {_VIS}))"


@query(f"""WITH {ASKED_SQL} SELECT query_id, CASE WHEN {_SHAPED} AND NOT {_HAS} AND NOT {_EXP} AND NOT {_VIS} THEN 'structured' WHEN {_STRUCT} AND ({_EXP} OR {_VIS} OR NOT {_SHAPED}) THEN 'hybrid' WHEN {_STRUCT} THEN 'structured' WHEN {_VIS} THEN 'visual' ELSE 'pdf' END AS route FROM asked""")
def query_route(spark, sf_dir):
    t = F.col("text")
    has = understand.year(t).isNotNull() & (F.size(understand.metrics(t)) > 0)
    return asked(spark, sf_dir).select("query_id", understand.route(t, has).alias("route"))


@query(f"""WITH {ASKED_SQL} SELECT query_id, CASE WHEN len({_YEARS}) = 1 AND len({_METRICS}) > 0 AND NOT regexp_matches({_N}, 'explain|why|how|describe') THEN 'structured_exact' WHEN regexp_matches(text, {G(understand.ENTITY)}) THEN 'visual_exact' WHEN {_VIS} THEN 'visual_semantic' WHEN len(string_split({_N}, ' ')) <= 3 THEN 'hybrid_short' ELSE 'text_semantic' END AS namespace FROM asked""")
def namespace_route(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", understand.namespace_route(F.col("text")).alias("namespace"))


@query(f"""WITH {ASKED_SQL}, e AS (SELECT query_id, regexp_extract_all(text, {G(understand.ENTITY)}, 1) AS ks, regexp_extract_all(text, {G(understand.ENTITY)}, 2) AS ids FROM asked),
x AS (SELECT query_id, unnest(ks) AS k, unnest(ids) AS i, generate_subscripts(ks, 1) AS n FROM e)
SELECT query_id, label FROM (SELECT query_id, CASE WHEN lower(k) LIKE 'fig%' THEN 'Figure' ELSE upper(k[1]) || lower(k[2:]) END || '_' || upper(i) AS label, n FROM x) GROUP BY ALL HAVING true""".replace(", n FROM x) GROUP BY ALL HAVING true", " FROM x) GROUP BY ALL"))
def entity_labels(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.explode(understand.entity_labels(F.col("text"))).alias("label"))


@query(f"""WITH {ASKED_SQL}, h AS (SELECT query_id, nullif(regexp_extract({_N}, '\\bpage ([0-9]{{1,4}})\\b', 1), '') AS page, nullif(regexp_extract(text, '(?i)([A-Za-z0-9_-]+[.]pdf)', 1), '') AS file, CASE WHEN len({_YEARS}) = 1 THEN {_YEARS}[1] END AS year, CASE WHEN len({_METRICS}) = 1 THEN {_METRICS}[1] END AS metric, nullif({_TOPIC}, '') AS topic, CASE WHEN regexp_matches(text, {G(understand.ENTITY)}) THEN 1 END AS fig, CASE WHEN len(list_filter(['India', 'China', 'New Delhi'], lambda x: contains(' ' || {_N} || ' ', ' ' || lower(x) || ' '))) = 1 THEN list_filter(['India', 'China', 'New Delhi'], lambda x: contains(' ' || {_N} || ' ', ' ' || lower(x) || ' '))[1] END AS country, CASE WHEN query_id % 2 = 0 THEN 1 END AS vis FROM asked),
s AS (SELECT *, 1 + (page IS NOT NULL)::INT + (file IS NOT NULL)::INT + (year IS NOT NULL)::INT + (metric IS NOT NULL)::INT + (topic IS NOT NULL)::INT + (fig IS NOT NULL)::INT + (country IS NOT NULL)::INT + (vis IS NOT NULL)::INT AS n FROM h)
SELECT query_id, coalesce(country, '') AS country, coalesce(page, '') AS page, coalesce(file, '') AS file, coalesce(metric, '') AS metric, CASE WHEN n = 1 THEN 0.25 ELSE round(greatest(n / 9, 0.35), 2) END::DOUBLE AS confidence FROM s""")
def self_query_hints(spark, sf_dir):
    h = understand.hints(F.col("text"), ["India", "China", "New Delhi"], F.col("query_id") % 2 == 0)
    blank = lambda c: F.coalesce(h[c], F.lit("")).alias(c)
    return asked(spark, sf_dir).select("query_id", blank("country"), blank("page"), blank("file"), blank("metric"), h["confidence"].alias("confidence"))


_CHAPTERS = "CASE c_custkey % 5 WHEN 0 THEN 'see Chapter ' || c_custkey || ' there' WHEN 1 THEN c_name || ' in chapter VIII and chapter 2' WHEN 2 THEN 'CHAPTER ix' WHEN 3 THEN 'chapters 3' ELSE 'chapter  ' || c_nationkey || '.' END"


@query(f"""WITH c AS (SELECT c_custkey, nullif(lower(regexp_extract({_CHAPTERS}, '(?i)\\bchapter\\s+([0-9]{{1,3}}|[ivx]+)\\b', 1)), '') AS s FROM customer)
SELECT c_custkey, CAST(coalesce(TRY_CAST(s AS INT), MAP {{'i':1,'ii':2,'iii':3,'iv':4,'v':5,'vi':6,'vii':7,'viii':8,'ix':9,'x':10}}[s]) AS BIGINT) AS chapter FROM c WHERE s IS NOT NULL""")
def chapter_filter(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", understand.chapter(F.expr(_CHAPTERS)).cast("long").alias("chapter"))
    return c.filter("chapter is not null")


@query(f"""WITH {ASKED_SQL}, p AS (SELECT query_id, {_METRICS} AS ms, CASE WHEN len({_YEARS}) = 1 THEN {_YEARS}[1] END AS y, list_filter(['india','china','brazil'], lambda x: list_contains({_TOKS}, x)) AS es FROM asked)
SELECT query_id, m || ' of ' || e || coalesce(' ' || y, '') AS step FROM (SELECT query_id, y, unnest(ms) AS m, es FROM p) CROSS JOIN unnest(es) AS u(e)""")
def plan_steps(spark, sf_dir):
    t = F.col("text")
    words = text.tokens(t)
    entities = F.filter(F.array(*map(F.lit, ("india", "china", "brazil"))), lambda x: F.array_contains(words, x))
    steps = understand.plan_steps(entities, understand.metrics(t), understand.year(t))
    return asked(spark, sf_dir).select("query_id", F.explode(steps).alias("step"))


@query("""SELECT doc_id, sha1(text) AS sha1_id, md5(text) AS md5_id, substr(sha1(text), 1, 12) AS short_id, 'parent-' || substr(sha256(source || '|' || lang), 1, 24) AS parent_id FROM documents""")
def stable_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.sha1("text").alias("sha1_id"), F.md5("text").alias("md5_id"), text.short_sha1(F.col("text")).alias("short_id"),
        text.parent_key(F.col("source"), F.col("lang")).alias("parent_id"),
    )


@query()
def uuid5_ids(spark, sf_dir):
    """Name-based ids; tests compare them with Python's, as the check's engine can't hash mixed bytes."""
    return read(spark, sf_dir, "documents").select("doc_id", text.uuid5(F.col("text")).alias("chunk_id"))


@query("""SELECT c_custkey, trim(regexp_replace(c_name || '/#x', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS safe, format('{:,}', c_custkey * 1234) AS grouped FROM customer""")
def name_formats(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", text.safe_name(F.concat("c_name", F.lit("/#x"))).alias("safe"), text.thousands((F.col("c_custkey") * 1234).cast("string")).alias("grouped"))


@query(f"SELECT doc_id, array_to_string(list_filter({_TOKS}, lambda x: length(x) >= 5 AND x NOT IN ('there', 'their'))[1:3], ' ') AS words FROM documents WHERE n_chars < 0 UNION ALL SELECT doc_id, array_to_string(ks, ' ') FROM (SELECT doc_id, list(w ORDER BY k)[1:10] AS ks FROM (SELECT doc_id, w, min(k) AS k FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT doc_id, {_TOKS} AS ws FROM documents)) WHERE length(w) >= 3 AND w NOT IN ('the', 'and') GROUP BY ALL) GROUP BY doc_id)")
def topic_keywords(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.topic_keywords(F.col("text"), ["the", "and"]), " ").alias("words")).filter("words <> ''")
