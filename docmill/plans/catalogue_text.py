"""Registered queries: text segmentation over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import collapsed
from ..operators import chunking, tabular
from .probes import ASKED_SQL, asked, quoted
from .registry import query, read

G = quoted
LINES_SQL = "ls AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
PAGE_NO = "^$|^(?:page +)?[0-9]{1,4} *(?:of *[0-9]{1,4})?$|^[ivxlcdm]{1,8}$"


def _noisy(c: str) -> str:
    return f"""({c} <> '' AND (regexp_matches(lower({c}), {G(chunking.URL)}) OR regexp_matches(lower({c}), {G(PAGE_NO)}) OR regexp_matches(lower({c}), {G(chunking.TOC)}) OR regexp_matches({c}, '[.]{{4,}}') OR regexp_matches(lower({c}), '{chunking.REPORT_HEADER}') OR regexp_matches(lower({c}), '^(?:chapter|section|figure|table) +[0-9]+[a-z]?$')
 OR (len(regexp_extract_all({c}, '[0-9]+')) > 0 AND len(regexp_extract_all({c}, '[0-9]+')) >= greatest(len(regexp_extract_all({c}, '[A-Za-z]+')), 3))))"""


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n, count(*) FILTER ({_noisy('line')}) AS noisy, count(*) FILTER (regexp_matches(lower(line), {G(PAGE_NO)})) AS numbers FROM ls GROUP BY doc_id")
def noisy_lines(spark, sf_dir):
    ls = chunking.lines(read(spark, sf_dir, "documents"), "doc_id")
    return ls.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(chunking.noisy_line(F.col("line"))).alias("noisy"), F.count_if(chunking.page_number(F.col("line"))).alias("numbers"))


@query(f"""WITH {LINES_SQL}, p AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN 'Journal of ' || left(line, 60) WHEN pos % 4 = 1 THEN 'World Development Report 2021 ' || length(line) ELSE line END AS p FROM ls)
SELECT doc_id, count(*) FILTER (regexp_matches(p, {G(chunking.CITATION)}) AND len(regexp_extract_all(p, '[.!?]')) <= 1 AND length(p) >= 45) AS cited, count(*) FILTER (regexp_matches(lower(p), '{chunking.REPORT_HEADER}')) AS headers FROM p GROUP BY doc_id""")
def citation_lines(spark, sf_dir):
    """Lines that only cite, and running heads of a report, among lines of which some were turned into such."""
    ls = chunking.lines(read(spark, sf_dir, "documents"), "doc_id")
    head = F.concat(F.lit("World Development Report 2021 "), F.length("line").cast("string"))
    p = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("Journal of "), F.substring("line", 1, 60))).when(F.col("pos") % 4 == 1, head).otherwise(F.col("line"))
    cited = chunking.cited(p) & (F.length(p) >= 45)
    return ls.groupBy("doc_id").agg(F.count_if(cited).alias("cited"), F.count_if(F.lower(p).rlike(chunking.REPORT_HEADER)).alias("headers"))


PARA_SQL = f"""WITH {LINES_SQL}, c AS (SELECT *, line = '' OR {_noisy('line')} AS cut FROM ls),
l AS (SELECT *, lag(line) OVER w AS before, coalesce(lag(cut) OVER w, true) AS cut_before FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT *, cut OR cut_before OR NOT (regexp_matches(before, '[-/,]$') OR NOT regexp_matches(before, '[.!?:]$') OR (lower(line[1]) = line[1] AND upper(line[1]) <> line[1])) AS start FROM l),
g AS (SELECT *, sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s),
p AS (SELECT doc_id, island, trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS p FROM g WHERE NOT cut GROUP BY ALL),
paras AS (SELECT doc_id, CAST(island AS BIGINT) AS n, p AS paragraph FROM p WHERE NOT (length(p) < 45 OR regexp_matches(lower(p), {G(chunking.URL)}) OR regexp_matches(lower(p), {G(PAGE_NO)}) OR (regexp_matches(p, {G(chunking.CITATION)}) AND len(regexp_extract_all(p, '[.!?]')) <= 1) OR regexp_matches(lower(p), {G(chunking.TOC)}) OR regexp_matches(lower(p), '\\b(?:figure|table) +[0-9]+\\b')
 OR (len(regexp_extract_all(p, '[A-Za-z]+|[0-9]+(?:[.][0-9]+)?')) > 0 AND len(regexp_extract_all(p, '[0-9]+(?:[.][0-9]+)?')) > 0.35 * len(regexp_extract_all(p, '[A-Za-z]+|[0-9]+(?:[.][0-9]+)?')))))"""


@query(PARA_SQL + " SELECT doc_id, n, paragraph FROM paras")
def paragraph_islands(spark, sf_dir):
    return chunking.paragraphs(read(spark, sf_dir, "documents"))


@query()
def pack_overlap(spark, sf_dir):
    """Paragraphs packed greedily with overlap: an ordered fold, tested against a plain restatement."""
    p = chunking.paragraphs(read(spark, sf_dir, "documents"))
    lists = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "paragraph"))).alias("ps"))
    packed = chunking.pack(F.transform("ps", lambda x: x["paragraph"]))
    return lists.select("doc_id", F.posexplode(packed).alias("chunk", "text"))


@query()
def recursive_split(spark, sf_dir):
    """Separators from paragraphs down to words, at last anywhere; recursion runs in an Arrow function."""
    d = read(spark, sf_dir, "documents")
    return chunking.recursive_parts(d, "doc_id")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, k AS part, array_to_string(ws[k * 768 + 1 : k * 768 + 768], ' ') AS body FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 1, 0) // 768 + 1)) AS k FROM w)""")
def token_windows(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.token_windows(F.col("text"))).alias("part", "body")).withColumn("part", F.col("part").cast("long"))


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE trim(text) <> ''),
f AS (SELECT conv_id, turn, k, t AS overlapped FROM n WHERE k = 1 UNION ALL SELECT conv_id, turn, k, CASE WHEN p = '' OR starts_with(t, p) THEN t ELSE p || chr(10) || chr(10) || t END FROM (SELECT n.*, trim(right(f.overlapped, 150), ' ' || chr(10)) AS p FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1))
SELECT conv_id, turn, overlapped FROM f""")
def char_overlap(spark, sf_dir):
    return chunking.char_overlap(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "overlapped")


_MD = "CASE turn % 6 WHEN 0 THEN '# Part ' || conv_id WHEN 1 THEN '## Sub ' || turn WHEN 2 THEN '### Deep ' || turn WHEN 4 THEN '## Other' ELSE text END"


@query(f"""WITH l AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 0 END AS level, trim(regexp_replace(regexp_replace({_MD}, '\\n', ' ', 'g'), '^#+ *', '')) AS title FROM conversations),
s AS (SELECT *, sum((level > 0)::INT) OVER w AS section, max(CASE WHEN level = 1 THEN turn END) OVER w AS p1, max(CASE WHEN level = 2 THEN turn END) OVER w AS p2, max(CASE WHEN level = 3 THEN turn END) OVER w AS p3,
 last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS a2, last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER w AS a3 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
h AS (SELECT conv_id, turn, section, a1 AS h1, CASE WHEN p2 > coalesce(p1, -1) THEN a2 END AS h2, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN a3 END AS h3 FROM s)
SELECT conv_id, CAST(section AS BIGINT) AS section, coalesce(arg_min(h3, turn), arg_min(h2, turn), arg_min(h1, turn), '') AS title FROM h GROUP BY ALL""".replace("arg_min(h3, turn)", "arg_min_null(h3, turn)").replace("arg_min(h2, turn)", "arg_min_null(h2, turn)").replace("arg_min(h1, turn)", "arg_min_null(h1, turn)"))
def section_fill(spark, sf_dir):
    """Markdown made of the turns: sections and the headings they inherit."""
    c = read(spark, sf_dir, "conversations")
    line = F.regexp_replace(F.expr(_MD), "\n", " ")
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return chunking.sections(docs, "conv_id").select("conv_id", F.col("section").cast("long").alias("section"), F.coalesce("title", F.lit("")).alias("title"))


@query(f"""WITH {LINES_SQL}, m AS (SELECT *, length(line) < 35 AND regexp_matches(line, '^[A-Z][^.!?,;:]*$') AND regexp_matches(line, '^(?:[A-Z0-9][^ ]*)(?: [A-Z0-9][^ ]*)*$') AS head FROM ls),
s AS (SELECT *, sum(CASE WHEN coalesce(head <> before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, lag(head) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS n FROM s)
SELECT doc_id, sha1(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM n WHERE NOT (head AND n > 3) GROUP BY doc_id""")
def header_runs(spark, sf_dir):
    return chunking.header_runs(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.sha1("text").alias("digest"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN length(text) >= 100 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 first_value(CASE WHEN length(text) >= 100 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM conversations""")
def neighbour_context(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return chunking.neighbours(c, "conv_id", "turn", "text", F.length("text") < 100).select("conv_id", "turn", "before", "after")


@query("""WITH m AS (SELECT user_id AS k, event_id % 3000 AS p FROM events), i AS (SELECT k, p, greatest(p - 500, 0) AS lo, p + 500 AS hi FROM m),
s AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i), g AS (SELECT *, sum(CASE WHEN coalesce(lo > far, true) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, island""")
def merged_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 3000).alias("at"))
    return chunking.merged_windows(e, "k", "at")


@query(f"""WITH {ASKED_SQL}, m AS (SELECT query_id, text || chr(10) || CASE WHEN query_id % 2 = 0 THEN 'Source: x' ELSE 'Notes: y' || chr(10) || ' source : z' END || chr(10) || '[id:7] () tail' AS t FROM asked)
SELECT query_id, trim(regexp_replace(regexp_replace(t, '\\[\\s*(?:-?[0-9.]+\\s*,\\s*){{3}}-?[0-9.]+\\s*\\]|\\[\\s*\\]|\\(\\s*\\)', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS plain,
 array_to_string(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(trim(x)), '^(?:source|notes?) *:')), chr(10)) AS notes FROM m""")
def strip_brackets(spark, sf_dir):
    t = F.concat("text", F.when(F.col("query_id") % 2 == 0, F.lit("\nSource: x")).otherwise("\nNotes: y\n source : z"), F.lit("\n[id:7] () tail"))
    return asked(spark, sf_dir).select("query_id", chunking.without_brackets(t).alias("plain"), chunking.source_notes(t)["notes"].alias("notes"))


@query()
def asset_sentences(spark, sf_dir):
    """Sentences on competing assets masked, parts with a keyword, pruned tags; look-around keeps them from SQL here."""
    t = F.col("text")
    return asked(spark, sf_dir).select(
        "query_id", chunking.competing_masked(t, "figure", ["table", "chart", "box"]).alias("masked"),
        F.size(chunking.keyword_parts(t, F.lit("gdp"))).alias("parts"), chunking.pruned(t).alias("pruned"), chunking.clean_text(t).alias("clean"),
    )


@query("SELECT doc_id, array_to_string(list(l ORDER BY k), ', ') AS once FROM (SELECT doc_id, l, min(k) AS k FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents) WHERE l <> '' GROUP BY ALL) GROUP BY doc_id")
def lines_once(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", chunking.lines_once(F.col("text")).alias("once")).filter("once <> ''")


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"SELECT page_id, trim(regexp_replace({_TITLE}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS title, replace(replace(replace(replace({_STRIP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS body FROM pages")
def html_to_text(spark, sf_dir):
    """Plain adapter for pages as a source: scripts, comments and tags go, the usual references are decoded."""
    p = read(spark, sf_dir, "pages")
    body = F.regexp_replace("html", "(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    body = collapsed(F.regexp_replace(body, "<[^>]*>", " "))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return p.select("page_id", collapsed(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), body.alias("body"))


_TBL = "'intro' || chr(10) || '| a' || c_nationkey || ' | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || c_name || ' | ' || c_nationkey || ' |' || chr(10) || repeat('| x1 |  |' || chr(10), CAST(c_custkey % 4 AS INT)) || 'end'"


@query("SELECT c_custkey, 'a' || c_nationkey || ', b' AS headers, c_custkey % 4 + 1 AS n, c_name AS first, CASE WHEN c_custkey % 4 > 0 THEN 'x1' ELSE '-' END AS second FROM customer")
def md_table_parse(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("md", F.expr(_TBL.replace("chr(10)", "char(10)")))
    s = tabular.table_summary(F.col("md"))
    return c.select(
        "c_custkey", s["headers"].alias("headers"), s["rows"].cast("long").alias("n"), tabular.markdown_rows(F.col("md"))[1][0].alias("first"),
        F.coalesce(F.get(F.get(tabular.markdown_rows(F.col("md")), F.lit(2)), F.lit(0)), F.lit("-")).alias("second"),
    )


@query("SELECT n_nationkey, '| id | name | more |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |  |' AS md FROM nation")
def csv_to_markdown(spark, sf_dir):
    csv = F.concat(F.lit("id;name;more\n"), F.col("n_nationkey").cast("string"), F.lit("; "), F.col("n_name"), F.lit("\n\n"))
    return read(spark, sf_dir, "nation").select("n_nationkey", tabular.csv_to_markdown(csv).alias("md"))
