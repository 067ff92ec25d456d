"""Chunk quality: why a chunk is rejected, what it scores, and which tier it is in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SENTENCE, collapsed, upper_ratio

# Words that make a number-heavy chunk worth keeping, and length limits.
KEYWORDS = "standards development growth efficiency trade".split()
SHORTEST, LONG, LONGER = 50, 180, 320
# Fixed value: the running head of the report's pages.
PAGE_HEADER = "\\bworld development report +[0-9]{4} +[0-9]+\\b"


def measured(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``chunks`` with a struct ``q`` of what the rules look at; each pattern runs over a text once."""
    chunks = chunks.withColumn("_clean", collapsed(F.col(text)))
    clean = F.col("_clean")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: ~x.rlike("^[ \\t\\r\\f]*+(?:[^ \\t\\r\\f]++[ \\t\\r\\f]++){4}[^ \\t\\r\\f]")))
    low = F.lower(clean)
    known = sum((F.when(F.contains(low, F.lit(w)), low.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])").cast("int")).otherwise(0) for w in KEYWORDS), F.lit(0))
    found = F.struct(
        F.length(clean).alias("length"),
        F.regexp_count(clean, F.lit(SENTENCE)).cast("long").alias("sentences"),
        F.regexp_count(clean, F.lit("[0-9]+(?:[.,][0-9]+)*")).alias("figures"),
        upper_ratio(clean).alias("upper"),
        F.regexp_count(clean, F.lit("[A-Za-z]+")).alias("words"),
        F.regexp_count(clean, F.lit("[.!?]")).alias("ends"),
        known.alias("known"),
        F.size(lines).alias("lines"),
        short.alias("short"),
        low.alias("low"),
    )
    chunks = chunks.withColumn("q", found)
    every = F.col("q.figures") + F.col("q.words")
    numbers = F.when(every == 0, F.lit(0.0)).otherwise(F.col("q.figures") / every)
    return chunks.withColumn("q", F.col("q").withField("numbers", numbers)).drop("_clean")


def metadata_like(q: Column) -> Column:
    """Mostly short lines, a few words without an end, or shouted."""
    return (q["length"] == 0) | ((q["lines"] >= 3) & (q["short"] >= 0.7 * q["lines"])) | ((q["words"] <= 12) & (q["ends"] == 0)) | ((q["upper"] > 0.6) & (q["words"] >= 5))


def reason(q: Column) -> Column:
    """First reason to reject a measured chunk, or null."""
    low = q["low"]

    def says(pattern: str, *words: str) -> Column:
        """A pattern, tried only where one of the words is that any match has."""
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) & low.rlike(pattern)

    return (
        F.when(q["length"] < SHORTEST, "too_short")
        .when(says("https?://|www[.]", "http", "www."), "url")
        .when(says("source:|notes:", "source:", "notes:"), "source_or_notes")
        .when(says("\\b(?:figure|table) +[0-9]+\\b", "figure ", "table "), "figure_or_table")
        .when(says("\\b(?:contents|references|foreword)\\b", "contents", "references", "foreword") & (q["sentences"] < 2), "toc_or_references")
        .when(says(PAGE_HEADER, "world development report") & (q["sentences"] < 2), "report_page_header")
        .when((q["numbers"] > 0.3) & (q["known"] == 0), "number_heavy")
        .when(metadata_like(q) & (q["sentences"] == 0), "metadata_like")
    )


def score(q: Column) -> Column:
    return (
        F.least(q["sentences"], F.lit(3)) * 3
        + F.least(q["known"], F.lit(4)) * 2
        + F.when(q["length"] >= LONG, 2).otherwise(0)
        + F.when(q["length"] >= LONGER, 1).otherwise(0)
        - F.when(q["sentences"] < 2, 2).otherwise(0)
        - F.when(q["numbers"] > 0.2, 2).otherwise(0)
        - F.when(metadata_like(q), 3).otherwise(0)
    )


def judged(chunks: DataFrame, keep: tuple[str, ...] = ("doc_id", "source_type")) -> DataFrame:
    """Columns ``keep``, reason, quality, tier: 0 kept (score of 2 or more, or not a pdf), 1 fallback, 2 rejected.

    A chunk whose content_type (if there is such a column) is visual is never rejected.
    """
    q = F.col("q")
    why = reason(q)
    if "content_type" in chunks.columns:
        why = F.when(F.lower(F.coalesce("content_type", F.lit(""))) == "visual", F.lit(None)).otherwise(why)
    out = measured(chunks).select(*keep, (F.col("source_type") != "pdf").alias("_other"), why.alias("reason"), score(q).alias("quality"))
    tier = F.when(F.col("_other") | (F.col("reason").isNull() & (F.col("quality") >= 2)), 0).when(F.col("reason").isNull(), 1).otherwise(2)
    return out.withColumn("tier", tier).drop("_other")


CLEAN_SQL = "trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_KNOWN = "[" + ", ".join(f"'{w}'" for w in KEYWORDS) + "]"
_SENTENCES = "len(regexp_extract_all(clean, '[A-Z][^.!?]{25,}[.!?]'))"
_RATIO = "(CASE WHEN len(regexp_extract_all(clean, '[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*')) = 0 THEN 0 ELSE len(regexp_extract_all(clean, '[0-9]+(?:[.,][0-9]+)*')) / len(regexp_extract_all(clean, '[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*')) END)"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_META = f"""(clean = '' OR (len({_LINES}) >= 3 AND len(list_filter({_LINES}, lambda x: len(regexp_extract_all(x, '[^ \\t\\r\\f]+')) <= 4)) >= 0.7 * len({_LINES}))
 OR (len(regexp_extract_all(clean, '[A-Za-z]+')) <= 12 AND len(regexp_extract_all(clean, '[.!?]')) = 0)
 OR (len(regexp_extract_all(clean, '[A-Za-z]')) > 0 AND len(regexp_extract_all(clean, '[A-Z]')) / len(regexp_extract_all(clean, '[A-Za-z]')) > 0.6 AND len(regexp_extract_all(clean, '[A-Za-z]+')) >= 5))"""
REASON_SQL = f"""CASE WHEN length(clean) < {SHORTEST} THEN 'too_short' WHEN regexp_matches(lower(clean), 'https?://|www[.]') THEN 'url' WHEN regexp_matches(lower(clean), 'source:|notes:') THEN 'source_or_notes'
 WHEN regexp_matches(lower(clean), '\\b(?:figure|table) +[0-9]+\\b') THEN 'figure_or_table' WHEN regexp_matches(lower(clean), '\\b(?:contents|references|foreword)\\b') AND {_SENTENCES} < 2 THEN 'toc_or_references' WHEN regexp_matches(lower(clean), '{PAGE_HEADER}') AND {_SENTENCES} < 2 THEN 'report_page_header'
 WHEN {_RATIO} > 0.3 AND NOT list_has_any(regexp_extract_all(lower(clean), '[a-z0-9]+'), {_KNOWN}) THEN 'number_heavy' WHEN {_META} AND {_SENTENCES} = 0 THEN 'metadata_like' END"""
SCORE_SQL = f"""(least({_SENTENCES}, 3) * 3 + least(len(list_intersect(regexp_extract_all(lower(clean), '[a-z0-9]+'), {_KNOWN})), 4) * 2 + CASE WHEN length(clean) >= {LONG} THEN 2 ELSE 0 END + CASE WHEN length(clean) >= {LONGER} THEN 1 ELSE 0 END
 - CASE WHEN {_SENTENCES} < 2 THEN 2 ELSE 0 END - CASE WHEN {_RATIO} > 0.2 THEN 2 ELSE 0 END - CASE WHEN {_META} THEN 3 ELSE 0 END)"""
