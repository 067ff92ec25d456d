"""Evaluation and audits: recall, retrieval rates, coverage, deltas, scores with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall: share of a query's relevant documents among its ``k`` best."""
    hits = ranked.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    met = relevant.select("query_id", "doc_id").distinct().join(hits, ["query_id", "doc_id"], "left")
    return met.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def rates(rows: DataFrame, by: list[str], flags: dict[str, Column], digits: int = 3) -> DataFrame:
    """Share of rows for which each flag holds (null: it doesn't)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), digits).alias(name) for name, c in flags.items()])


def completeness(rows: DataFrame, by: list[str], required: list[str]) -> DataFrame:
    """How many rows lack each required column."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"no_{c}") for c in required])


def delta_percent(base: Column, other: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise((other - base) / base * 100)


def scored(rules: dict[str, tuple[int, Column]], start: int = 0) -> Column:
    """struct(score, reasons): points of the rules that hold, and their names in order."""
    score = F.lit(start)
    for points, c in rules.values():
        score = score + F.when(c, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (_, c) in rules.items()]))
    return F.struct(score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


def top_reasons(rows: DataFrame, reasons: str, k: int) -> DataFrame:
    """The ``k`` most frequent reasons (a report, hence the limit)."""
    each = rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "reason").limit(k)


# The parts of an answer about a visual, and the share of usable crops that passes.
FACTS = r"(?is)Key extracted facts:\s*(.*?)(?:\n\s*Related paragraph insight:|\z)"
INSIGHT = r"(?is)Related paragraph insight:\s*(.*?)(?:\n\s*Combined interpretation:|\z)"
TITLE_ONLY = r"(?i)What the visual shows:\s*(?:Figure|Table|Chart|Panel)\s+[0-9]"
OCR_NOISE = r"(?:Â|Ã|â€“|[|_~]{2,}|\b[0-9]+\s+[0-9]+\s+[0-9]+\s+[0-9]+\b)"
USABLE_TARGET = 0.90


def answer_quality(answer: Column) -> Column:
    """struct of what an answer about a visual says: how many facts, only a title, traces of OCR, a paragraph that goes with it."""
    facts = F.regexp_count(F.regexp_extract(answer, FACTS, 1), F.lit(r"(?m)^\s*\*\s+\S"))
    insight = F.lower(F.trim(F.regexp_replace(F.regexp_extract(answer, INSIGHT, 1), r"^\s+|\s+$", "")))
    return F.struct(
        facts.alias("facts"),
        ((facts < 2) & answer.rlike(TITLE_ONLY)).alias("title_only"),
        answer.rlike(OCR_NOISE).alias("ocr_noise"),
        ((insight != "") & ~F.contains(insight, F.lit("no strongly aligned"))).alias("aligned"),
    )


def quality_rates(answers: DataFrame, answer: str = "answer", by: list[str] | None = None) -> DataFrame:
    """Mean number of facts and the share of answers with each trait."""
    q = answers.withColumn("q", answer_quality(F.col(answer)))
    share = lambda name: F.round(F.avg(F.col(f"q.{name}").cast("double")), 3).alias(name)
    return q.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg("q.facts"), 3).alias("facts"), *map(share, ("title_only", "ocr_noise", "aligned")))


def usability(crops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tested, usable, rate and status of crops (usable boolean); see ``failed_reasons`` for why the others aren't."""
    out = crops.groupBy(*(by or [])).agg(F.count("*").alias("tested"), F.count_if(F.col("usable")).alias("usable"))
    rate = F.when(F.col("tested") > 0, F.col("usable") / F.col("tested")).otherwise(F.lit(0.0))
    return out.withColumn("rate", F.round(rate, 3)).withColumn("status", F.when(rate >= USABLE_TARGET, "PASS").otherwise("NEEDS_REVIEW"))


def failed_reasons(crops: DataFrame) -> DataFrame:
    """reason, n of crops that aren't usable (reasons array; none given: unknown)."""
    why = F.when(F.coalesce(F.size("reasons"), F.lit(0)) <= 0, F.array(F.lit("unknown"))).otherwise(F.col("reasons"))
    return crops.filter(~F.coalesce("usable", F.lit(False))).select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
