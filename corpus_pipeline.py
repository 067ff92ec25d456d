"""A corpus pipeline out of four operators; each stage is written and read again before the next.

Toxic documents go, one document of each near-duplicate group stays, the sources are mixed to their
target weights (a document taken twice is two rows), and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import minhash, mixing, sentencepiece_wfst, toxicity
from docmill.llm.common import forget_since, mark, parted, table, written
from docmill.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity operator doesn't reject; nothing else about them changes.

    Null and empty texts are judged as such, repeated rows alike; columns of any name stay; an empty table stays empty.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each near-duplicate group, one of them if it is repeated.

    Rows without doc_id stay, rows without words too; columns of any name stay; an empty table stays empty.
    """
    judged = written(minhash.near_duplicates(docs).select("doc_id", "kept"), "judged")
    repeated = judged.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    dropped = judged.filter("not kept").select("doc_id").distinct()
    # only rows that may be dropped or repeated are shuffled
    doubt, sure = parted(docs, "doc_id", dropped.unionByName(repeated))
    left = doubt.join(dropped, "doc_id", "left_anti")
    if repeated.limit(1).count():
        one = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(repeated, "doc_id", "left_anti").unionByName(one)
    return sure.unionByName(left).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; null sources are a source, rows without words are drawn alone; columns of any name stay."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the digest of what they decode to; a null text has none. Rows come as often as they are in ``docs``."""
    return sentencepiece_wfst.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]
#: No stage can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's tables go once the next one's input is written. An empty table gives no rows."""
    docs, since = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget_since(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
