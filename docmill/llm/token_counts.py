"""Token counts behind a digest cache.

A count is stored under the digest of the normalised content and the digest of the tokenizer file.
Counting joins the distinct content digests with the cache, encodes the misses only, appends
their counts to the cache and joins every row with its digest's count.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, new_path, small_batches

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"
_CUT = re.compile(r"(?<!\s)(?= \S)")
#: Parts whose counts a worker remembers.
MEMO_PARTS = 400_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens of whole texts with the library of a ``tokenizers`` (.json) or ``sentencepiece`` (.model) file."""

    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.by_part = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import json
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.many = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            split = spec.get("pre_tokenizer") or {}
            # Byte-level BPE with its usual pattern cuts before any space that a visible character follows.
            self.by_part = (
                spec["model"]["type"] == "BPE"
                and split.get("type") == "ByteLevel"
                and split.get("use_regex", True)
                and not split.get("add_prefix_space", True)
                and not spec.get("normalizer")
                and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", []))
            )

    def parts(self, text: str) -> list[str]:
        """Parts of a text whose counts add up to its count: cut before each space that a visible character follows and no white space precedes."""
        return [x for x in _CUT.split(text) if x]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_part:
            return self.many(texts)
        if len(self.memo) > MEMO_PARTS:
            self.memo.clear()
        memo = self.memo
        split = [self.parts(x) for x in texts]
        missing = list({p for parts in split for p in parts if p not in memo})
        for k in range(0, len(missing), 5000):
            some = missing[k : k + 5000]
            memo.update(zip(some, self.many(some)))
        return [sum(map(memo.__getitem__, parts)) for parts in split]


_counters: dict[str, Counter] = {}


def _count_texts(path: str):
    def run(batches):
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            counts = counter.count([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    return run


def content_digest(text):
    """Digest of the normalised content: a null text is an empty one, all else counts as it is."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """Columns ``keep``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row.

    ``tokenizer`` is the path of a tokenizer file on every worker; no special tokens are added,
    nothing is cut or padded, special strings in a text count as the library has them by default.
    ``cache`` is a Parquet folder of CACHE_SCHEMA: read where it exists, and the counts of all
    new contents are appended to it. Without one the counts live in the shared folder until Python ends. Equal
    texts are encoded once; repeated rows give repeated results; a null text counts as empty (0 tokens); a kept
    column named like a result's gets _given behind its name; an empty table gives no rows.
    Only digests and counts are joined, and the text of each distinct miss is shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(tokenizer)
    path = cache or new_path(spark, "token-cache")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    contents = docs.select(content_digest(whole).alias("content_digest"), whole.alias("text"))
    if cache and _exists(spark, cache):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer_digest") == version)
        contents = contents.join(known.select("content_digest"), "content_digest", "left_anti")
    misses = contents.groupBy("content_digest").agg(F.first("text").alias("text"))
    counted = misses.mapInArrow(_count_texts(tokenizer), "content_digest string, n_tokens bigint")
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer_digest") == version)
    counts = (known.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")) if cache else known).select("content_digest", F.col("n_tokens").alias("count"))
    rows, names, _ = narrowed(docs, keep, "n_bytes bigint, n_tokens bigint, over_limit boolean", content_digest(whole), F.octet_length(whole).cast("long"))
    met = rows.join(counts, F.col("input_0") == F.col("content_digest"))
    return met.select(*[F.col(f"kept_{k}").alias(n) for k, n in enumerate(names)], F.col("input_1").alias("n_bytes"), F.col("count").alias("n_tokens"), (F.col("count") > limit).alias("over_limit"))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
