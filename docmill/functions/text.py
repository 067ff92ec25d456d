"""Text columns: normalisation, tokens, counts, identifiers and set similarities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a missing cell may say.
MISSING = ("", "nan", "none", "null", "..", "...", "n/a", "na")
#: Words that carry no content when tokens of answers and sources are compared.
ANSWER_STOPWORDS = "the and for that this with from into are was were has have not but your you our can will about source context answer".split()
#: A capital, at least 25 more characters and an end; possessive, so that it is linear where no end comes.
SENTENCE = "[A-Z][^.!?]{25,}+[.!?]"
NAMESPACE_DNS = uuid.NAMESPACE_DNS.hex


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def normalised(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits turned into single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " "))


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), 0)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[^ \\t\\n\\r\\f]+")).cast("long")


def token_estimate(c: Column) -> Column:
    """At least 1, the number of words, a quarter of the characters rounded up."""
    return F.greatest(F.lit(1).cast("long"), word_count(c), F.ceil(F.length(c) / 4).cast("long"))


def sentence_count(c: Column) -> Column:
    """Runs that start with a capital, hold at least 25 more characters and end like a sentence."""
    return F.regexp_count(collapsed(c), F.lit(SENTENCE)).cast("long")


def number_ratio(c: Column) -> Column:
    """Share of numbers among words and numbers."""
    words = F.regexp_count(c, F.lit("[A-Za-z]+"))
    numbers = F.regexp_count(c, F.lit("[0-9]+(?:[.,][0-9]+)*"))
    return F.when(words + numbers == 0, F.lit(0.0)).otherwise(numbers / (words + numbers))


def upper_ratio(c: Column) -> Column:
    letters = F.length(c) - F.length(F.regexp_replace(c, "[A-Za-z]+", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(c, F.lit("[A-Z]")) / letters)


def content_tokens(c: Column, stopwords: list[str] = ANSWER_STOPWORDS) -> Column:
    """Distinct tokens of a letter and at least two more signs, without stopwords."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9_-]{2,}"), 0)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, stopwords)))


def overlap(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ordered_union(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def topic_keywords(c: Column, stopwords: list[str], most: int = 10) -> Column:
    words = F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~w.isin(*stopwords))
    return F.slice(F.array_distinct(words), 1, most)


def uuid5(c: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """Name-based identifier: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def short_sha1(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(c), 1, length)


def parent_key(*parts: Column) -> Column:
    return F.concat(F.lit("parent-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def sparse_index(token: Column) -> Column:
    """Dimension of a token in a hashed sparse vector: the first 8 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def safe_name(c: Column) -> Column:
    """A path part of letters, digits, dots, dashes and underscores."""
    return F.trim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def thousands(c: Column) -> Column:
    """Digit groups before the decimals that the number itself has."""
    whole, rest = F.split_part(c, F.lit("."), F.lit(1)), F.split_part(c, F.lit("."), F.lit(2))
    grouped = F.regexp_replace(whole, "([0-9])(?=([0-9]{3})+$)", "$1,")
    return F.when(rest == "", grouped).otherwise(F.concat_ws(".", grouped, rest))


def first_match(c: Column, table: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first pattern in ``table`` that the column matches."""
    out = F.lit(otherwise)
    for pattern, name in reversed(table):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out
