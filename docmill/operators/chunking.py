"""Text segmentation: line filters, paragraph islands, packing with overlap, sections, windows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapsed

# Patterns of lines and paragraphs that carry no prose, and size limits.
URL = "\\b(?:https?://|www[.])[^ \\t\\n\\r]+"
TOC = "\\b(?:contents|table of contents|references|bibliography|acknowledge?ments|foreword)\\b"
CITATION = "(?i)(?:^|[^\\p{L}\\p{N}_])(?:doi|journal|press|vol|no|pp|isbn|issn|retrieved|available at)(?:$|[^\\p{L}\\p{N}_])"
REPORT_HEADER = "^world development report +[0-9]{4} +[0-9]{1,4}$"
CHUNK, OVERLAP, SHORTEST_PARAGRAPH, WINDOW = 1200, 150, 45, 768


def clean_text(c: Column) -> Column:
    """Unix line ends, words joined over hyphens (not before a few small words), tight slashes, at most one empty line."""
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, "([A-Za-z]{2,})-\\n([A-Za-z]{2,})", "$1$2")
    c = F.regexp_replace(c, "([A-Za-z]{2,})\\s*-\\s+(?!(?i:and|or|to|from|with)\\b)([A-Za-z]{2,})", "$1$2")
    c = F.regexp_replace(c, "[ \\t]*/[ \\t]*", "/")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, "(?m)^ +| +$", "")
    return F.trim(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def page_number(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return low.rlike("^$|^(?:page +)?[0-9]{1,4} *(?:of *[0-9]{1,4})?$|^[ivxlcdm]{1,8}$")


def noisy_line(c: Column) -> Column:
    line = F.trim(c)
    low = F.lower(line)
    letters, digits = F.regexp_count(line, F.lit("[A-Za-z]+")), F.regexp_count(line, F.lit("[0-9]+"))
    return (line != "") & (
        low.rlike(URL) | page_number(line) | low.rlike(TOC) | line.rlike("[.]{4,}") | low.rlike(REPORT_HEADER) | low.rlike("^(?:chapter|section|figure|table) +[0-9]+[a-z]?$") | ((digits > 0) & (digits >= F.greatest(letters, F.lit(3))))
    )


def cited(c: Column) -> Column:
    """Words of a citation and no more than one end of a sentence."""
    return c.rlike(CITATION) & (F.regexp_count(c, F.lit("[.!?]")) <= 1)


def noisy_paragraph(c: Column) -> Column:
    p = collapsed(c)
    low = F.lower(p)
    words, numbers = F.regexp_count(p, F.lit("[A-Za-z]+|[0-9]+(?:[.][0-9]+)?")), F.regexp_count(p, F.lit("[0-9]+(?:[.][0-9]+)?"))
    return (F.length(p) < SHORTEST_PARAGRAPH) | low.rlike(URL) | page_number(p) | cited(p) | low.rlike(TOC) | low.rlike("\\b(?:figure|table) +[0-9]+\\b") | ((words > 0) & (numbers > 0.35 * words))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, line (trimmed) of every line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))


def islands(rows: DataFrame, by: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a new one at each row where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, paragraph: lines folded into paragraphs.

    Empty and noisy lines end a paragraph. Another line goes on with it if the line before ends in a dash,
    slash or comma or doesn't end like a sentence, or if it starts in lower case.
    """
    rows = lines(docs, key, text).withColumn("cut", (F.col("line") == "") | noisy_line(F.col("line")))
    w = Window.partitionBy(key).orderBy("pos")
    before, cut_before = F.lag("line").over(w), F.coalesce(F.lag("cut").over(w), F.lit(True))
    first = F.substring("line", 1, 1)
    goes_on = before.rlike("[-/,]$") | ~before.rlike("[.!?:]$") | ((F.lower(first) == first) & (F.upper(first) != first))
    rows = islands(rows.withColumn("_start", F.col("cut") | cut_before | ~goes_on), [key], "pos", F.col("_start"))
    folded = rows.filter(~F.col("cut")).groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    out = folded.select(key, F.col("island").cast("long").alias("n"), collapsed(F.array_join(F.transform("ls", lambda x: x["line"]), " ")).alias("paragraph"))
    return out.filter(~noisy_paragraph(F.col("paragraph")))


def pack(parts: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Greedy packing of an array of paragraphs: flush before ``size`` is passed, go on with the longest tail within ``overlap``."""
    joined = lambda xs: F.array_join(xs, "\n\n")

    def tail(xs: Column) -> Column:
        """The longest run of last parts whose joined length is within the overlap."""
        fits = F.filter(F.sequence(F.lit(1), F.size(xs)), lambda n: F.length(joined(F.slice(xs, -n, n))) <= overlap)
        most = F.coalesce(F.array_max(fits), F.lit(0))
        return F.when(most > 0, F.slice(xs, -most, most)).otherwise(F.slice(xs, 1, 0))

    none = F.slice(parts, 1, 0)
    return F.aggregate(
        parts,
        F.struct(none.alias("done"), none.alias("now")),
        lambda s, p: F.when(
            (F.size(s["now"]) > 0) & (F.length(joined(s["now"])) + F.length(p) + 1 > size),
            F.struct(F.concat(s["done"], F.array(joined(s["now"]))).alias("done"), F.concat(tail(s["now"]), F.array(p)).alias("now")),
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(p)).alias("now"))),
        lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(joined(s["now"])))).otherwise(s["done"]),
    )


def token_windows(c: Column, most: int = WINDOW) -> Column:
    """Windows of at most ``most`` words: long paragraphs are cut, short ones packed together, joined by spaces."""
    words = F.filter(F.split(F.trim(c), "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(words), F.lit(1)) - 1) / most)), lambda k: F.array_join(F.slice(words, (k * most + 1).cast("int"), most), " "))


def char_overlap(chunks: DataFrame, by: str, order: str, text: str = "text", overlap: int = OVERLAP) -> DataFrame:
    """Each chunk (trimmed) behind the last ``overlap`` characters of what the one before it became, unless it starts with them; empty chunks go.

    A chunk depends on the one before, so a group's chunks pass by as a sorted stream, one held at a time.
    """
    names = chunks.columns
    place, group = names.index(text), names.index(by)
    ordered = chunks.repartition(by).sortWithinPartitions(by, order)

    def run(batches):
        now, before = None, ""
        for batch in batches:
            out, kept = [], []
            for k, (key, x) in enumerate(zip(batch.column(group).to_pylist(), batch.column(place).to_pylist())):
                if (key,) != now:
                    now, before = (key,), ""
                x = (x or "").strip()
                if not x:
                    continue
                prefix = before[-overlap:].strip() if overlap > 0 else ""
                before = f"{prefix}\n\n{x}" if prefix and not x.startswith(prefix) else x
                out.append(before)
                kept.append(k)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept, pa.int64())).columns, pa.array(out, pa.string())], names=[*names, "overlapped"])

    return ordered.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("overlapped", T.StringType())]))


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section, title, h1, h2, h3, body of markdown: a section starts at each heading and inherits the shallower ones."""
    rows = lines(docs, key, text)
    level = F.length(F.regexp_extract("line", "^(#{1,6}) +[^ ]", 1))
    rows = rows.withColumn("level", level).withColumn("title", F.trim(F.regexp_replace("line", "^#+ *", "")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = {k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(w) for k in (1, 2, 3)}
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_p{k}", at[k]).withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(w))
    keep2 = F.col("_p2").isNotNull() & (F.coalesce(F.col("_p1"), F.lit(-1)) < F.col("_p2"))
    keep3 = F.col("_p3").isNotNull() & (F.greatest(F.coalesce(F.col("_p1"), F.lit(-1)), F.coalesce(F.col("_p2"), F.lit(-1))) < F.col("_p3"))
    rows = rows.withColumn("h1", F.col("_h1")).withColumn("h2", F.when(keep2, F.col("_h2"))).withColumn("h3", F.when(keep3, F.col("_h3")))
    rows = islands(rows, [key], "pos", F.col("level") > 0, "section")
    grouped = rows.groupBy(key, "section").agg(
        F.min_by("h1", "pos").alias("h1"), F.min_by("h2", "pos").alias("h2"), F.min_by("h3", "pos").alias("h3"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    return grouped.withColumn("title", F.coalesce("h3", "h2", "h1"))


def header_runs(docs: DataFrame, key: str, text: str = "text", most: int = 3, longest: int = 35) -> DataFrame:
    """key, text without runs of more than ``most`` short title-case lines that have no punctuation."""
    rows = lines(docs, key, text)
    rows = rows.withColumn("head", (F.length("line") < longest) & F.col("line").rlike("^[A-Z][^.!?,;:]*$") & F.col("line").rlike("^(?:[A-Z0-9][^ ]*)(?: [A-Z0-9][^ ]*)*$"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = islands(rows, [key], "pos", F.coalesce(F.lag("head").over(w) != F.col("head"), F.lit(True)))
    n = F.count("*").over(Window.partitionBy(key, "island"))
    kept = rows.withColumn("_n", n).filter(~(F.col("head") & (F.col("_n") > most)))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def neighbours(rows: DataFrame, by: str, order: str, text: str, skip: Column) -> DataFrame:
    """The nearest texts before and after each row that aren't skipped."""
    kept = F.when(~skip, F.col(text))
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("before", F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.first(kept, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    )


def merged_windows(rows: DataFrame, key: str, at: str, reach: int = 500) -> DataFrame:
    """Overlapping intervals ``at`` - reach .. ``at`` + reach of each key, merged."""
    w = Window.partitionBy(key).orderBy(at)
    rows = rows.withColumn("lo", F.greatest(F.col(at) - reach, F.lit(0))).withColumn("hi", F.col(at) + reach)
    furthest = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = islands(rows.withColumn("_new", F.coalesce(F.col("lo") > furthest, F.lit(True))), [key], at, F.col("_new"))
    return rows.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def source_notes(c: Column) -> Column:
    """struct(notes, rest): lines that start with Source: or Note(s): apart from the others."""
    ls = F.split(c, "\n")
    note = lambda x: F.lower(F.trim(x)).rlike("^(?:source|notes?) *:")
    return F.struct(F.array_join(F.filter(ls, note), "\n").alias("notes"), F.array_join(F.filter(ls, lambda x: ~note(x)), "\n").alias("rest"))


def competing_masked(c: Column, kind: str, others: list[str]) -> Column:
    """Drop sentences that name another kind of asset but not ``kind``."""
    other = "(?i)\\b(?:" + "|".join(others) + ")\\s+[0-9]"
    parts = F.split(c, "(?<=[.!?\\n])\\s+")
    return F.array_join(F.filter(parts, lambda s: ~s.rlike(other) | s.rlike(f"(?i)\\b{kind}\\s+[0-9]")), " ")


def keyword_parts(c: Column, keyword: Column) -> Column:
    """Parts between asset labels that hold the keyword."""
    parts = F.split(c, "(?=(?i:\\b(?:figure|table|chart|box)\\s+[0-9]))")
    return F.filter(parts, lambda p: F.contains(F.lower(p), F.lower(keyword)))


def without_brackets(c: Column) -> Column:
    """Coordinates and empty brackets go."""
    return collapsed(F.regexp_replace(c, "\\[\\s*(?:-?[0-9.]+\\s*,\\s*){3}-?[0-9.]+\\s*\\]|\\[\\s*\\]|\\(\\s*\\)", ""))


def pruned(c: Column) -> Column:
    """Bracketed tracking tags and layout lines go."""
    c = F.regexp_replace(c, "(?i)\\[(?:id|ref|track|chunk|bbox)[:=][^\\]]*\\]", "")
    return F.trim(F.regexp_replace(c, "(?im)^(?:layout|bbox|coordinates|page_no)\\s*[:=].*$\\n?", ""))


def lines_once(c: Column) -> Column:
    """Trimmed, collapsed, non-empty lines, the first of equal ones, joined by commas."""
    ls = F.filter(F.transform(F.split(c, "\n"), collapsed), lambda x: x != "")
    return F.array_join(F.array_distinct(ls), ", ")


# Fixed value: where a long text is cut, the first that it has.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def split_spans(text: str, size: int) -> list[tuple[int, int]]:
    """Start and end of the parts of a text, none longer than ``size``; parts of parts have no white space around them.

    A stretch that is too long is cut where its first separator is found, and runs of its pieces that fit
    stay together, separators included; one without any is cut anywhere. The text itself is sliced once.
    """
    marks = [re.compile(re.escape(s)) for s in SEPARATORS]
    todo, out = [(0, len(text))], []
    while todo:
        start, end = todo.pop()
        if end - start <= size:
            out.append((start, end))
            continue
        cuts = next((found for m in marks if (found := [x.span() for x in m.finditer(text, start, end)])), None)
        if cuts is None:
            out += [(k, min(k + size, end)) for k in range(start, end, size)]
            continue
        runs: list[list[int]] = []
        for a, b in zip([start, *(b for _, b in cuts)], [*(a for a, _ in cuts), end]):
            if runs and runs[-1][0] == runs[-1][1]:
                runs[-1] = [a, b]  # nothing stands before the separator
            elif runs and b - runs[-1][0] <= size:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        for a, b in reversed(runs):
            piece = text[a:b]
            todo.append((a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())))
    return [(a, b) for a, b in out if a < b]


def recursive_split(size: int = CHUNK):
    """An Arrow function text -> array of parts: cut at paragraphs, lines, sentences, words, at last anywhere."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts):
        return texts.map(lambda x: [x[a:b] for a, b in split_spans(x, size)] if x else [])

    return split


#: Texts that a worker holds in parts at once.
AT_ONCE = 256


def recursive_parts(docs: DataFrame, key: str, text: str = "text", size: int = CHUNK) -> DataFrame:
    """``key``, part (from 0), text: ``recursive_split`` as rows, which leave a worker some texts at a time."""
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))

    def run(batches):
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            at, part, parts = [], [], []
            for k, x in enumerate(batch.column(1).to_pylist()):
                spans = split_spans(x, size) if x else []
                at += [k] * len(spans)
                part += range(len(spans))
                parts += [x[a:b] for a, b in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(part, pa.int32()), pa.array(parts, pa.string())], names=[key, "part", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())]))
