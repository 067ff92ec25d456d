"""Documents as structure: headings to chapters and sections, packed section texts, chunks of tables, flags, descriptions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, is_missing, word_count
from ..workers import ship
from . import chunking, tabular

# Patterns of headings, visual labels and notes, names and limits.
CHAPTER = r"(?i)^(Chapter|Spotlight|Part)\s+([A-Za-z]?[0-9]+(?:\.[0-9]+)*)(?:\s*[:.\-]\s*|\s+)(.+)$"
NUMBERED_CHAPTER = r"^([0-9]+)\s+([A-Z][^\n]{3,})$"
SECTION = r"^([0-9]+(?:\.[0-9]+){1,3})\s+([A-Z][^\n]{2,})$"
VISUAL_LABEL = r"(?i)^(Figure|Fig\.?|Chart|Diagram|Image|Map|Table|Box|Spotlight)\s+([A-Za-z]?[0-9]+(?:\.[0-9]+)*)(?:\s*[:.\-]\s*|\s+)?(.*)$"
SOURCE_NOTE = r"(?i)^(Source|Sources|Note|Notes)\s*:\s*.+$"
TABLE_FILE = r"(?i)page_([0-9]+)_Table_([A-Za-z]?[0-9]+(?:\.[0-9]+)*)\.csv$"
FRONT_NUMBER, FRONT_TITLE = "0", "Front Matter"
TOKEN_LIMIT, LONGEST_TITLE, MOST_TITLE_WORDS = 650, 110, 16
CHART_START, CHART_END = "[CHART DESCRIPTION]", "[/CHART DESCRIPTION]"


def headings(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc, n, page, place, text) with kind (chapter, section, subsection, skipped, text), number and title.

    A chapter is said so, or is a number and a title among the first two blocks of a page; its title is
    short and no sentence. Labels of visuals and source notes are skipped. Where blocks tell by a column body that they are
    body text, their form (an address like 28.68.191.238 before a sentence) makes no heading of them.
    """
    t = F.col("text")
    free = ~F.coalesce("body", F.lit(False)) if "body" in blocks.columns else F.lit(True)
    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    plain = lambda c: (F.length(c) <= LONGEST_TITLE) & (word_count(c) <= MOST_TITLE_WORDS) & ~c.rlike("[.?!]$")
    said, counted = collapsed(part(CHAPTER, 3)), collapsed(part(NUMBERED_CHAPTER, 2))
    # a text that says it is a chapter but isn't one may still be no numbered one: that starts with a digit
    chapter = F.when(said.isNotNull() & plain(said), F.struct(F.initcap(part(CHAPTER, 1)).alias("label"), part(CHAPTER, 2).alias("number"), said.alias("title")))
    chapter = chapter.when(counted.isNotNull() & (F.col("place") <= 2) & plain(counted), F.struct(F.lit("Chapter").alias("label"), part(NUMBERED_CHAPTER, 1).alias("number"), counted.alias("title")))
    rows = blocks.withColumn("_c", F.when(free, chapter)).withColumn("_s", F.when(free, part(SECTION, 1)))
    deep = F.size(F.split("_s", "[.]")) >= 3
    kind = F.when(F.col("_c").isNotNull(), "chapter").when(F.col("_s").isNotNull() & deep, "subsection").when(F.col("_s").isNotNull(), "section").when(
        free & (t.rlike(VISUAL_LABEL) | t.rlike(SOURCE_NOTE)), "skipped",
    ).otherwise("text")
    whole = F.when(
        F.col("_c").isNotNull(), F.concat(F.col("_c.label"), F.lit(" "), F.col("_c.number"), F.lit(": "), F.col("_c.title")),
    ).when(F.col("_s").isNotNull(), F.concat_ws(" ", "_s", collapsed(part(SECTION, 2))))
    return rows.withColumn("kind", kind).withColumn("number", F.coalesce("_c.number", "_s")).withColumn("title", whole).drop("_c", "_s")


def placed(blocks: DataFrame) -> DataFrame:
    """``headings`` with chapter_number, chapter_title, section_title and subsection_title in force at each block, and run: the headings so far.

    A chapter starts a section of its own name, and every heading above ends the subsection.
    """
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("kind")
    last = lambda holds, value, otherwise: F.coalesce(F.last(F.when(holds, value), ignorenulls=True).over(w), F.lit(otherwise))
    return headings(blocks).withColumns(
        {
            "chapter_number": last(kind == "chapter", F.col("number"), FRONT_NUMBER),
            "chapter_title": last(kind == "chapter", F.col("title"), FRONT_TITLE),
            "section_title": last(kind.isin("chapter", "section"), F.col("title"), FRONT_TITLE),
            "subsection_title": last(kind.isin("chapter", "section", "subsection"), F.when(kind == "subsection", F.col("title")).otherwise(""), ""),
            "run": F.count_if(kind.isin("chapter", "section", "subsection")).over(w),
        }
    )


def section_chunks(blocks: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc, n, page, chapter and section columns, text: the texts of a page and section together, up to ``limit`` tokens.

    A heading or a new page ends a chunk, and so does a block that would pass the limit; one block alone may pass it.
    """
    rows = placed(blocks).filter("kind = 'text'")
    w = Window.partitionBy("doc").orderBy("n")
    starts = (F.lag("page").over(w) != F.col("page")) | (F.lag("run").over(w) != F.col("run"))
    rows = chunking.islands(rows, ["doc"], "n", F.coalesce(starts, F.lit(True)))
    state = F.col("chapter_number"), F.col("chapter_title"), F.col("section_title"), F.col("subsection_title")
    lists = rows.groupBy("doc", "island", "page").agg(
        *[F.min(c).alias(name) for c, name in zip(state, ("chapter_number", "chapter_title", "section_title", "subsection_title"))],
        F.array_sort(F.collect_list(F.struct("n", "text", word_count(F.col("text")).alias("tokens")))).alias("xs"),
    )
    # which blocks start a chunk: a page's blocks are few, so they are folded
    fold = F.aggregate(
        "xs",
        F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now")),
        lambda s, x: F.when(
            (F.size(s["now"]) > 0) & (s["held"] + x["tokens"] > limit),
            F.struct(x["tokens"].alias("held"), F.concat(s["done"], F.array(s["now"])).alias("done"), F.array(x["text"]).alias("now")),
        ).otherwise(F.struct((s["held"] + x["tokens"]).alias("held"), s["done"].alias("done"), F.concat(s["now"], F.array(x["text"])).alias("now"))),
        lambda s: F.concat(s["done"], F.array(s["now"])),
    )
    parts = lists.withColumn("first", F.col("xs")[0]["n"]).select(
        "doc", "first", "page", "chapter_number", "chapter_title", "section_title", "subsection_title", F.posexplode(fold).alias("k", "texts"),
    )
    order = Window.partitionBy("doc").orderBy("first", "k")
    return parts.withColumn("n", F.row_number().over(order).cast("long")).withColumn("text", F.trim(F.array_join("texts", "\n\n"))).drop("first", "k", "texts")


def chapter_ranges(blocks: DataFrame) -> DataFrame:
    """doc, chapter_number, chapter_title, page_start, page_end: a chapter ends on the page before the next one, the last on the last page."""
    rows = headings(blocks)
    w = Window.partitionBy("doc").orderBy("n")
    last = rows.groupBy("doc").agg(F.max_by("page", "n").alias("last_page"))
    chapters = rows.filter("kind = 'chapter'").withColumn("next", F.lead("page").over(w)).join(last, "doc")
    end = F.greatest("page", F.coalesce(F.col("next") - 1, "last_page"))
    return chapters.select("doc", F.col("number").alias("chapter_number"), F.col("title").alias("chapter_title"), F.col("page").alias("page_start"), end.alias("page_end"))


def sections_of_markdown(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n, section of markdown: a heading starts one, a block of a chart's description is one of its own."""
    rows = docs.select(key, F.posexplode(F.split(text, "\r\n|[\n\r]")).alias("pos", "line")).withColumn("_s", F.trim("line"))
    w = Window.partitionBy(key).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, closes = F.col("_s") == CHART_START, F.col("_s") == CHART_END
    mark = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(upto)
    rows = rows.withColumn("_in", F.coalesce(mark, F.lit(False)) | closes).withColumn("_after", F.coalesce(F.lag(closes).over(w), F.lit(False)))
    rows = chunking.islands(rows, [key], "pos", opens | F.col("_after") | (F.col("_s").startswith("#") & ~F.col("_in")), "n")
    joined = F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"), "^\\s+|\\s+$", ""))
    return rows.groupBy(key, "n").agg(joined.alias("section")).filter("section <> ''")


def chunked(docs: DataFrame, key: str, text: str = "text", size: int = chunking.CHUNK, overlap: int = chunking.OVERLAP) -> DataFrame:
    """key, n, text, whole of documents with source_type: rows of tables as they are, markdown by section.

    A section with a table or a chart's description stays whole; others are split. Each chunk of a document
    stands behind the end of the one before it. Rows of csv types are chunks already.
    """
    ready = docs.filter(F.col("source_type").isin("csv", "extracted_table_csv")).filter(F.trim(text) != "")
    ready = ready.select(key, F.lit(1).cast("long").alias("n"), F.col(text).alias("text"), F.lit(True).alias("whole"))
    rest = docs.filter(~F.coalesce(F.col("source_type").isin("csv", "extracted_table_csv"), F.lit(False)))
    whole = F.col("section").startswith(CHART_START) | F.contains("section", F.lit("|"))
    rows = sections_of_markdown(rest, key, text).withColumn("whole", whole)
    split = rows.filter(~whole).select(key, "n", "whole", F.posexplode(chunking.recursive_split(size)(F.col("section"))).alias("_part", "text"))
    kept = rows.filter(whole).select(key, "n", "whole", F.lit(0).alias("_part"), F.col("section").alias("text"))
    order = Window.partitionBy(key).orderBy("n", "_part")
    parts = kept.unionByName(split).withColumn("place", F.row_number().over(order).cast("long"))
    parts = chunking.char_overlap(parts, key, "place", overlap=overlap)
    return parts.select(key, F.col("place").alias("n"), F.col("overlapped").alias("text"), "whole").unionByName(ready)


def _or(*values: Column) -> Column:
    """The first that says something."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def country_chunks(rows: DataFrame) -> DataFrame:
    """code, text, is_aggregate of rows (code, name, table_name, region, income, rest of the metadata); rows without a code are none."""
    name = _or(F.col("name"), F.col("table_name"))
    text = F.concat(
        F.lit("Country metadata for "), F.coalesce(name, F.col("code")), F.lit(" ("), F.col("code"), F.lit("): Region = "), F.coalesce(_or(F.col("region")), F.lit("unknown")),
        F.lit("; Income group = "), F.coalesce(_or(F.col("income")), F.lit("unknown")), F.lit("."),
    )
    return rows.filter(_or(F.col("code")).isNotNull()).select("code", text.alias("text"), tabular.aggregate_entity(F.coalesce(name, F.lit("")), F.col("code")).alias("is_aggregate"))


def indicator_chunks(rows: DataFrame) -> DataFrame:
    """code, text of rows (code, name, note); rows without a code are none."""
    text = F.concat(
        F.lit("Indicator metadata: "), F.col("code"), F.lit(" = "), F.coalesce(_or(F.col("name")), F.lit("")), F.lit(". Source note: "),
        F.coalesce(_or(F.col("note")), F.lit("not provided")), F.lit("."),
    )
    return rows.filter(_or(F.col("code")).isNotNull()).select("code", text.alias("text"))


def table_chunks(tables: DataFrame) -> DataFrame:
    """file, chunk_id, page, text of extracted tables (file, headers array, rows array of arrays): summary, columns, a chunk for each row that says something.

    Name and page come from the file's name; a table whose name isn't of that form has the name of its file and no page.
    """
    page = F.nullif(F.regexp_extract("file", TABLE_FILE, 1), F.lit("")).cast("int")
    entity = F.concat(F.lit("Table "), F.when(page.isNotNull(), F.regexp_extract("file", TABLE_FILE, 2)).otherwise(F.regexp_extract("file", "([^/]+?)(?:[.][^./]*)?$", 1)))
    t = tables.withColumn("page", page).withColumn("entity", entity).withColumn("names", F.array_join(F.transform("headers", lambda h: F.trim(h)), ", "))
    key = F.concat(F.lit("tablecsv::"), F.replace("entity", F.lit(" "), F.lit("_")))
    from_page = F.coalesce(F.concat(F.lit(" from page "), F.col("page")), F.lit(""))
    summary = F.concat(F.lit("Extracted table "), "entity", from_page, F.lit(". Columns: "), "names", F.lit(". Row count: "), F.size("rows"), F.lit("."))
    columns = F.concat(F.lit("Extracted table "), "entity", F.lit(" column names: "), "names", F.lit("."))
    heads = t.select("file", F.concat(key, F.lit("::summary")).alias("chunk_id"), "page", summary.alias("text"))
    heads = heads.unionByName(t.select("file", F.concat(key, F.lit("::columns")).alias("chunk_id"), "page", columns.alias("text")))
    rows = t.select("file", "page", "entity", "headers", key.alias("key"), F.posexplode("rows").alias("k", "row"))
    pairs = F.filter(F.arrays_zip(F.transform("headers", lambda h: F.trim(h)).alias("h"), F.col("row").alias("v")), lambda p: (p["h"] != "") & ~is_missing(p["v"]))
    facts = F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(" = "), F.trim(p["v"]))), "; ")
    rows = rows.withColumn("facts", facts).filter("facts <> ''")
    said = F.concat(F.lit("Extracted table "), "entity", F.lit(" row "), F.col("k") + 1, F.lit(": "), "facts", F.lit("."))
    return heads.unionByName(rows.select("file", F.concat("key", F.lit("::row::"), F.col("k") + 1).alias("chunk_id"), "page", said.alias("text")))


def enrichment(text: Column, metadata: Column) -> Column:
    """struct of flags that a chunk's text and metadata (a map) give."""
    said = lambda k: F.coalesce(F.lower(metadata[k]).isin("true", "1", "yes"), F.lit(False))
    holds = lambda x: F.coalesce(F.contains(text, F.lit(x)), F.lit(False))
    equal = lambda k, v: F.coalesce(metadata[k] == v, F.lit(False))
    return F.struct(
        (said("contains_chart") | said("contains_chart_description") | holds(CHART_START)).alias("contains_chart"),
        (said("contains_table") | holds("|---") | holds("Table summary:")).alias("contains_table"),
        (equal("source_type", "csv") | equal("type", "csv_row")).alias("contains_csv_semantic_sentence"),
        (equal("type", "diagram") | F.coalesce(F.contains(F.lower(text), F.lit("diagram")), F.lit(False))).alias("contains_diagram"),
    )


def described(visuals: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Visuals with the description of their path, and whether there is one; of several the one that sorts last."""
    d = descriptions.groupBy("path").agg(F.max("description").alias("description"))
    return visuals.join(d, "path", "left").withColumn("described", F.col("description").isNotNull())


def lookup_line(name: Column, code: Column, indicator: Column, year: Column, value: Column) -> Column:
    """A line of a lookup sheet; a missing value says so."""
    shown = F.when(is_missing(value), F.lit("no data")).otherwise(value)
    return F.concat_ws(" | ", name, code, indicator, year.cast("string"), shown)


def series_text(name: Column, code: Column, indicator: Column, indicator_code: Column, years: Column, total: Column) -> Column:
    """What a series (its sorted years with data) covers."""
    head = F.concat(F.lit("Country: "), name, F.lit(" ("), code, F.lit("). Indicator: "), indicator, F.lit(", code "), indicator_code, F.lit(". "))
    some = F.concat(
        F.lit("Annual values are available for "), F.size(years), F.lit(" years from "), F.get(years, F.lit(0)), F.lit(" to "), F.get(years, F.size(years) - 1),
        F.lit(" within a source series spanning "), total, F.lit(" years."),
    )
    return F.concat(head, F.when(F.size(years) > 0, some).otherwise(F.lit("The source CSV contains the row structure, but all annual values in the detected year columns are missing.")))


PROBE, PROBE_WORDS, LONG_WORD = 160, 10, 5
#: Characters of a text that mostly hold its probe.
PROBE_PART = 400
_WORDS = re.compile("[a-z0-9]+").findall


def _plain(x: str | None) -> str:
    return " ".join(_WORDS((x or "").lower()))


def _probe(x: str | None) -> str:
    """The beginning of the normalised text; of a long text no more is normalised than that takes."""
    start = _plain(x[:PROBE_PART]) if x else ""
    return (start if len(start) >= PROBE or not x or len(x) <= PROBE_PART else _plain(x))[:PROBE].strip()


class _Pages:
    """Pages (number, normalised text), by number, of one document, behind one another, so that they are searched at once."""

    def __init__(self, pages: list[tuple[int, str]]):
        self.numbers = [p for p, _ in pages]
        self.body = "\n".join(t for _, t in pages)  # no probe and no word has a line end
        self.starts = np.cumsum([0, *(len(t) + 1 for _, t in pages[:-1])]).tolist()
        self.held: dict[str, np.ndarray] = {}

    def _at(self, place: int) -> int:
        return bisect_right(self.starts, place) - 1

    def holding(self, word: str) -> np.ndarray:
        """Which pages hold ``word``; each is looked for once."""
        out = self.held.get(word)
        if out is None:
            found, place = [], self.body.find(word)
            while place >= 0:
                found.append(self._at(place))
                place = self.body.find(word, self.starts[found[-1] + 1]) if found[-1] + 1 < len(self.starts) else -1
            out = self.held[word] = np.array(found, np.int64)
        return out

    def next(self, probe: str, last: int) -> int:
        """The page of a text, from ``last`` on and then from the start."""
        first = bisect_left(self.numbers, last)
        start = self.starts[first] if first < len(self.starts) else len(self.body)
        place = self.body.find(probe, start)
        if place < 0 < start:
            place = self.body.find(probe, 0, start)
        if place >= 0:
            return self.numbers[self._at(place)]
        words = [w for w in probe.split() if len(w) >= LONG_WORD][:PROBE_WORDS]
        need = max(2, min(4, len(words)))
        if len(words) >= need:
            n = np.zeros(len(self.numbers), np.int64)
            for w in words:
                n[self.holding(w)] += 1
            enough = np.flatnonzero(n >= need)
            if len(enough):
                return self.numbers[enough[np.searchsorted(enough, first) % len(enough)]]
        return last if first < len(self.numbers) and self.numbers[first] == last else self.numbers[0]


def _paged(batches):
    """doc, n, page of rows (doc, text?, n or page, text) that come by document, its pages first, both in order."""
    doc, last, pages, known = object(), 1, [], None
    for batch in batches:
        docs, ns, found = [], [], []
        for d, is_text, n, text in zip(*(c.to_pylist() for c in batch.columns)):
            if d != doc:
                doc, last, pages, known = d, 1, [], None
            if not is_text:
                if pages and pages[-1][0] == n:
                    pages[-1][1].append(_plain(text))
                else:
                    pages.append((n, [_plain(text)]))
                continue
            if known is None:
                known = _Pages([(p, " ".join(filter(None, ts))) for p, ts in pages])
            probe = _probe(text) if known.numbers else ""
            last = known.next(probe, last) if probe else last
            docs.append(d)
            ns.append(n)
            found.append(last)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, ns, found)], names=["doc", "n", "page"])


def inferred_pages(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, n, page of texts (doc, n, text), by the pages (doc, page, page_text) of their document.

    The first page, from the one found last on and then from the start, that holds the text's normalised beginning, else
    one with most of its first long words, else the page found last. It depends on the texts before, so a document's
    texts are read in order, as a sorted stream behind its pages; documents without pages have page 1.
    """
    ship(texts.sparkSession)
    kinds = [F.col("doc").cast("long").alias("doc"), F.lit(True).alias("is_text"), F.col("n").cast("long").alias("n"), "text"]
    stored = pages.filter("page is not null").select(kinds[0], F.lit(False).alias("is_text"), F.col("page").cast("long").alias("n"), F.col("page_text").alias("text"))
    rows = texts.select(*kinds).unionByName(stored).repartition("doc")
    return rows.sortWithinPartitions("doc", "is_text", F.col("n").asc_nulls_last(), "text").mapInArrow(_paged, "doc long, n long, page long")


def cross_references(records: DataFrame) -> DataFrame:
    """doc, n, entities, references of records (doc, n, page, text, entities like 'Table 4.1').

    A row of a table without a label takes the table named last in its source. References are the other
    kind's entity of the same identifier, wherever it is, and those of the other kind on the same page.
    """
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tables = F.filter("entities", lambda e: e.startswith("Table "))
    last = F.last(F.when(F.size(tables) > 0, F.element_at(tables, -1)), ignorenulls=True).over(w)
    inherits = (F.size(tables) == 0) & F.contains("text", F.lit("|"))
    rows = records.withColumn("_last", last).withColumn(
        "entities",
        F.when(inherits & F.col("_last").isNotNull(), F.array_distinct(F.concat("entities", F.array("_last")))).otherwise(F.col("entities")),
    )
    each = rows.select("doc", "n", "page", F.posexplode("entities").alias("k", "entity")).withColumn("other", F.when(F.col("entity").startswith("Table "), "Figure").otherwise("Table"))
    each = each.withColumn("mate", F.concat_ws(" ", "other", F.substring_index("entity", " ", -1)))
    named = each.select(F.col("entity").alias("mate")).distinct()
    same = each.join(named, "mate").select("doc", "n", F.struct(F.col("k"), F.lit(0).alias("r"), F.col("mate").alias("e")).alias("x"))
    # entities of a page, each once
    on_page = each.filter("page is not null").select("doc", "page", F.substring_index("entity", " ", 1).alias("other"), F.col("entity").alias("near")).distinct()
    near = each.join(on_page, ["doc", "page", "other"]).select("doc", "n", F.struct(F.col("k"), F.lit(1).alias("r"), F.col("near").alias("e")).alias("x"))
    refs = same.unionByName(near).groupBy("doc", "n").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    refs = refs.select("doc", "n", F.array_distinct(F.transform("xs", lambda x: x["e"])).alias("references"))
    return rows.select("doc", "n", "entities").join(refs, ["doc", "n"], "left").withColumn("references", F.coalesce("references", F.array().cast("array<string>")))


def snippets(rows: DataFrame, by: str, order: str, text: Column, skip: Column, reach: int = 3, most: int = 3) -> DataFrame:
    """``rows`` with snippets: the first ``most`` texts up to ``reach`` rows before and behind each, skipped ones left out."""
    w = Window.partitionBy(by).orderBy(order)
    said = F.when(~skip & (text != ""), text)
    before, after = F.collect_list(said).over(w.rowsBetween(-reach, -1)), F.collect_list(said).over(w.rowsBetween(1, reach))
    return rows.withColumn("snippets", F.array_join(F.slice(F.concat(before, after), 1, most), " "))
