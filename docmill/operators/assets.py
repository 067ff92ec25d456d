"""Payloads and visual assets: aliases, gates, resolution, binding, boosts, captions, charts, evaluation of visuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, normalised, tokens

# Alias keys of payload fields, points and limits.
ALIASES = {
    "page": ("page_no", "page", "source_page"), "source": ("source_file", "source", "filename"), "title": ("visual_title", "title", "caption_title"),
    "caption": ("caption_text", "caption", "description"),
}
LONGEST_FIELD, EXACT, KIND, REGISTERED = 500, 100, 20, 90
BOOST_SUMMARY, BOOST_ASSET = 0.05, 25.0
CHARTS = (("scatter", "scatter"), ("bar", "bar"), ("line|trend", "line"), ("pie|share", "pie"))
# Words of captions that say much or little of their picture.
TOLD_WELL = " (?:main|summary|compliance|recommendations|typology|evidence) "
TOLD_BADLY = " (?:panel|yields|chapter|this is|based on|cannot convert) "


def payload(raw: Column) -> Column:
    """Canonical fields from a map of free metadata: the first alias that says something, cut to 500 characters."""
    said = lambda k: F.nullif(F.trim(raw[k]), F.lit(""))
    return F.struct(*[F.substring(F.coalesce(*[said(k) for k in keys]), 1, LONGEST_FIELD).alias(name) for name, keys in ALIASES.items()])


def low_value_visual(text: Column, image: Column, caption: Column) -> Column:
    """No image, no caption and fewer than three words."""
    none = lambda c: c.isNull() | (F.trim(c) == "")
    return none(image) & none(caption) & (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r\\f]+")) < 3)


def visual_gate(kind: Column, score: Column, quality: Column | None = None, least: float = 0.3) -> Column:
    """Whether a visual is shown: no paragraph, no poor crop, and no figure that is only a region of the layout."""
    good = (kind != "paragraph") & (F.coalesce(score, F.lit(1.0)) >= least)
    if quality is None:
        return good
    return good & F.coalesce((quality != "chart_expanded_low_quality") & ~((kind == "figure") & (quality == "figure_layout_region_accepted")), F.lit(True))


# Words by which a question on tables is told from others, and words that don't make texts relevant.
TABULAR_WORDS = "gdp emission emissions co2 revenue metric indicator table timeline statistics stats percent percentage income group india ind lka timor-leste tls nauru nru bangladesh nepal bhutan maldives".split()
TABULAR_STOPWORDS = "the and for what is of in to are with by at".split()
RELEVANCE_STOPWORDS = (
    "about above after again against also and any are because before between both can contents could data database document documents does explain find for from give have how into more not pdf qdrant retrieved show "
    "source tell than that the their there this uploaded was what when where which with would your"
).split()


def relevant_enough(intent: Column, asked: Column, said: Column, has_asset: Column, labels: Column | None = None) -> Column:
    """Per structural intent: a telling word or digits on both sides, an asset, else an asked label or a meaningful word.

    ``labels`` are the entities that the question names; if there are any, one of them must be in the text.
    """
    word = lambda c, p: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(p), 0))
    own, here = word(asked, "[a-z0-9_-]+"), word(said, "[a-z0-9_-]+")
    telling = F.filter(own, lambda w: w.isin(*TABULAR_WORDS))
    plain = F.filter(own, lambda w: ~w.isin(*TABULAR_STOPWORDS) & (F.length(w) > 2))
    telling = F.when(F.size(telling) > 0, telling).otherwise(plain)
    tabular = F.arrays_overlap(telling, here) | (asked.rlike("[0-9]") & said.rlike("[0-9]"))
    meaning = F.filter(word(asked, "[a-z][a-z0-9_-]{2,}"), lambda w: ~w.isin(*RELEVANCE_STOPWORDS))
    textual = F.arrays_overlap(meaning, word(said, "[a-z][a-z0-9_-]{2,}"))
    if labels is not None:
        textual = F.when(F.size(labels) > 0, F.exists(labels, lambda x: F.contains(F.lower(said), F.lower(x)))).otherwise(textual)
    return F.when(intent == "TABULAR_NUMERIC", tabular).when(intent == "ASSET_VISUAL", has_asset).otherwise(textual)


def unless_empty(rows: DataFrame, keep: Column, by: str = "query_id") -> DataFrame:
    """Rows that pass, or all of a query's rows if none of them does."""
    any_ = F.max(keep.cast("int")).over(Window.partitionBy(by))
    return rows.withColumn("_any", any_).withColumn("_keep", keep).filter((F.col("_any") == 0) | F.col("_keep")).drop("_any", "_keep")


def boosted(score: Column, text: Column, asset_wanted: Column, asset_here: Column) -> Column:
    """Small bonus for summaries and headers, a large one for the kind of asset that was asked for."""
    return score + F.when(F.lower(text).rlike("summary|header"), BOOST_SUMMARY).otherwise(0.0) + F.when(asset_wanted & asset_here, BOOST_ASSET).otherwise(0.0)


def query_words(c: Column, stopwords: list[str]) -> Column:
    """Sorted distinct words of three letters or more, without stopwords, plural s cut off."""
    words = F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~w.isin(*stopwords))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w))))


def prefix_points(text: Column, words: Column, points: float = 3.5) -> Column:
    """Points for each word that some word of the text starts with."""
    low = normalised(text)
    hit = lambda w: F.contains(F.concat(F.lit(" "), low), F.concat(F.lit(" "), w))
    return F.size(F.filter(words, hit)) * points


def visual_quality(area: Column, exists: Column, caption: Column) -> Column:
    """Points of a picture: its size, that its file exists, and what its caption says and how it ends."""
    said, low = F.coalesce(caption, F.lit("")), F.concat(F.lit(" "), normalised(F.coalesce(caption, F.lit(""))), F.lit(" "))
    ends = F.trim(said)
    cut = F.contains(said, F.lit(").")) | ends.endswith("com-") | ends.endswith("sev-")
    return (
        F.least(F.coalesce(area, F.lit(0)) / 10000.0, F.lit(80.0))
        + F.when(F.coalesce(exists, F.lit(False)), 25.0).otherwise(0.0)
        + F.when(low.rlike(TOLD_WELL), 12.0).otherwise(0.0)
        - F.when(low.rlike(TOLD_BADLY), 25.0).otherwise(0.0)
        - F.when(cut, 18.0).otherwise(0.0)
    )


def topic_points(text: Column, words: Column, quality: Column) -> Column:
    """Ten points for each word that some word of the text starts with (one if nothing is asked for), and a twentieth of the picture's quality."""
    return quality * 0.05 + prefix_points(text, words, 10.0) + F.when(F.size(words) == 0, 1.0).otherwise(0.0)


def resolved(candidates: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """The best path of each request (key, label, kind): exact label, then kind, registered ones first; only paths that exist.

    The registry is brought down to its best path of each label and of each kind, so that a request meets two rows.
    """
    r = registry.filter("exists").select("label", "kind", "path", F.when(F.col("registered"), REGISTERED).otherwise(0).alias("bonus"))
    best = lambda points: F.max(F.struct((F.col("bonus") + points).alias("score"), F.col("path")))
    exact = r.groupBy("kind", "label").agg(best(EXACT).alias("exact"))
    like = r.groupBy("kind").agg(best(KIND).alias("like"))
    met = candidates.join(like, "kind").join(exact, ["kind", "label"], "left").select(key, F.greatest("exact", "like").alias("b"))
    return met.groupBy(key).agg(F.max("b").alias("b")).select(key, F.col("b.path").alias("path"), F.col("b.score").alias("score"))


def bound_image(*choices: Column) -> Column:
    """The first choice that is a path: locked match, vision, pool, fallback."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices])


def clean_caption(c: Column) -> Column:
    """A caption without its leading label and trailing source."""
    c = F.regexp_replace(collapsed(c), "(?i)^(?:figure|fig[.]?|table|chart|box|map)\\s+[0-9]+(?:[.][0-9]+)?[a-z]?\\s*[:.-]?\\s*", "")
    return F.trim(F.regexp_replace(c, "(?i)\\s*source:.*$", ""))


def figure_of_caption(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?i)^\\s*(?:figure|fig[.]?|table|chart|box|map)\\s+([0-9]+(?:[.][0-9]+)?[a-z]?)", 1), F.lit(""))


def caption_score(c: Column) -> Column:
    """100 minus penalties: short, no sentence end, repeated words, odd signs."""
    words = tokens(c)
    penalty = F.when(F.length(c) < 40, 30).otherwise(0) + F.when(~c.rlike("[.!?]\\s*$"), 10).otherwise(0) + F.when(
        F.size(F.array_distinct(words)) * 2 < F.size(words), 25,
    ).otherwise(0) + F.when(c.rlike("[#{}|]{2,}"), 20).otherwise(0)
    return F.lit(100) - penalty


# Blocks that say nothing about a visual, notes, mentions, and the points of an anchor.
BOILERPLATE = r"(?i)\b(?:http|www\.|reproducibility|replication|github|bibliography|references|copyright|doi|isbn|issn)\b"
NOTE_LINE = r"(?i)^(?:Source|Sources|Note|Notes)\s*:\s*.+$"
MENTION = r"(?i)\b(?:figure|table|chart|diagram|image|map)\s+[0-9]"
ANCHOR_ENTITY, ANCHOR_MENTION, ANCHOR_KIND, ANCHOR_NOTE = 10, 3, 2, 1


def anchor_points(text: Column, entity: Column, kind: Column) -> Column:
    """How much a block is about an entity: its name, any label, its kind, a source note."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9.]+", " "))
    holds = lambda x: F.coalesce((x != "") & F.contains(plain(text), x), F.lit(False))
    points = ((holds(plain(entity)), ANCHOR_ENTITY), (text.rlike(MENTION), ANCHOR_MENTION), (holds(kind), ANCHOR_KIND), (text.rlike(NOTE_LINE), ANCHOR_NOTE))
    return sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0))


def best_anchor(rows: DataFrame, by: str, order: str, points: Column, reach: int = 2, boilerplate: Column | None = None) -> DataFrame:
    """Rows within ``reach`` places of each group's best row, the first among equals.

    Rows of ``boilerplate`` go, unless all do: then the best row stays.
    """
    best = rows.withColumn("_p", points).groupBy(by).agg(F.max_by(order, F.struct(F.col("_p"), -F.col(order))).alias("anchor"))
    near = rows.join(best, by).filter(F.abs(F.col(order) - F.col("anchor")) <= reach)
    if boilerplate is None:
        return near
    near = near.withColumn("_b", F.coalesce(boilerplate, F.lit(False)))
    some = F.max((~F.col("_b")).cast("int")).over(Window.partitionBy(by))
    return near.withColumn("_some", some).filter(~F.col("_b") | ((F.col("_some") == 0) & (F.col(order) == F.col("anchor")))).drop("_b", "_some")


def parsed_json(c: Column, schema: str) -> Column:
    """A JSON object as it stands, else within a fence, else between the outermost braces."""
    fenced = F.regexp_extract(c, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    braces = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))
    return F.coalesce(ok(F.trim(c)), ok(F.nullif(fenced, F.lit(""))), ok(F.nullif(braces, F.lit(""))))


def chart_of(c: Column) -> Column:
    """struct(kind, title, unit): the first chart word, the first line that names an asset, the first unit."""
    low = F.lower(c)
    kind = F.lit("table")
    for pattern, name in reversed(CHARTS):
        kind = F.when(low.rlike(pattern), F.lit(name)).otherwise(kind)
    named = F.filter(F.split(c, "\n"), lambda x: F.lower(x).rlike("\\b(?:figure|table|chart)\\b"))
    unit = F.nullif(F.regexp_extract(low, "(percent|million|billion|usd|tons|years|%)", 1), F.lit(""))
    return F.struct(kind.alias("kind"), F.trim(F.get(named, F.lit(0))).alias("title"), unit.alias("unit"))


def chart_row(row: Column) -> Column:
    """struct(series, category, value) from a map whose keys go by several names; swapped fields are put right."""
    pick = lambda *ks: F.coalesce(*[F.nullif(F.trim(row[k]), F.lit("")) for k in ks])
    series, category, value = pick("series", "line", "group"), pick("category", "label", "year", "x"), pick("value", "target", "y")
    swapped = series.rlike("^(?:19|20)[0-9]{2}$") & ~F.coalesce(category, F.lit("")).rlike("^(?:19|20)[0-9]{2}$")
    number = F.replace(F.regexp_replace(value, "[%$]", ""), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(F.when(swapped, category).otherwise(series).alias("series"), F.when(swapped, series).otherwise(category).alias("category"), number.alias("value"))


def pages_of(probes: DataFrame, pages: DataFrame, by: str, key: str, words: int = 10) -> DataFrame:
    """key, page: the first page with at least max(2, min(4, n)) of a text's first ``words`` words of five letters or more."""
    first = F.slice(F.array_distinct(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 5)), 1, words)
    p = probes.select(by, key, first.alias("ws")).withColumn("need", F.greatest(F.lit(2), F.least(F.lit(4), F.size("ws"))))
    on_page = pages.select(by, "page", F.explode(F.array_distinct(tokens(F.col("page_text")))).alias("w"))
    hits = p.select(by, key, "need", F.explode("ws").alias("w")).join(on_page, [by, "w"]).groupBy(by, key, "need", "page").agg(F.count("*").alias("n"))
    return hits.filter("n >= need").groupBy(by, key).agg(F.min("page").alias("page"))


def packed_tokens(parts: Column, most: int) -> Column:
    """Paragraphs packed into chunks of at most ``most`` words; longer ones are cut into windows."""
    words = lambda p: F.filter(F.split(F.trim(p), "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    none = F.array().cast("array<string>")
    windows = lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / most)), lambda k: F.array_join(F.slice(ws, (k * most + 1).cast("int"), most), " "))
    held = lambda now: F.when(F.size(now) > 0, F.array(F.array_join(now, " "))).otherwise(none)

    def step(s: Column, p: Column) -> Column:
        ws = words(p)
        return (
            F.when(F.size(ws) > most, F.struct(F.concat(s["done"], held(s["now"]), windows(ws)).alias("done"), none.alias("now")))
            .when(F.size(s["now"]) + F.size(ws) > most, F.struct(F.concat(s["done"], held(s["now"])).alias("done"), ws.alias("now")))
            .otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], ws).alias("now")))
        )

    return F.aggregate(parts, F.struct(none.alias("done"), none.alias("now")), step, lambda s: F.concat(s["done"], held(s["now"])))


def visual_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates over expected and returned assets: top-1, hit, expected ones hit, false positive, none found, repeated in the list, to three digits."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 3)
    e, r = F.col("expected"), F.col("returned")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), rate(F.get(r, F.lit(0)) == e).alias("top1"), rate(F.array_contains(r, e)).alias("hit"),
        F.coalesce(F.round(F.avg(F.when(e.isNotNull(), F.array_contains(r, e).cast("double"))), 3), F.lit(0.0)).alias("expected_hit"),
        rate(e.isNull() & (F.size(r) > 0)).alias("false_positive"), rate(F.size(r) == 0).alias("no_match"), rate(F.size(F.array_distinct(r)) < F.size(r)).alias("repeated"),
    )


def isolated(c: Column, label: str, reach: int) -> Column:
    """The text around each mention of a label, overlapping stretches merged, joined by an ellipsis."""
    parts = F.split(F.lower(c), label)
    ends = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("xs")),
        lambda s, p: F.struct((s["at"] + F.length(p) + len(label)).alias("at"), F.concat(s["xs"], F.array(s["at"] + F.length(p))).alias("xs")),
        lambda s: s["xs"],
    )
    merged = F.aggregate(
        ends,
        F.array().cast("array<struct<lo: int, hi: int>>"),
        lambda s, x: F.when(
            (F.size(s) > 0) & (F.coalesce(F.get(s, F.size(s) - 1)["hi"], F.lit(-1)) >= x - reach),
            F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(F.get(s, F.size(s) - 1)["lo"].alias("lo"), (x + len(label) + reach).alias("hi")))),
        ).otherwise(F.concat(s, F.array(F.struct(F.greatest(x - reach, F.lit(0)).alias("lo"), (x + len(label) + reach).alias("hi"))))),
    )
    return F.array_join(F.transform(merged, lambda w: F.substring(c, w["lo"] + 1, w["hi"] - w["lo"])), " ... ")


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that are there."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))
