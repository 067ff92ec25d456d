"""Query understanding as columns: years, metrics, entities, intents, routes, hints and plan steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, normalised, tokens

# Term lists and patterns that decide intents and routes.
NUMERICAL = "gdp co2 emissions growth value amount number numeric percent percentage capita usd 2020 2021 2022 2023 2024 2025".split()
EXPLANATORY = "explain why how affect impact procedure procedural process policy regulation regulations requirement requirements responsibilities standard standards guidelines definition describe report kyc cdd cip beneficial owner".split()
VISUAL = "chart charts graph graphs figure figures table tables trend visual visuals diagram".split()
ROUTE_EXPLANATORY = ("explain", "describe", "why", "how", "what does", "report", "regulation", "standard", "growth", "impact", "effect", "support")
WEIGHTS = {
    "numerical": {"csv": 3.0, "pdf": 0.35, "unknown": 0.75}, "explanatory": {"csv": 0.65, "pdf": 2.0, "unknown": 0.9},
    "mixed": {"csv": 1.2, "pdf": 1.2, "unknown": 1.0}, "balanced": {"csv": 1.0, "pdf": 1.0, "unknown": 1.0},
}
ASSET_WORDS = "figure|fig |fig[.]|chart|diagram|image|visual|picture|illustration"
TABLE_WORDS = "gdp|emission|co2|revenue|metric|indicator|table|timeline|statistics|stats|percent|percentage|income group"
CSV_MARKERS = "gdp|co2|emission|spreadsheet|indicator|statistics|tabular|csv"
TEXT_MARKERS = "chapter|figure|chart|diagram|visual|summarize|section|image"
ENTITY = "(?i)\\b(figure|fig|table|chart|panel|box|map|diagram)[.]?\\s+([0-9]+(?:[.][0-9]+)?[A-Za-z]?)\\b"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def has_any(words: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, wanted)))


def year(c: Column) -> Column:
    """The year, if exactly one is mentioned."""
    every = F.array_distinct(F.regexp_extract_all(c, F.lit("\\b((?:19|20)[0-9]{2})\\b"), 1))
    return F.when(F.size(every) == 1, every[0])


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "\\b((?:19|20)[0-9]{2})\\b", 1), F.lit(""))


def metrics(c: Column) -> Column:
    n = normalised(c)
    return F.array_compact(F.array(F.when(F.contains(n, F.lit("gdp")), F.lit("gdp")), F.when(n.rlike("co2|carbon dioxide|emission"), F.lit("co2"))))


def topic(c: Column) -> Column:
    return first_match(normalised(c), [("regulation|regulatory", "regulations"), ("standard", "standards"), ("emission|co2", "emissions"), ("growth|gdp", "growth")], "")


def intent(c: Column) -> Column:
    low, words = F.lower(c), tokens(c)
    numerical = low.rlike("[0-9]") | has_any(words, NUMERICAL)
    explanatory = has_any(words, EXPLANATORY) | (low.rlike("^what (is|are) ") & ~numerical)
    return F.when(numerical & explanatory, "mixed").when(numerical, "numerical").when(explanatory, "explanatory").otherwise("balanced")


def source_weight(intent_: Column, source_type: Column) -> Column:
    out = F.lit(1.0)
    for name, weights in WEIGHTS.items():
        for source, w in weights.items():
            out = F.when((intent_ == name) & (source_type == source), F.lit(w)).otherwise(out)
    return out


def source_type(explicit: Column, name: Column) -> Column:
    """csv or pdf as said, else by the file's name, else unknown."""
    said = F.lower(F.coalesce(explicit, F.lit("")))
    return F.when(said.isin("csv", "pdf"), said).when(F.lower(name).endswith(".csv"), "csv").when(F.lower(name).endswith(".pdf"), "pdf").otherwise("unknown")


def structural_intent(c: Column) -> Column:
    return first_match(F.lower(c), [(ASSET_WORDS, "ASSET_VISUAL"), (TABLE_WORDS, "TABULAR_NUMERIC")], "CONCEPTUAL_TEXTUAL")


def orchestrated(c: Column) -> Column:
    """struct(route, csv_query, text_query): which halves of a question go to tables and to texts."""
    low = F.lower(c)
    csv, text = low.rlike(CSV_MARKERS), low.rlike(TEXT_MARKERS)
    last = F.trim(F.element_at(F.split(c, " and "), -1))
    first = F.trim(F.split(c, " and ")[0])
    tabular = F.when(low.rlike("gdp|co2|emission|spreadsheet|table|csv|indicator|statistics"), c).otherwise(last)
    textual = F.when(low.rlike("chapter|figure|chart|diagram|visual|summarize|section"), c).otherwise(first)
    return F.struct(
        F.when(csv & text, "COMBINED").when(csv, "CSV-ONLY").otherwise("TEXT/VISUAL-ONLY").alias("route"),
        F.when(csv & text, tabular).when(csv, c).alias("csv_query"),
        F.when(csv & text, textual).when(~csv, c).alias("text_query"),
    )


def route(c: Column, has_constraints: Column) -> Column:
    """structured, hybrid, visual or pdf: the first rule that holds."""
    n = normalised(c)
    visual = has_any(F.split(n, " "), VISUAL)
    about_numbers = n.rlike("gdp|co2|carbon dioxide|emission") & n.rlike("[0-9]")
    only_numbers = about_numbers & ~visual & ~n.rlike("|".join(ROUTE_EXPLANATORY))
    rules = ((only_numbers, "structured"), (has_constraints, "hybrid"), (visual, "visual"))
    return F.coalesce(*[F.when(holds, F.lit(name)) for holds, name in rules], F.lit("pdf"))


def namespace_route(c: Column) -> Column:
    n = normalised(c)
    exact = year(c).isNotNull() & (F.size(metrics(c)) > 0) & ~n.rlike("explain|why|how|describe")
    return (
        F.when(exact, "structured_exact").when(c.rlike(ENTITY), "visual_exact").when(
            has_any(F.split(n, " "), VISUAL), "visual_semantic",
        ).when(F.size(F.split(n, " ")) <= 3, "hybrid_short").otherwise("text_semantic")
    )


def entity_labels(c: Column) -> Column:
    """Mentions of assets in the canonical form Kind_ID, in order of their first mention."""
    kinds = F.regexp_extract_all(c, F.lit(ENTITY), 1)
    ids = F.regexp_extract_all(c, F.lit(ENTITY), 2)
    kind = lambda k: F.when(F.lower(k).startswith("fig"), F.lit("Figure")).otherwise(F.initcap(F.lower(k)))
    return F.array_distinct(F.zip_with(kinds, ids, lambda k, i: F.concat(kind(k), F.lit("_"), F.upper(i))))


def chapter(c: Column) -> Column:
    """Number of the first chapter mentioned, arabic or roman up to x."""
    said = F.lower(F.regexp_extract(c, "(?i)\\bchapter\\s+([0-9]{1,3}|[ivx]+)\\b", 1))
    roman = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_to_number(said, F.lit("999")).cast("int"), roman[said])


def comparative(c: Column) -> Column:
    return F.lower(c).rlike("\\b(?:compare|comparison|versus|vs|difference between|higher than|lower than)\\b")


def hints(c: Column, countries: list[str] | None = None, visual: Column | None = None) -> Column:
    """struct of the filters that a question implies, and how many of nine signals it gives.

    ``countries`` are names to look for (one alone is a signal), ``visual`` tells whether only visuals are wanted.
    """
    page = F.nullif(F.regexp_extract(normalised(c), "\\bpage ([0-9]{1,4})\\b", 1), F.lit(""))
    file = F.nullif(F.regexp_extract(c, "(?i)([A-Za-z0-9_-]+[.]pdf)", 1), F.lit(""))
    y, m, t = year(c), metrics(c), F.nullif(topic(c), F.lit(""))
    labels = entity_labels(c)
    figure = F.when(F.size(labels) > 0, labels[0])
    metric = F.when(F.size(m) == 1, m[0])
    padded = F.concat(F.lit(" "), normalised(c), F.lit(" "))
    named = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {x.lower()} ")), F.lit(x)) for x in countries or [""]]))
    country = F.when(F.size(named) == 1, named[0])
    wants = F.when(F.coalesce(visual, F.lit(False)), F.lit("visual")) if visual is not None else F.lit(None).cast("string")
    signals = sum((x.isNotNull().cast("int") for x in (country, y, metric, t, figure, page, file, wants)), F.lit(1))
    confidence = F.when(signals == 1, F.lit(0.25)).otherwise(F.round(F.greatest(signals / 9, F.lit(0.35)), 2))
    return F.struct(
        country.alias("country"), y.alias("year"), metric.alias("metric"), t.alias("topic"), figure.alias("figure"), page.alias("page"), file.alias("file"), wants.alias("visual_type"), confidence.alias("confidence")
    )


def plan_steps(entities: Column, metrics_: Column, year_: Column) -> Column:
    """One sub-query for each entity and metric, all with the shared year."""
    return F.flatten(F.transform(entities, lambda e: F.transform(metrics_, lambda m: F.concat_ws(" ", m, F.lit("of"), e, year_))))


def filter_from(hints_: dict[str, object]) -> Column | None:
    """AND of conditions from a filter dict: scalar =, list IN, dict gte/gt/lte/lt; nulls are skipped."""
    out = None
    for name, want in hints_.items():
        parts = []
        if isinstance(want, dict):
            ops = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__"}
            parts = [getattr(F.col(name), ops[k])(v) for k, v in want.items() if v is not None]
        elif isinstance(want, (list, tuple)):
            parts = [F.col(name).isin(*want)]
        elif want is not None:
            parts = [F.col(name) == want]
        for p in parts:
            out = p if out is None else out & p
    return out


# The planner's countries and indicators by their canonical names, and words of a comparison.
COUNTRIES = {
    "india": "India", "china": "China", "united states": "United States", "usa": "United States", "us": "United States", "uk": "United Kingdom",
    "united kingdom": "United Kingdom", "uae": "United Arab Emirates",
}
COMPARING = r"(?i)\b(?:compare|contrast|versus|vs\.?|difference|differences|compared)\b"
COUNTRY_NAMED = r"(?i)\b(india|china|united states|usa|us|uk|united kingdom|uae)\b"
INDICATOR_NAMED = r"(?i)\b(gdp|co2|carbon dioxide|emissions)\b"
PARTED = r"(?i)\b(?:and|vs\.?|versus|compare|contrast)\b"


def compared_steps(c: Column) -> Column:
    """One question for each country and indicator of a comparison of two countries or more, else none."""
    known = F.create_map(*[x for k, v in COUNTRIES.items() for x in (F.lit(k), F.lit(v))])
    places = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(COUNTRY_NAMED), 1), lambda x: known[F.lower(x)]))
    what = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(INDICATOR_NAMED), 1), lambda x: F.when(F.lower(x) == "gdp", "GDP").otherwise("CO2 emissions")))
    years = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([0-9]{4})\b"), 1))
    when = F.when(F.size(years) == 1, F.concat(F.lit(" in "), years[0])).otherwise("")
    steps = F.flatten(F.transform(places, lambda p: F.transform(what, lambda w: F.concat(F.lit("What was "), p, F.lit(" "), w, when, F.lit("?")))))
    return F.when(c.rlike(COMPARING) & (F.size(places) >= 2), steps).otherwise(F.array().cast("array<string>"))


def split_steps(c: Column) -> Column:
    """The parts of a question between and, versus, compare ... as questions, each once (whatever its case)."""
    parts = F.transform(F.split(F.trim(c), PARTED), lambda p: F.regexp_replace(p, "^[ ,?]+|[ ,?]+$", ""))
    asked = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(p, F.lit("?")))
    return F.filter(asked, lambda x, k: F.array_position(F.transform(asked, lambda y: F.lower(y)), F.lower(x)) == k + 1)


def planned(c: Column) -> Column:
    """The steps of a comparison, else the parts of the question; the one year that a comparison names is added to steps without one."""
    steps = compared_steps(c)
    steps = F.when(F.size(steps) > 0, steps).otherwise(split_steps(c))
    years = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([0-9]{4})\b"), 1))
    dated = F.transform(steps, lambda s: F.when(s.rlike(r"\b[0-9]{4}\b"), s).otherwise(F.concat(F.regexp_replace(s, "[ ?]+$", ""), F.lit(" in "), years[0], F.lit("?"))))
    return F.when(c.rlike(COMPARING) & (F.size(years) == 1), dated).otherwise(steps)


def hint_filter(hints_: dict[str, object], relaxed: bool = False) -> Column | None:
    """The metadata filter of hints: a country's code beats its name, any visual is no type, and a relaxed one keeps the broad fields only."""
    names = {"source_type": "source_type", "country_iso3": "country_iso3", "country_name": "country_name", "year": "year", "content_type": "content_type"}
    strict = {"indicator_family": "metric_family", "page": "page", "source_filename": "source_files", "topic": "topic", "figure_id": "figure_id", "visual_type": "visual_type"}
    wanted = {column: hints_[name] for name, column in (names | ({} if relaxed else strict)).items() if hints_.get(name)}
    if "country_iso3" in wanted:
        wanted.pop("country_name", None)
    if wanted.get("visual_type") == "visual":
        del wanted["visual_type"]
    return filter_from(wanted)
