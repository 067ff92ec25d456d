"""Chat formatting: heterogeneous layouts to canonical turns, turns to one marked string, and back.

A layout is known by the fingerprint of its schema, a hash of all nested field paths and types. The
fingerprint selects a declarative mapping, a list of (role, text) paths or the path of a list of
messages. A table of one layout is mapped by its Spark schema, so the choice costs nothing per row; a
column of JSON records of many layouts is fingerprinted record by record.

The template is ``<|start|>role<|sep|>text<|end|>``, one after the other. Inside roles and texts
control strings (this template's and those of other common ones) are escaped by a backslash behind
their first character, and backslashes are doubled, so that nothing a text says can mark a turn
and everything can be read back. All of this is DataFrame functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: The first character of a control string, seen by what follows it.
_CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with their types; the elements of a list are ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [f"{at}:{'string' if isinstance(kind, T.StringType) else 'number' if isinstance(kind, T.NumericType) else kind.simpleString()}"]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """How records of one schema say turns.

    ``fields`` one turn each, ``messages`` a list with role and text fields, or, with ``turn``, a record is one
    turn: its place in the conversation, role and text.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.paths))


LAYOUTS = (
    Layout("prompt-completion", ("prompt:string", "completion:string"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt-response", ("prompt:string", "response:string"), (("user", "prompt"), ("assistant", "response"))),
    Layout("question-answer", ("question:string", "answer:string"), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction:string", "output:string"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input", ("instruction:string", "input:string", "output:string"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system-instruction", ("system:string", "instruction:string", "output:string"), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout(
        "system-instruction-input", ("system:string", "instruction:string", "input:string", "output:string"),
        (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout("messages", ("messages[].role:string", "messages[].content:string"), messages="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from:string", "conversations[].value:string"), messages="conversations", role="from", text="value"),
    Layout("turns", ("turns[].role:string", "turns[].text:string"), messages="turns", role="role", text="text"),
    Layout("turn-rows", ("turn:number", "role:string", "text:string"), role="role", text="text", turn="turn"),
    Layout("turn-rows-content", ("turn:number", "role:string", "content:string"), role="role", text="content", turn="turn"),
    Layout("turn-rows-from", ("turn:number", "from:string", "value:string"), role="from", text="value", turn="turn"),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN = "struct<turn: bigint, role: string, text: string>"


def canonical_role(role: Column) -> Column:
    out = role
    for name, known in ROLES.items():
        out = F.when(F.lower(F.trim(role)) == name, F.lit(known)).otherwise(out)
    return out


def _turns_of(record: Column, layout: Layout) -> Column:
    if layout.messages:
        turns = F.transform(record[layout.messages], lambda m, k: F.struct(k.cast("long").alias("turn"), canonical_role(m[layout.role]).alias("role"), m[layout.text].alias("text")))
        return F.coalesce(turns, F.array().cast(f"array<{TURN}>"))
    turns = [F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), record[path].alias("text")) for k, (role, path) in enumerate(layout.fields)]
    return F.filter(F.array(*turns), lambda t: t["text"].isNotNull() & (t["text"] != "")).cast(f"array<{TURN}>")


def _layout_of(records: DataFrame, key: str, layouts: list[Layout]) -> Layout | None:
    known = {p.split(":")[0].split("[")[0].split(".")[0] for x in layouts for p in x.paths}
    fields = T.StructType([f for f in records.schema.fields if f.name != key and f.name in known])
    return {x.fingerprint: x for x in layouts}.get(fingerprint(field_paths(fields)))


def table_turns(records: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns (key, turn, role, text) of a table whose own schema, without ``key``, is a known layout.

    Columns besides the layout's are left out of the fingerprint if no layout has them. Layouts of a row per
    turn are looked up after the others.
    """
    found = _layout_of(records, key, [x for x in layouts if not x.turn]) or _layout_of(records, key, [x for x in layouts if x.turn])
    if not found:
        raise ValueError(f"no layout has the fields {field_paths(records.drop(key).schema)}")
    if found.turn:
        return records.select(records[key], records[found.turn].alias("turn"), canonical_role(records[found.role]).alias("role"), records[found.text].alias("text"))
    names = {p.split(":")[0].split("[")[0] for p in found.paths}
    record = F.struct(*[records[c] for c in records.columns if c in names])
    return records.select(records[key], F.explode(_turns_of(record, found)).alias("t")).select(key, "t.turn", "t.role", "t.text")


def json_paths(record: Column, layouts: tuple[Layout, ...]) -> Column:
    """Field paths that some layout knows, said ones and null ones, of each parsed record (a variant); others are left out.

    A known field of another type is a path that no layout has, so that its record isn't read without it.
    """

    def kind(v: Column, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

    def kinds_of(x: Layout) -> Column:
        return F.transform(
            F.try_variant_get(record, f"$.{x.messages}", "array<variant>"),
            lambda m: F.struct(F.schema_of_variant(m).alias("whole"), kind(m, x.role).alias("role"), kind(m, x.text).alias("text")),
        )

    def fits(kinds: Column) -> Column:
        text = lambda t: t.isNull() | t.isin("STRING", "VOID")
        each = F.forall(kinds, lambda m: (m["whole"].startswith("OBJECT") | (m["whole"] == "VOID")) & text(m["role"]) & text(m["text"]))
        return F.coalesce(each & F.exists(kinds, lambda m: m["role"].isNotNull()) & F.exists(kinds, lambda m: m["text"].isNotNull()), F.lit(False))

    said, null = [], []
    for name in sorted({p.split(":")[0] for x in layouts for _, p in x.fields}):
        k = kind(record, name)
        said.append(F.when(k != "VOID", F.array(F.concat(F.lit(f"{name}:"), F.when(k == "STRING", F.lit("string")).otherwise(k)))))
        null.append(F.when(k == "VOID", F.array(F.lit(f"{name}:string"))))
    for x in (x for x in layouts if x.messages):
        k = kind(record, x.messages)
        said.append(F.when(k != "VOID", F.when(fits(kinds_of(x)), F.array(*map(F.lit, x.paths))).otherwise(F.array(F.concat(F.lit(f"{x.messages}:"), k)))))
    empty = F.array().cast("array<string>")
    return F.struct(F.concat(*[F.coalesce(p, empty) for p in said]).alias("said"), F.concat(*[F.coalesce(p, empty) for p in null]).alias("null"))


def json_fingerprint(paths: Column, layout: Layout) -> Column:
    """Fingerprint of each record's known paths; a null field stands for the field of ``layout``, or for none."""
    held = F.array_intersect(paths["null"], F.array(*map(F.lit, layout.paths)))
    return F.substring(F.sha2(F.array_join(F.array_sort(F.concat(paths["said"], held)), "\n"), 256), 1, 16)


def json_turns(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns (key, turn, role, text, layout) of a column of JSON records of many layouts.

    Fields that no layout has don't matter, null ones may be any text field. A record of no known layout, or none at all, gives one row with a null layout and no turn.
    """
    records_of = [x for x in layouts if not x.turn]
    rows = records.select(records[key].alias("_key"), records[record].alias("_json"), F.try_parse_json(records[record]).alias("_v"))
    rows = rows.select("_key", "_json", json_paths(F.col("_v"), records_of).alias("_paths"))
    turns, name = F.lit(None).cast(f"array<{TURN}>"), F.lit(None).cast("string")
    for x in sorted(records_of, key=lambda x: len(x.paths)):  # where null fields leave a choice, the layout of most fields
        fits = json_fingerprint(F.col("_paths"), x) == x.fingerprint
        shape = f"{x.messages} array<struct<`{x.role}`: string, `{x.text}`: string>>" if x.messages else ", ".join(f"`{p.split(':')[0]}` string" for p in x.paths)
        turns = F.when(fits, _turns_of(F.from_json("_json", shape), x)).otherwise(turns)
        name = F.when(fits, F.lit(x.name)).otherwise(name)
    return rows.select(F.col("_key").alias(key), name.alias("layout"), F.explode_outer(turns).alias("t")).select(key, "t.turn", "t.role", "t.text", "layout")


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_CONTROL})", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """Columns ``key``, formatted and loss_spans of each conversation.

    Turns stand in order of ``turn`` (null first), ties by role and text, repeated rows are repeated
    turns; a null role or text is empty. loss_spans lists start (from 0) and length, in code points of
    ``formatted``, of what the loss covers: the escaped texts of role ``learn``. Rows of a null key are a
    conversation; an empty table gives no rows. A conversation is one string, so its rows meet in one task,
    sorted there and not held: where a turn starts is a running sum, linear in the turns.
    """
    rows = turns.select(turns[key].alias("key"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    lengths = (F.length(escaped(F.col("role"))) + len(START) + len(SEP)).cast("long"), F.length(escaped(F.col("text"))).cast("long")
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    ends = F.sum(F.col("head") + F.col("body") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"head": lengths[0], "body": lengths[1]}).withColumns({"n": F.row_number().over(order), "end": ends})
    whole = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP), escaped(F.col("text")), F.lit(END))
    start = F.col("end") - F.col("body") - len(END)
    lists = rows.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("n", whole.alias("whole")))).alias("parts"),
        F.sort_array(F.collect_list(F.when(F.col("role") == learn, F.struct(start.alias("start"), F.col("body").alias("length"))))).alias("loss_spans"),
    )
    return lists.select(F.col("key").alias(key), F.array_join(F.transform("parts", lambda p: p["whole"]), "").alias("formatted"), "loss_spans")


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Columns ``key``, turns array<struct<role, text>> and loss_text, read from formatted and loss_spans alone; a null ``formatted`` has null turns."""
    marked = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    turns = F.transform(
        marked,
        lambda x: F.struct(
            unescaped(F.substring_index(F.substring_index(x, SEP, 1), START, -1)).alias("role"),
            unescaped(F.substring_index(x, SEP, -1)).alias("text"),
        ),
    )
    learned = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select(key, turns.alias("turns"), F.array_join(learned, "").alias("loss_text"), "formatted")


def digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted conversations say, as counts and digests."""
    back = read_back(chats, key)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
