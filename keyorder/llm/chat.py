"""Chat formatting by schema fingerprints, with DataFrame operations only.

Records of any layout become variants.  Each declared ``Layout`` names the
nested field paths that it needs.  Those of them that a record has are hashed,
and the layout whose own hash that equals is chosen: the one with most paths if
several do, the first declared of equals.  It says where turns, roles and texts
are; fields that it doesn't name are ignored, wherever they are.  Canonical
turns are then written with a template whose control strings are escaped inside
roles and texts, and every assistant text is marked by a span for the loss mask.

A record of an undeclared layout, a null record and one that isn't JSON have a
null ``layout``, no turns, and their content in ``unread``; they keep their row.
Null roles and texts are empty, and so is a text that isn't there; a text that is
itself an object or a list without texts is its JSON.  An empty list of turns is
a conversation without turns.  Repeated rows are formatted as often as they
occur.  An empty table gives no rows.  Only the named columns are read, whatever
others are called.  A conversation is one row, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where one layout keeps its turns.

    Either ``turns`` is the path of a list, with paths of ``role`` and ``text``
    in its elements, or ``said`` lists (role, fields): the fields' texts, joined
    by line breaks, are one turn, which is left out when all are null or empty
    and it is ``optional``.  A path ends in "[]" where it leads into a list.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str | None = None
    #: The first that holds something counts.
    text: tuple[str, ...] = ()
    said: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ("system",)
    roles: dict[str, str] = field(default_factory=dict)


#: Role names of another convention.
_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant"}

LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), turns="messages[]", role="role", text=("content",)),
    Layout("message_parts", ("messages[]", "messages[].content[].text", "messages[].role"), turns="messages[]", role="role", text=("content[].text", "content")),
    Layout("message_list", ("[].content", "[].role"), turns="[]", role="role", text=("content",)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations[]", role="from", text=("value",), roles=_SPEAKERS),
    Layout("prompt_response", ("prompt", "response"), said=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), said=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("question", "answer"), said=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), said=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("instruction", "input", "output"), said=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_prompt_response", ("system", "prompt", "response"), said=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


@dataclass(frozen=True)
class TurnTable:
    """Which columns, or fields of columns, of a table hold one turn a row."""

    name: str
    key: str
    order: str
    role: str
    text: str

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.key, self.order, self.role, self.text)


TURN_TABLES = (
    TurnTable("conversation turns", "conv_id", "turn", "role", "text"),
    TurnTable("thread messages", "thread_id", "position", "author", "body"),
    TurnTable("nested messages", "conversation_id", "index", "message.role", "message.content"),
)


@dataclass(frozen=True)
class Template:
    start: str = "<|start|>"
    end: str = "<|end|>\n"
    #: Common beginning of the control strings; broken up inside texts.
    control: str = "<|"
    escape: str = "\\"


def _inside(value: Column, part: str) -> tuple[Column, bool]:
    """What one part of a path leads to in a variant, null if nothing; and whether that is a list of variants."""
    many = part.endswith("[]")
    name = part.removesuffix("[]")
    return F.try_variant_get(value, f"$.{name}" if name else "$", "array<variant>" if many else "variant"), many


def has(value: Column, path: str) -> Column:
    """Whether a variant has a nested path: in a list, some element has the rest of it, or there is no element."""
    part, _, rest = path.partition(".")
    inner, many = _inside(value, part)
    if not rest:
        return inner.isNotNull()
    return F.coalesce((F.size(inner) == 0) | F.exists(inner, lambda x: has(x, rest)) if many else has(inner, rest), F.lit(False))


def fingerprint(record: Column, paths: tuple[str, ...]) -> Column:
    """Hash of those of the paths that the record has, in order of their names."""
    return F.xxhash64(F.concat_ws("\n", *(F.when(has(record, p), F.lit(p)) for p in sorted(paths))))


def declared(layout: Layout) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(layout.paths))))


def _text(value: Column, path: str) -> Column:
    """The string at a path, null if nothing is there; the strings of a list are joined by line breaks."""
    part, _, rest = path.partition(".")
    inner, many = _inside(value, part)
    if many:
        return F.array_join(F.transform(inner, lambda x: _text(x, rest)), "\n")
    return _text(inner, rest) if rest else F.try_variant_get(value, f"$.{part}", "string")


def _turns(record: Column, layout: Layout) -> Column:
    nothing = F.lit("")
    if layout.turns:

        def one(turn: Column) -> Column:
            role = F.coalesce(_text(turn, layout.role), nothing)
            for old, new in layout.roles.items():
                role = F.when(role == old, new).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(*(_text(turn, p) for p in layout.text), nothing).alias("text"))

        return F.transform(_inside(record, layout.turns)[0], one)
    said = []
    for role, fields in layout.said:
        text = F.concat_ws("\n", *(F.nullif(_text(record, f), nothing) for f in fields))
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        said.append(F.when(text == "", F.array().cast(TURNS)).otherwise(F.array(turn)) if role in layout.optional else F.array(turn))
    return F.concat(*said)


def canonical(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns, unread) of records: JSON texts, structs or variants of mixed layouts."""
    kind = records.schema[record_col].dataType.typeName()
    value = F.col(record_col)
    variant = F.try_parse_json(value) if kind == "string" else value if kind == "variant" else F.to_variant_object(value)
    content = value if kind == "string" else F.to_json(variant)
    with_record = records.select(id_col, variant.alias("_record"), content.alias("_content"))
    record = F.col("_record")
    matches = lambda x: record.isNotNull() & (fingerprint(record, x.paths) == declared(x))
    chosen = F.coalesce(*(F.when(matches(x), x.name) for x in sorted(layouts, key=lambda x: -len(x.paths))))
    named = with_record.withColumn("_layout", chosen)
    turns = F.array().cast(TURNS)
    for layout in layouts:
        turns = F.when(F.col("_layout") == layout.name, _turns(record, layout)).otherwise(turns)
    unread = F.when(F.col("_layout").isNull(), F.col("_content"))
    return named.select(id_col, F.col("_layout").alias("layout"), turns.alias("turns"), unread.alias("unread"))


def schema_paths(schema: T.StructType, before: str = "") -> set[str]:
    """Nested field paths of a table's columns."""
    out: set[str] = set()
    for f in schema.fields:
        path, kind = before + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out |= {path} | (schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else set())
    return out


def _print(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def gather(rows: DataFrame, tables: tuple[TurnTable, ...] = TURN_TABLES) -> DataFrame:
    """(key, record) of a table with one turn a row: its nested field paths, hashed, pick the ``TurnTable``.

    Columns that the layout doesn't name are ignored.  Turns of equal order are
    taken by role, then text.  A conversation becomes one record, as its
    formatted text must be one row; only its own turns meet in a task.
    """
    paths = schema_paths(rows.schema)
    t = next((t for t in tables if _print(paths & set(t.paths)) == _print(t.paths)), None)
    if t is None:
        raise ValueError(f"no declared turn table has its columns among {sorted(paths)}")
    turn = F.struct(F.col(t.order), F.coalesce(F.col(t.role), F.lit("")).alias("role"), F.coalesce(F.col(t.text), F.lit("")).alias("content"))
    messages = F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.groupBy(t.key).agg(F.struct(messages.alias("messages")).alias("record"))


def escaped(text: Column, t: Template) -> Column:
    """Reversible: the escape sign is doubled, and one is put inside each beginning of a control string."""
    doubled = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(doubled, F.lit(t.control), F.lit(t.control[0] + t.escape + t.control[1:]))


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)" if t.escape == "\\" else rf"(?s)\Q{t.escape}\E(.)", "$1")


def render(conversations: DataFrame, id_col: str, template: Template = Template(), keep: Sequence[str] = ()) -> DataFrame:
    """(id, columns to keep, formatted, loss_spans): the text, and (start, length) in code points of each assistant text in it."""
    t = template

    def parts(turn: Column) -> Column:
        role = F.replace(escaped(turn["role"], t), F.lit("\n"), F.lit(t.escape + "\n"))
        text = escaped(turn["text"], t)
        head = F.concat(F.lit(t.start), role, F.lit("\n"))
        return F.struct(
            F.concat(head, text, F.lit(t.end)).alias("whole"),
            F.length(head).alias("before"),
            F.length(text).alias("length"),
            (turn["role"] == "assistant").alias("loss"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + p["before"]).alias("start"), p["length"].alias("length"))
        return F.struct(
            (acc["at"] + p["before"] + p["length"] + F.lit(len(t.end))).alias("at"),
            F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    made = conversations.select(id_col, *keep, F.transform("turns", parts).alias("_parts"))
    return made.select(
        id_col,
        *keep,
        F.array_join(F.transform("_parts", lambda p: p["whole"]), "").alias("formatted"),
        F.aggregate("_parts", start, walk)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame, id_col: str, template: Template = Template(), keep: Sequence[str] = ()) -> DataFrame:
    """(id, columns to keep, formatted, turns, loss_text), read from the formatted text and its spans alone."""
    t = template
    segments = F.split("formatted", rf"\Q{t.end}\E")

    def turn(segment: Column) -> Column:
        body = F.substr(segment, F.lit(len(t.start) + 1))
        role = F.regexp_extract(body, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        return F.struct(
            unescaped(role, t).alias("role"),
            unescaped(F.substr(body, F.length(role) + 2), t).alias("text"),
        )

    turns = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), turn)
    under = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"]), t))
    return formatted.select(id_col, *keep, "formatted", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))
