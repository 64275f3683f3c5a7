"""Chat formatting: any known record layout to canonical turns, and turns to marked text with a loss mask.

A layout is recognised by a fingerprint, the SHA-256 of nested field paths. The fingerprint of the table's schema (of its paths that
some mapping names) is looked up among the declarative mappings; a table that holds several layouts has none of them,
and then each record's own fingerprint, of the paths that are not null in it, is looked up. Everything after that is column
expressions. Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts get a tilde after their first
character (one more than they had), which ``unescaped`` takes away again.

Defined cases: a null text is empty and a null role is the empty role; unknown roles stay as they are;
turns are ordered by turn (null last), role and text, and repeated rows stay repeated turns; a null conv_id is a
conversation of its own; a record whose array of turns is null or empty has no turns and stays, with an empty text; a record of
no declared fingerprint follows the mapping with the most of its paths and must not have other paths of mappings,
or it is an error (``strict=False``: they are ignored); an empty table gives no rows; columns that no mapping names are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import free

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, after their first character: fixed values.
CONTROLS = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|SYS>>|/SYS>>)"
#: Names for the canonical roles: fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: an array of records, single fields in order, or a row per turn."""

    name: str
    array: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()  # (role, field path); fields of the same role are joined by a blank line
    order: str | None = None
    key: str | None = None
    paths: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        inner = [f"{self.array}[].{x}" if self.array else x for x in (self.role, self.text) if x]
        object.__setattr__(self, "paths", tuple(sorted([*inner, *(p for _, p in self.fields), *filter(None, [self.order, self.key])])))

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


MAPPINGS = (
    Mapping("turn rows", role="role", text="text", order="turn", key="conv_id"),
    Mapping("messages", array="messages", role="role", text="content"),
    Mapping("from and value", array="conversations", role="from", text="value"),
    Mapping("instruction with input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction and response", fields=(("user", "instruction"), ("assistant", "response"))),
    Mapping("system, prompt, response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, ``[]`` for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()


def known_paths(schema: T.StructType, key: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> list[str]:
    """The schema's paths that some mapping names, without the record's key."""
    named = {p for m in mappings for p in m.paths}
    return sorted(p for p in field_paths(schema) if p in named and p != key)


def choose(schema: T.StructType, key: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[Mapping | None, list[Mapping]]:
    """(the mapping that the schema's fingerprint selects, or none; mappings that records may follow, those with most paths first)."""
    paths = known_paths(schema, key, mappings)
    by_print = {fingerprint([p for p in m.paths if p != key]): m for m in mappings}
    fits = sorted((m for m in mappings if set(m.paths) - {key} <= set(paths)), key=lambda m: -len(m.paths))
    if not fits:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(schema))}")
    return by_print.get(fingerprint(paths)), fits


def record_layout(schema: T.StructType, key: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS, strict: bool = True) -> Column:
    """Number, among the mappings that fit the schema, of the one whose fingerprint a record's non-null paths have."""
    _, fits = choose(schema, key, mappings)
    paths = known_paths(schema, key, mappings)
    there = {p: F.col(p.split("[]")[0]).isNotNull() for p in paths}
    present = F.array_compact(F.array(*(F.when(there[p], F.lit(p)) for p in paths)))
    table = F.create_map(*(F.lit(x) for i, m in enumerate(fits) for x in (fingerprint([p for p in m.paths if p != key]), i)))
    other = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(fits))):
        own = [p for p in m.paths if p != key]
        rest = [there[p] for p in paths if p not in own]
        fault = F.raise_error(F.concat(F.lit(f"a record has paths beside those of {m.name}: "), F.concat_ws(", ", present))).cast("int")
        chosen = F.when(reduce(lambda a, b: a | b, rest), fault).otherwise(F.lit(i)) if strict and rest else F.lit(i)
        other = F.when(reduce(lambda a, b: a & b, (there[p] for p in own)), chosen).otherwise(other)
    none = F.raise_error(F.concat(F.lit("no mapping for a record with the paths "), F.concat_ws(", ", present))).cast("int")
    return F.coalesce(F.try_element_at(table, F.sha2(F.concat_ws("|", present), 256)), other, F.when(F.size(present) > 0, none))


def _role(role: Column) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for name, canonical in ROLES.items():
        out = F.when(F.lower(role) == name, canonical).otherwise(out)
    return out


def _turns(m: Mapping) -> Column:
    """Array of the turns (turn, role, text) that a mapping reads from a record."""
    none = F.lit("")

    def turn(n: Column, role: Column, text: Column) -> Column:
        return F.struct(n.cast("long").alias("turn"), role.alias("role"), text.alias("text"))

    if m.array:
        return F.transform(m.array, lambda x, n: turn(n, _role(x[m.role]), F.coalesce(x[m.text].cast("string"), none)))
    if m.fields:
        roles = list(dict.fromkeys(r for r, _ in m.fields))
        joined = {r: F.concat_ws("\n\n", *(F.when(F.col(p) != "", F.col(p)) for x, p in m.fields if x == r)) for r in roles}
        turns = F.array(*(turn(F.lit(i), F.lit(r), joined[r]) for i, r in enumerate(roles)))
        return F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))
    return F.array(turn(F.col(m.order), _role(F.col(m.role)), F.coalesce(F.col(m.text), none)))


def canonical_turns(df: DataFrame, key: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS, strict: bool = True) -> DataFrame:
    """conv_id, turn, role, text of records in any layouts that mappings describe; key: their id column.

    A record without turns gives one row with null turn, role and text.
    """
    selected, fits = choose(df.schema, key, mappings)
    if selected is not None:
        turns = _turns(selected)
    else:
        (layout,) = free(df.columns, "layout")
        df, turns = df.withColumn(layout, record_layout(df.schema, key, mappings, strict)), F.lit(None)
        for i, m in enumerate(fits):
            turns = F.when(F.col(layout) == i, _turns(m)).otherwise(turns)
    return df.select(F.col(key).alias("conv_id"), F.explode_outer(turns).alias("x")).select("conv_id", "x.turn", "x.role", "x.text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + CONTROLS, "$1~$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + CONTROLS, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans of canonical turns; a turn with a null role is none.

    loss_spans: array of (start, length) in characters of ``formatted``, its first being 1: the texts of
    the roles in learn_from, in order. A running sum of lengths places each turn, so the work is linear in
    a conversation's length; ordering, sum and grouping share one shuffle by conversation.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text").alias("at"),
        F.when(F.col("role").isNotNull(), F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))).alias("head"),
        F.when(F.col("role").isNotNull(), escaped(F.coalesce("text", F.lit("")))).alias("body"),
        F.coalesce(F.col("role").isin(*learn_from), F.lit(False)).alias("learn"),
    )
    before = W.partitionBy("conv_id").orderBy("at.none", "at.turn", "at.role", "at.text")
    size = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    rows = rows.withColumn("n", F.row_number().over(before)).withColumn("end", F.sum(size).over(before.rowsBetween(W.unboundedPreceding, 0)))
    turn = F.struct(
        "n",
        F.concat("head", "body", F.lit(END + "\n")).alias("marked"),
        F.when(F.col("learn"), F.struct((F.col("end") - F.length("body") - len(END)).cast("int").alias("start"), F.length("body").alias("length"))).alias("span"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    return grouped.select(
        "conv_id",
        F.concat_ws("", F.transform("ts", lambda t: t["marked"])).alias("formatted"),
        F.filter(F.transform("ts", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_in(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.regexp_replace(p, r"(?s)^[^\n]*\n", "")).alias("text"),
        ),
    )


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask of a formatted conversation, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"], s["length"]))))
