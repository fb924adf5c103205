"""Operator 2: chat formatting by schema fingerprints.

Records of any layout come as JSON strings. Which of the nested field paths that layouts name a record has is hashed; the
hash selects a declarative ``Layout``, which turns the record into canonical turns (ordinal, role, text). A record is a
conversation, or, in layouts of single turns, one turn of the conversation that its key names; those turns are gathered.
Turns are written in one template and given a loss mask over the assistant's texts. Native: DataFrame functions only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Reversible escapes: in texts a ``<`` that is followed by
any number of backslashes and a ``|`` gets one more backslash, so ``<|`` never stands in a text; in roles ``%``, line
feeds and ``<|`` are percent-encoded.

Ids are text, kept as the record has them, beside the name of the layout: ids of different layouts never meet, nor do two
records of a whole conversation with one id, or without an id (``conv_id`` is null). Only rows of single turns are
gathered by id.

Defined cases: a null text or role is empty; a very long text is escaped and read back whole, and a conversation's turns are
one row, so it has to fit in a task; a record whose fingerprint no layout has, or that is no JSON, is returned with a null
layout and its ``record``; turns with equal ordinals follow each other by role, then text; repeated rows of turns
are repeated turns, repeated records of conversations are repeated conversations; single turns with a null id are one conversation; empty tables yield no rows; extra columns of a table are
dropped (``turn_records``), fields that no layout names play no part in the fingerprint.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns. ``examples``: records with that shape, one for each set of field paths.

    Either ``items`` names an array with ``role`` and ``text`` fields, or ``fixed`` lists (role, paths of the parts of
    its text), or ``role`` and ``text`` are paths of a record that is one turn itself.
    """

    name: str
    examples: tuple[str, ...]
    key: str
    ordinal: str | None = None
    items: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()


LAYOUTS = (
    Layout("turn_rows", ('{"conv_id":1,"turn":0,"role":"user","text":"a"}',), "$.conv_id", ordinal="$.turn", role="$.role", text="$.text"),
    Layout("messages", ('{"conv_id":1,"messages":[{"role":"user","content":"a"}]}', '{"conv_id":1,"messages":[]}'), "$.conv_id", items="$.messages", role="role", text="content"),
    Layout("from_value", ('{"id":1,"conversations":[{"from":"human","value":"a"}]}', '{"id":1,"conversations":[]}'), "$.id", items="$.conversations", role="from", text="value"),
    Layout(
        "instruction",
        ('{"id":1,"instruction":"a","input":"b","output":"c"}', '{"id":1,"instruction":"a","output":"c"}'),
        "$.id",
        fixed=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",))),
    ),
    Layout("prompt", ('{"id":1,"prompt":"a","completion":"b"}',), "$.id", fixed=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("prompt_response", ('{"id":1,"prompt":"a","response":"b"}',), "$.id", fixed=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout(
        "system_question",
        ('{"id":1,"system":"a","question":"b","response":"c"}',),
        "$.id",
        fixed=(("system", ("$.system",)), ("user", ("$.question",)), ("assistant", ("$.response",))),
    ),
)
#: Other names of roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(layouts: Sequence[Layout]) -> list[tuple[str, str | None]]:
    """(path, field of the items of that array) of everything that the layouts read but the key."""
    found: set[tuple[str, str | None]] = set()
    for x in layouts:
        if x.items:
            found |= {(x.items, None), (x.items, x.role), (x.items, x.text)}
        elif x.fixed:
            found |= {(path, None) for _, paths in x.fixed for path in paths}
        else:
            found |= {(path, None) for path in (x.ordinal, x.role, x.text)}
    return sorted(found, key=str)


def fingerprint(value: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of those field paths of ``layouts`` that a variant has; values and scalar types play no part."""

    def has(path: str, field: str | None) -> Column:
        if field is None:
            return F.try_variant_get(value, path, "variant").isNotNull()
        return F.exists(F.try_variant_get(value, path, "array<variant>"), lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull())

    paths = [F.when(has(path, field), F.lit(path if field is None else f"{path}[*].{field}")) for path, field in field_paths(layouts)]
    return F.when(value.isNotNull(), F.sha2(F.concat_ws("\n", *paths), 256))


def example_fingerprint(example: str, layouts: Sequence[Layout] = LAYOUTS) -> str:
    """The same hash of an example, taken once on the driver."""
    record = json.loads(example)
    paths = [path if field is None else f"{path}[*].{field}" for path, field in field_paths(layouts) if path[2:] in record and (field is None or any(field in x for x in record[path[2:]]))]
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def _turn(ordinal: Column, role: Column, text: Column) -> Column:
    return F.struct(ordinal.cast("bigint").alias("ordinal"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, v: Column) -> Column:
    if layout.items:
        items = F.try_variant_get(v, layout.items, f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        return F.transform(items, lambda x, i: _turn(i, _renamed(x[layout.role]), x[layout.text]))
    if layout.fixed:
        parts = [[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths] for _, paths in layout.fixed]
        turns = F.array(*[_turn(F.lit(i), F.lit(role), F.concat_ws("\n\n", *text)) for i, ((role, _), text) in enumerate(zip(layout.fixed, parts))])
        return F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != ""))
    return F.array(_turn(F.try_variant_get(v, layout.ordinal, "bigint"), F.try_variant_get(v, layout.role, "string"), F.try_variant_get(v, layout.text, "string")))


def _renamed(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(names[F.coalesce(role, F.lit(""))], role)


def canonical_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, turns, record) of each record of ``records`` (record string); layout is null where no fingerprint fits."""
    v = F.col("v")
    names = F.create_map(*[F.lit(x) for layout in layouts for example in layout.examples for x in (example_fingerprint(example, layouts), layout.name)])
    known = records.select("record", F.try_parse_json("record").alias("v")).withColumn("layout", names[fingerprint(v, layouts)])
    key = turns = F.lit(None)
    for layout in layouts:
        fits = F.col("layout") == layout.name
        key, turns = F.when(fits, F.try_variant_get(v, layout.key, "string")).otherwise(key), F.when(fits, _turns(layout, v)).otherwise(turns)
    return known.select(key.alias("conv_id"), "layout", turns.alias("turns"), "record")


def unmapped(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The records that no layout fits."""
    return canonical_turns(records, layouts).filter(F.col("layout").isNull()).select("record")


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("<%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_records(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, formatted, loss_spans, record) of each conversation: its text in the template, and the spans (start, length
    in code points) of the assistant's escaped texts, in order; ``record`` is null but for records without a layout."""
    single = [x.name for x in layouts if not (x.items or x.fixed)]
    turns = canonical_turns(records, layouts)
    gathered = turns.filter(F.col("layout").isin(*single)).select("conv_id", "layout", F.inline("turns")).groupBy("conv_id", "layout")
    whole = turns.filter(F.col("layout").isNull() | ~F.col("layout").isin(*single))
    whole = whole.select("conv_id", "layout", F.coalesce("turns", F.array().cast("array<struct<ordinal:bigint,role:string,text:string>>")).alias("turns"), F.when(F.col("layout").isNull(), F.col("record")).alias("record"))
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("role", F.lit("")).alias("role"), "text")))
    chats = gathered.agg(ordered.alias("turns")).withColumn("record", F.lit(None).cast("string")).union(whole)

    def piece(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        return F.struct((role == "assistant").alias("loss"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape_text(t["text"]).alias("body"))

    def placed(done: Column, p: Column) -> Column:
        begin = done["at"] + F.char_length(p["head"])
        span = F.array(F.struct(begin.alias("start"), F.char_length(p["body"]).cast("bigint").alias("length")))
        return F.struct((begin + F.char_length(p["body"]) + len(END)).alias("at"), F.when(p["loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    pieces = chats.withColumn("pieces", F.transform("turns", piece))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    mapped = F.col("layout").isNotNull()
    return pieces.select("conv_id", "layout", F.when(mapped, formatted).alias("formatted"), F.when(mapped, F.aggregate("pieces", start, placed)["spans"]).alias("loss_spans"), "record")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape_text(F.substring(p, F.char_length(role) + 2, F.char_length(p))).alias("text"))

    return F.transform(bodies, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def turn_records(turns: DataFrame) -> DataFrame:
    """Records of a table that has a row for each turn."""
    return turns.select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
