"""Chat formatting: layouts told by a fingerprint of their field paths, mapped to
canonical turns, and written in one reversible template."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallymill.llm.common import column, let, prefix_sums

START, SAYS, END = "<|start|>", "<|says|>", "<|end|>"
# Control strings of this and of common other templates. In a text
# a backslash parts the first character of each from the rest.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLES = ("assistant",)


class Layout(NamedTuple):
    """How records with exactly these field paths become turns.

    Either ``turns``: (role, field) pairs, or (role, (field, field)) to join two
    fields by a blank line; or ``messages``: an array field with the names of its
    role and text fields, and names of roles to change.
    """

    name: str
    turns: tuple[tuple[str, str | tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    roles: dict[str, str] = {}

    def paths(self) -> list[str]:
        if self.messages:
            field, role, text = self.messages
            return sorted([f"{field}[].{role}", f"{field}[].{text}"])
        return sorted({f for _, fs in self.turns for f in ([fs] if isinstance(fs, str) else fs)})


LAYOUTS = (
    Layout("messages", messages=("messages", "role", "content")),
    Layout(
        "from_value", messages=("conversations", "from", "value"),
        roles={"human": "user", "gpt": "assistant"},
    ),
    Layout("prompt", (("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt", (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", (("user", ("instruction", "input")), ("assistant", "output"))),
)


def field_paths(schema: T.StructType, at: str = "", value: Column | None = None) -> list[tuple[str, Column]]:
    """(path, whether a row has it) of every leaf; an array's fields count as there
    if the array is."""
    out = []
    for f in schema.fields:
        here = column(f.name) if value is None else value[f.name]
        kind, path = f.dataType, f"{at}{f.name}"
        if isinstance(kind, T.StructType):
            inner = field_paths(kind, f"{path}.", here)
            out += [(p, here.isNotNull() & there) for p, there in inner]
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += [(f"{path}[].{e.name}", here.isNotNull()) for e in kind.elementType.fields]
        else:
            out.append((path, here.isNotNull()))
    return sorted(out, key=lambda x: x[0])


def fingerprint(schema: T.StructType) -> Column:
    """Hash of the sorted paths of the fields that a row has."""
    present = [F.when(there, F.lit(path)) for path, there in field_paths(schema)]
    return F.xxhash64(F.concat_ws("\n", *present))


def escaped(text: Column) -> Column:
    rest = "|".join(re.escape(c[1:]) for c in CONTROL)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={rest})", r"$1\\")


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``: a lone backslash after an opening sign goes, pairs
    become one."""
    bare = F.regexp_replace(text, r"([<\[])\\(?!\\)", "$1")
    return F.replace(bare, F.lit("\\\\"), F.lit("\\"))


def _turns(layout: Layout, schema: T.StructType) -> Column:
    none = F.lit("")
    if layout.messages:
        field, role, text = layout.messages

        def turn(m: Column) -> Column:
            named = F.coalesce(m[role].cast("string"), none)
            for old, new in layout.roles.items():
                named = F.when(m[role] == old, F.lit(new)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(m[text].cast("string"), none).alias("text"))

        return F.transform(column(field), turn)
    said = [
        (role, column(f).cast("string") if isinstance(f, str) else F.concat_ws("\n\n", *map(column, f)))
        for role, f in layout.turns
    ]
    return F.array(*[F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in said])


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """(layout name, turns) of each record; null where no layout fits."""
    fields, have = set(), records.schema
    for path, _ in field_paths(have):
        fields.add(path)
    known = [x for x in layouts if set(x.paths()) <= fields]
    mark = fingerprint(have)
    name = F.lit(None).cast("string")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in known:
        fits = mark == F.xxhash64(F.lit("\n".join(x.paths())))
        name = F.when(fits, F.lit(x.name)).otherwise(name)
        turns = F.when(fits, _turns(x, have)).otherwise(turns)
    return name, turns


def format_chats(
    records: DataFrame, id_cols: list[str], layouts: tuple[Layout, ...] = LAYOUTS,
    trained: tuple[str, ...] = TRAINED_ROLES,
) -> DataFrame:
    """The id columns with (layout, formatted, segments) of each record.

    All columns but ``id_cols`` are the record; those that are null in a row are
    not there. The hash of the paths of the rest selects the layout. A turn is
    written as start mark, role, says mark, text, end mark; roles and texts are
    escaped, so no mark can be forged. ``segments`` has for each turn the place of
    its escaped text in ``formatted``, in code points, and whether it is trained
    on: the loss mask. ``read_chats`` undoes it all.

    A record that no layout fits gets nulls; null texts and roles within a
    message are empty; no turns make an empty text. Repeated records are
    formatted each for itself. An empty table gives an empty one.
    """
    body = records.drop(*id_cols)
    layout, turns = canonical_turns(body, layouts)
    step = records.select(*map(column, id_cols), layout.alias("layout"), turns.alias("turns"))
    step = step.select(*map(column, id_cols), "layout", F.transform("turns", lambda t: F.struct(
        escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"),
        t["role"].isin(list(trained)).alias("loss"),
    )).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit(SAYS))
    whole = lambda t: F.concat(head(t), t["text"], F.lit(END))
    step = step.select(
        "*", F.transform("turns", lambda t: F.char_length(whole(t)).cast("bigint")).alias("lengths")
    )

    def segments(before: Column) -> Column:
        def segment(t: Column, i: Column) -> Column:
            start = F.get(before, i) + F.char_length(head(t))
            end = start + F.char_length(t["text"])
            return F.struct(start.alias("start"), end.alias("end"), t["loss"].alias("loss"))

        return F.transform("turns", segment)

    return step.select(
        *map(column, id_cols), "layout",
        F.array_join(F.transform("turns", whole), "").alias("formatted"),
        let(prefix_sums(F.col("lengths")), segments).alias("segments"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    turns = F.filter(F.split(formatted, re.escape(END), -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SAYS, 1)
        text = F.substring(piece, F.char_length(role) + len(SAYS) + 1, F.char_length(piece))
        return F.struct(
            unescaped(F.substring(role, F.lit(len(START) + 1), F.char_length(role))).alias("role"),
            unescaped(text).alias("text"),
        )

    return F.transform(turns, turn)


def loss_text(turns: Column, segments: Column) -> Column:
    """All text under the loss mask, read back."""
    kept = let(segments, lambda s: F.filter(turns, lambda _, i: F.get(s, i)["loss"]))
    return F.array_join(F.transform(kept, lambda t: t["text"]), "")
