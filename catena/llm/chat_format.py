"""Chat formatting by schema fingerprints: declarative mappings to canonical turns.

A record's layout is fingerprinted by hashing its sorted nested field paths.
The fingerprint selects one mapping, given as data, that says where role and
text are; canonical turns are then rendered with a template that marks turns
and escapes control strings reversibly. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Roles whose text is under the loss mask.
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """A mapping: turns either one row each, in a list of structs, or in named columns.

    kind "rows": conversation, order, role and text are column names.
    kind "list": turns is an array column of structs with fields role and text.
    kind "fields": fields is a list of (column, role), in the order of turns.
    roles renames foreign role names.
    """

    kind: str
    conversation: str = "conv_id"
    order: str = "turn"
    role: str = "role"
    text: str = "text"
    turns: str = "messages"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


def field_paths(kind: T.DataType, path: str = "") -> list[str]:
    """Nested field paths with type classes, as in messages[].role:string."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{path}.{f.name}" if path else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, path + "[]")
    return [f"{path}:{kind.typeName()}"]


def fingerprint(schema: T.StructType, only: set[str] | None = None) -> int:
    """A 64-bit FNV-1a hash of the sorted field paths, of the top-level columns in only if given."""
    kept = T.StructType([f for f in schema.fields if only is None or f.name in only])
    h = 0xCBF29CE484222325
    for byte in "\n".join(field_paths(kept)).encode():
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    return h


#: The layouts known from the start: a row for each turn, message lists, instruction and prompt pairs.
KNOWN: list[tuple[str, Layout]] = [
    ("conv_id long, turn long, role string, text string", Layout("rows")),
    ("conv_id long, messages array<struct<role:string,content:string>>", Layout("list", text="content")),
    ("conv_id long, conversations array<struct<from:string,value:string>>", Layout("list", turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant")))),
    ("conv_id long, instruction string, input string, output string", Layout("fields", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")))),
    ("conv_id long, prompt string, completion string", Layout("fields", fields=(("prompt", "user"), ("completion", "assistant")))),
    ("conv_id long, prompt string, response string", Layout("fields", fields=(("prompt", "user"), ("response", "assistant")))),
]


def _known() -> list[tuple[set[str], int, Layout]]:
    out = []
    for ddl, layout in KNOWN:
        schema = T._parse_datatype_string(ddl)
        out.append(({f.name for f in schema.fields}, fingerprint(schema), layout))
    return sorted(out, key=lambda x: -len(x[0]))


def choose_layout(schema: T.StructType) -> Layout:
    """The mapping whose fingerprint the schema has on the mapping's own columns; extra columns don't count.

    Integer types count as long. The mapping with the most columns wins.
    """
    wide = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else f.dataType) for f in schema.fields])
    for names, mark, layout in _known():
        if names <= set(wide.names) and fingerprint(wide, names) == mark:
            return layout
    raise ValueError(f"no mapping for the layout {field_paths(schema)}")


def escape(c: Column) -> Column:
    """Put a backslash more between < and | wherever only backslashes stand there."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def canonical_turns(records: DataFrame, layout: Layout | None = None) -> DataFrame:
    """One row per conversation: conv_id, turns array<struct<role,text>>, in order.

    Rows of one turn number (repeats too) all stay, ordered by role, then text.
    A null role or text is empty, a null turn number comes first, a null
    conv_id is a conversation of its own. A null or absent list has no turns.
    Fields that are null (as an absent input) make no turn.
    """
    layout = layout or choose_layout(records.schema)
    conv = F.col(layout.conversation).cast("long").alias("conv_id")

    def turn(role: Column, text: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        for old, new in layout.roles:
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.kind == "rows":
        t = turn(F.col(layout.role), F.col(layout.text))
        rows = records.select(conv, F.struct(F.col(layout.order).cast("long").alias("o"), t.alias("t")).alias("x"))
        return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]).alias("turns"))
    if layout.kind == "list":
        got = F.transform(F.filter(F.col(layout.turns), lambda x: x.isNotNull()), lambda x: turn(x[layout.role], x[layout.text]))
        return records.select(conv, F.coalesce(got, F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))
    got = F.array(*[F.when(F.col(c).isNotNull(), turn(F.lit(role), F.col(c))) for c, role in layout.fields])
    return records.select(conv, F.filter(got, lambda x: x.isNotNull()).alias("turns"))


def format_chats(records: DataFrame, layout: Layout | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    A turn is START role newline text END newline. The role is URL-encoded, so
    that it holds no newline or control string; the text is escaped. loss_spans
    is an array of (begin, length) in characters of formatted, from 0: the text
    of each assistant turn, in order. No turns give an empty string.
    """
    turns = canonical_turns(records, layout)
    role = lambda t: F.url_encode(t["role"])
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss"))).alias("p"))
    tail = END + "\n"
    # The begin of each turn is the sum of the lengths before it: one pass that carries (next begin, spans).
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        n = F.char_length(t["body"]).cast("long")
        begin = acc["at"] + F.char_length(t["head"])
        span = F.array(F.struct(begin.alias("begin"), n.alias("length")))
        none = F.array().cast("array<struct<begin:bigint,length:bigint>>")
        return F.struct((begin + n + len(tail)).alias("at"), F.concat(acc["spans"], F.when(t["loss"], span).otherwise(none)).alias("spans"))

    return parts.select("conv_id", F.array_join(F.transform("p", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"), F.aggregate("p", zero, step)["spans"].alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read format_chats' output back: its columns, turns as before and loss_text, unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        body = F.substr(x, cut + 1, F.char_length(x) - cut - len(END) - 1)
        return F.struct(F.url_decode(F.substr(x, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("*", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"))
