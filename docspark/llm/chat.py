"""Chat formatting: records of many layouts to canonical turns, one template, a loss mask.

A layout is known by the hash of its nested field paths. The same fingerprint comes from
a DataFrame's schema (a table of one layout) and from a JSON text (records of mixed
layouts in one column), and it selects a declarative mapping: a schema to read and a SQL
expression that gives ``array<struct<role, text>>``. It is taken of the paths that a layout
reads, so that further fields don't matter; of several layouts the one with most paths is
chosen. Only SQL functions are used.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role: string, text: string>>"


def skeleton(kind: T.DataType) -> str:
    """Nested field paths of a schema: fields by name, ``{`` opens an object, ``[`` an array."""
    if isinstance(kind, T.StructType):
        return "{" + ",".join(f"{f.name}{skeleton(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    if isinstance(kind, T.ArrayType):
        return f"[{skeleton(kind.elementType)}>"
    return ""


def fingerprint(kind: T.DataType) -> str:
    return hashlib.sha256(skeleton(kind).encode()).hexdigest()[:16]


def relevant(kind: T.DataType, wanted: T.DataType) -> T.DataType:
    """``kind`` without the fields that ``wanted`` hasn't; names differ by more than case, as Spark's do."""
    if isinstance(kind, T.StructType) and isinstance(wanted, T.StructType):
        known = {f.name.lower(): f for f in wanted.fields}
        own = [(f, known[f.name.lower()]) for f in kind.fields if f.name.lower() in known]
        return T.StructType([T.StructField(w.name, relevant(f.dataType, w.dataType)) for f, w in own])
    if isinstance(kind, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return T.ArrayType(relevant(kind.elementType, wanted.elementType))
    return kind


def n_paths(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return sum(1 + n_paths(f.dataType) for f in kind.fields)
    return n_paths(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def json_skeleton(values: Column, wanted: T.DataType, lenient: bool = False, listed: bool = False) -> Column:
    """Skeleton of an array of variants, all read as one value, without the fields that ``wanted`` hasn't; null where there is no value.

    If ``lenient``, what an empty list would hold is taken for granted, and so are fields that
    no member of a list has, if members have another of the wanted fields (``listed``: the
    values are members).
    """
    some = F.filter(values, lambda v: v.isNotNull())
    kinds = F.transform(some, F.schema_of_variant)
    if isinstance(wanted, T.StructType):
        inner = lambda path: F.transform(some, lambda v: F.try_variant_get(v, path, "variant"))
        ordered = sorted(wanted.fields, key=lambda f: f.name)
        fields = [F.concat(F.lit(f.name), json_skeleton(inner(f"$['{f.name}']"), f.dataType, lenient)) for f in ordered]
        if lenient and listed:
            some_field = F.coalesce(*fields).isNotNull()
            fields = [F.when(some_field, F.coalesce(c, F.lit(f.name + skeleton(f.dataType)))) for c, f in zip(fields, ordered, strict=True)]
        found, opens = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit(">")), "OBJECT<"
    elif isinstance(wanted, T.ArrayType):
        items = F.flatten(F.transform(some, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))))
        found, opens = F.concat(F.lit("["), F.coalesce(json_skeleton(items, wanted.elementType, lenient, True), F.lit(skeleton(wanted.elementType) if lenient else "")), F.lit(">")), "ARRAY<"
    else:
        nested = F.exists(kinds, lambda k: k.startswith("OBJECT<") | k.startswith("ARRAY<"))
        return F.when(F.size(some) > 0, F.when(nested, "?").otherwise(""))
    return F.when(F.size(some) > 0, F.when(F.forall(kinds, lambda k: k.startswith(opens) | (k == "VOID")), found).otherwise("?"))


def json_fingerprint_of(record: Column, wanted: T.DataType, lenient: bool = False) -> Column:
    """The fingerprint of one JSON text, of the paths in ``wanted`` alone."""
    return F.substring(F.sha2(json_skeleton(F.array(F.try_parse_json(record)), wanted, lenient), 256), 1, 16)


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of one JSON text; null for a text that is not JSON."""
    s = F.schema_of_variant(F.try_parse_json(record))
    s = F.regexp_replace(s, r"(: |(?<=<))(?:STRING|BOOLEAN|VOID|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "")
    s = F.replace(F.replace(F.replace(F.replace(s, F.lit("OBJECT<"), F.lit("{")), F.lit("ARRAY<"), F.lit("[")), F.lit(": "), F.lit("")), F.lit(", "), F.lit(","))
    return F.substring(F.sha2(s, 256), 1, 16)


@dataclass(frozen=True)
class Layout:
    """``turns`` is SQL over the record ``r``, read with ``schema`` (DDL)."""

    name: str
    schema: str
    turns: str
    #: The fields that hold one turn a row together and put its turns in order; without, a row is a conversation.
    key: str | None = None
    order: str | None = None

    @property
    def kind(self) -> T.DataType:
        return T._parse_datatype_string(self.schema)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.kind)


def _pair(ask: str, tell: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {ask}), named_struct('role', 'assistant', 'text', {tell}))"


_JOINED = "concat_ws('\\n\\n', r.instruction, nullif(r.{0}, ''))"
LAYOUTS = (
    Layout("messages", "messages array<struct<role: string, content: string>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from_value", "conversations array<struct<`from`: string, value: string>>", "transform(r.conversations, m -> named_struct('role', m.`from`, 'text', m.value))"),
    Layout("instruction_input", "instruction string, input string, output string", _pair(_JOINED.format("input"), "r.output")),
    Layout("instruction_context", "instruction string, context string, response string", _pair(_JOINED.format("context"), "r.response")),
    Layout("instruction_output", "instruction string, output string", _pair("r.instruction", "r.output")),
    Layout("prompt_completion", "prompt string, completion string", _pair("r.prompt", "r.completion")),
    Layout("prompt_response", "prompt string, response string", _pair("r.prompt", "r.response")),
    Layout("question_answer", "question string, answer string", _pair("r.question", "r.answer")),
    Layout("system_dialog", "system string, dialog array<struct<user: string, assistant: string>>", f"concat(array(named_struct('role', 'system', 'text', r.system)), flatten(transform(r.dialog, d -> {_pair('d.user', 'd.assistant')})))"),
)

# Tables have these layouts besides. The roles of the first are canonical as they stand.
TABLE_LAYOUTS = (
    Layout("turn_rows", "conv_id long, turn long, role string, text string", "named_struct('role', r.role, 'text', r.text)", "conv_id", "turn"),
    Layout("content_rows", "conv_id long, turn long, role string, content string", "named_struct('role', r.role, 'text', r.content)", "conv_id", "turn"),
    Layout("from_value_rows", "conv_id long, turn long, `from` string, value string", "named_struct('role', r.`from`, 'text', r.value)", "conv_id", "turn"),
    Layout("json_records", "record string", "r.record"),
)

# Names that other layouts give to the three roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant"}


def record_turns(record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Turns of the JSON text in column ``record``; null where no layout has its fingerprint.

    Texts that are not JSON, or of an unknown layout, give null: callers see them and no
    row is dropped. A null text inside a known layout is an empty turn text when rendered,
    and so is a field that a listed message hasn't; an empty list of messages gives no turns.
    Of layouts with equally many paths that a record has, the first of ``layouts`` counts.
    """
    chosen = F.lit(None).cast(TURNS)
    # layouts with lists come once more, after all: with lists that are empty or lack a field
    both = [(x, False) for x in by_paths(layouts)] + [(x, True) for x in by_paths(layouts) if "array<" in x.schema]
    for x, lenient in reversed(both):
        turns = F.expr(f"transform(array(from_json(`{record}`, '{x.schema}')), r -> {x.turns})[0]")
        chosen = F.when(json_fingerprint_of(F.col(record), x.kind, lenient) == x.fingerprint, turns.cast(TURNS)).otherwise(chosen)
    return canonical_roles(chosen)


def by_paths(layouts: tuple[Layout, ...]) -> list[Layout]:
    return sorted(layouts, key=lambda x: -n_paths(x.kind))


def canonical_roles(turns: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(names, F.lower(t["role"])), t["role"]).alias("role"), t["text"].alias("text")))


def table_layout(kind: T.StructType) -> Layout:
    """The layout of a table, by the fingerprint of its schema (the case of names doesn't matter; of equally many paths the first layout counts)."""
    for x in by_paths((*TABLE_LAYOUTS, *LAYOUTS)):
        if fingerprint(relevant(kind, x.kind)) == x.fingerprint:
            return x
    raise ValueError(f"no layout has the fields {skeleton(kind)}")


def conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key`` and ``turns`` of every conversation of a table in any known layout.

    A table of an unknown layout is refused; in a table of JSON records, the turns of one of
    an unknown layout are null. Where a row is a conversation, ``key`` is null if the table has none.
    """
    x = table_layout(rows.schema)
    if x.name == "json_records":
        turns = record_turns("record")
    else:
        r = F.struct(*[F.col(f"`{f.name}`") for f in x.kind.fields])
        turns = F.expr(f"transform(array(__r), r -> {x.turns})[0]")
        rows = rows.withColumn("__r", r)
    if x.order:
        one = rows.select(F.col(x.key).alias(key), F.col(x.order).alias("__at"), turns.alias("__turn"))
        got = gather_turns(one.select(key, "__at", "__turn.role", "__turn.text"), key, "__at")
        return got if x.name == "turn_rows" else got.withColumn("turns", canonical_roles(F.col("turns")))
    name = F.col(key) if key in rows.columns else F.lit(None).cast("long").alias(key)
    return rows.select(name, (turns if x.name == "json_records" else canonical_roles(turns.cast(TURNS))).alias("turns"))


# ---- the template ----------------------------------------------------------------------

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control strings of common templates; none may stand unescaped in a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]")
_REST = "|".join(re.escape(x[1:]) for x in CONTROL)


def escape(text: Column) -> Column:
    r"""Put one more backslash behind the first character of every control string.

    A control string with k backslashes there becomes one with k + 1, so that
    ``unescape`` (which takes one away) gives back every text exactly.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*(?:{_REST}))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*(?:{_REST}))", "$1$2")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column) -> Column:
    """``struct(formatted, mask)`` of turns; null roles and texts are empty.

    ``mask`` has for each turn the code points before, in and after the text, and whether
    the text is trained on (that of assistants): the run lengths of the loss mask.
    """
    clean = F.transform(turns, lambda t: F.struct(_role_out(F.coalesce(t["role"], F.lit(""))).alias("role"), escape(F.coalesce(t["text"], F.lit(""))).alias("text"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")))
    return F.transform(
        F.array(clean),
        lambda c: F.struct(
            F.array_join(F.transform(c, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "").alias("formatted"),
            F.transform(c, lambda t: F.struct((F.length(t["role"]) + len(OPEN) + 1).alias("before"), F.length(t["text"]).alias("text"), F.lit(len(CLOSE)).alias("after"), t["loss"].alias("loss"))).alias("mask"),
        ),
    )[0]


def pieces(formatted: Column) -> Column:
    """The turns as they stand in the output, still escaped: ``array<struct<role, text>>``."""
    # The end mark is taken off by its length; an unescaped mark stands nowhere inside.
    parts = F.filter(F.split(formatted, re.escape(OPEN)), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(CLOSE))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), F.substring(body(p), F.locate("\n", p) + 1, F.length(p)).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns read back from a formatted conversation."""
    return F.transform(pieces(formatted), lambda p: F.struct(_role_in(p["role"]).alias("role"), unescape(p["text"]).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    The text is cut out by the mask's run lengths alone. A mask whose runs don't add up to
    the turns of ``formatted``, one after another, is an error.
    """
    parts = F.filter(F.split(formatted, re.escape(OPEN)), lambda p: p != "")
    both = F.arrays_zip(parts.alias("part"), mask.alias("run"))
    inside = lambda z: z["run"]["before"] - len(OPEN)
    behind = lambda z: F.substring(z["part"], inside(z) + z["run"]["text"] + 1, z["run"]["after"] + 1)
    fits = (F.size(parts) == F.size(mask)) & F.forall(both, lambda z: (F.length(z["part"]) == inside(z) + z["run"]["text"] + z["run"]["after"]) & (F.substring(z["part"], inside(z), F.lit(1)) == "\n") & (behind(z) == CLOSE))
    text = F.transform(F.filter(both, lambda z: z["run"]["loss"]), lambda z: unescape(F.substring(z["part"], inside(z) + 1, z["run"]["text"])))
    return F.when(F.coalesce(fits, F.lit(True)), F.array_join(text, "")).otherwise(F.raise_error(F.lit("the mask does not fit the text")))


def gather_turns(rows: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """One row for each ``key`` with its ``turns`` by ``order``; ties by role, then text.

    This is the mapping for tables of one turn a row. A conversation is one training
    example, so its rows do meet; nothing else does. A null key is a conversation too.
    """
    one = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
