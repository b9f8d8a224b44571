"""Rows of many shapes projected into training text. Null and missing fields are one: the next alternative is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window

from corpusmill.functions.text import BLANKS

# Tags, and the names a field may have, in their order.
USER, ASSISTANT = "<|user|>", "<|assistant|>"
PROBLEM, SOLUTION = ("problem", "question"), ("generated_solution", "solution", "answer")
INSTRUCTION, RESPONSE = ("instruction", "prompt", "query", "question"), ("output", "response", "answer", "chosen")
TURNS, ROLE, VALUE = ("conversations", "messages", "conversation"), ("from", "role", "user"), ("value", "content", "text")
ASSISTANT_ROLES = ("assistant", "gpt", "bot")
NOT_TEXT = ("id", "url", "license")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def stringified(value: Column, kind: DataType) -> Column:
    """A value of any type as text: null is empty, a list has a line for each item, a map or record "key: value" lines by key."""
    none = F.lit("")
    if isinstance(kind, StringType):
        return F.coalesce(value, none)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_join(F.transform(value, lambda x: stringified(x, kind.elementType)), "\n"), none)
    if isinstance(kind, MapType):
        lines = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(stringified(e["key"], kind.keyType), F.lit(": "), stringified(e["value"], kind.valueType)))
        return F.coalesce(F.array_join(lines, "\n"), none)
    if isinstance(kind, StructType):
        lines = [F.concat(F.lit(f"{f.name}: "), stringified(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNull(), none).otherwise(F.concat_ws("\n", *lines))
    if isinstance(kind, BooleanType):
        return F.when(value, "True").when(~value, "False").otherwise("")
    return F.coalesce(value.cast("string"), none)


def first_of(columns: list[str], names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(n).cast("string") for n in names if n in columns], F.lit(""))


def tag(role: Column) -> Column:
    return F.when(F.lower(role).isin(*ASSISTANT_ROLES), ASSISTANT).otherwise(USER)


def problem_solution(columns: list[str]) -> Column:
    """Null where it does not apply."""
    p, s = stripped(first_of(columns, PROBLEM)), stripped(first_of(columns, SOLUTION))
    return F.when((p != "") & (s != ""), F.concat(F.lit("Problem:\n"), p, F.lit("\n\nSolution:\n"), s))


def instruction_response(columns: list[str]) -> Column:
    inst, more, resp = (stripped(first_of(columns, n)) for n in (INSTRUCTION, ("input",), RESPONSE))
    user = F.when(more != "", F.concat(inst, F.lit("\n"), more)).otherwise(inst)
    return F.when((inst != "") & (resp != ""), F.concat(F.lit(f"{USER}\n"), user, F.lit(f"\n{ASSISTANT}\n"), resp))


def conversation(turns: Column, fields: list[str]) -> Column:
    """From an array of structs; null below two turns with text."""
    of = lambda t, names: F.coalesce(*[t[n].cast("string") for n in names if n in fields], F.lit(""))
    parts = F.transform(turns, lambda t: F.struct(tag(of(t, ROLE)).alias("tag"), stripped(of(t, VALUE)).alias("value")))
    parts = F.filter(parts, lambda p: p["value"] != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda p: F.concat(p["tag"], F.lit("\n"), p["value"])), "\n"))


def by_priority(columns: list[str], names: list[str]) -> tuple[Column, Column]:
    """(text, name) of the first named field that is neither null nor empty."""
    here = [n for n in names if n in columns]
    text = F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in here], F.lit(None).cast("string"))
    name = F.coalesce(*[F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", n) for n in here], F.lit(None).cast("string"))
    return text, name


def text_like(rows: DataFrame) -> Column:
    """All string fields longer than 20 characters, joined by line ends; null if there is none."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string" and f.name.lower() not in NOT_TEXT]
    parts = F.filter(F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<string>"), lambda x: F.length(x) > 20)
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def selected_text(rows: DataFrame, spec: dict) -> DataFrame:
    """rows with text and selected_text_field by the source's formatter, its field or fields, or all that looks like text."""
    columns, tries = rows.columns, []
    formatter = spec.get("formatter")
    if formatter == "problem_solution":
        tries.append((problem_solution(columns), F.lit("problem+generated_solution")))
    if formatter in ("instruction_response", "chatml"):
        tries.append((instruction_response(columns), F.lit("instruction+response")))
    if formatter == "conversation" and (name := next((n for n in TURNS if n in columns), None)):
        fields = rows.schema[name].dataType.elementType.fieldNames()
        tries.append((conversation(F.col(name), fields), F.lit("conversation")))
    if field := spec.get("text_field"):
        tries.append((F.coalesce(F.col(field).cast("string"), F.lit("")) if field in columns else F.lit(""), F.lit(field)))
    elif names := spec.get("text_field_priority"):
        tries.append(by_priority(columns, names))
    tries.append((text_like(rows), F.lit("__concat_text_like__")))
    text = F.coalesce(*[t for t, _ in tries], F.lit(""))
    label = F.coalesce(*[F.when(t.isNotNull(), n) for t, n in tries])
    return rows.withColumns({"text": text, "selected_text_field": label})


def stamped(rows: DataFrame, source: str, domain: str, subdomain: str, split: str | None = None) -> DataFrame:
    return rows.withColumns({"source": F.lit(source), "domain": F.lit(domain), "subdomain": F.lit(subdomain)} | ({"split": F.lit(split)} if split else {}))


def chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation in order, where at least two have text. A row holds one conversation."""
    rows = conversations.select("conv_id", "turn", tag(F.coalesce("role", F.lit(""))).alias("tag"), stripped(F.coalesce("text", F.lit(""))).alias("value")).where("value <> ''")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "tag", "value"))).alias("t")).where(F.size("t") >= 2)
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["tag"], F.lit("\n"), x["value"])), "\n").alias("text"))


def prompts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): user turns answered by the next turn, an assistant's."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumns({"next_role": F.lead("role").over(by), "response": F.lead("text").over(by)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


def loader_ids(rows: DataFrame, encode: Callable[[Column], Column], eos: int | None = 3, separator: str = "\n") -> Column:
    """A record's ids: its own, else those of prompt, separator and response, else those of its text, with the end id; fewer than two get two pads.

    A record has what is not null in it.
    """
    field = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    between = F.coalesce(field("separator", "string"), F.lit(separator))
    text = F.coalesce(F.concat(field("prompt", "string"), between, field("response", "string")), field("text", "string"), F.lit(""))
    made = encode(text) if eos is None else F.concat(encode(text), F.array(F.lit(eos)))
    ids = F.coalesce(field("input_ids", "array<int>"), made)
    return F.when(F.size(ids) < 2, F.concat(ids, F.array(F.lit(0), F.lit(0)))).otherwise(ids)


def prompt_ids(ids: Column, bos: int = 2) -> Column:
    """The ids with the begin id in front, once."""
    return F.when(F.coalesce(F.get(ids, F.lit(0)) == bos, F.lit(False)), ids).otherwise(F.concat(F.array(F.lit(bos)), ids))


def spoken_ids(ids: Column, special: int = 3) -> Column:
    """The ids that stand for text: those beyond the special ones."""
    return F.filter(ids, lambda x: x > special)


def example(ids: Column, length: int, start: Column | None = None) -> dict[str, Column]:
    """input_ids cropped or padded to length, labels without loss on pads, and the mask."""
    at = F.lit(0) if start is None else start
    cut = F.when(F.size(ids) >= length, F.slice(ids, at + 1, length)).otherwise(F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))))
    return {"input_ids": cut, "labels": F.transform(cut, lambda x: F.when(x == 0, -100).otherwise(x)), "attention_mask": F.transform(cut, lambda x: F.when(x == 0, 0).otherwise(1))}


def crop_start(ids: Column, length: int, key: Column, seed: int) -> Column:
    """A seeded place to cut a longer row."""
    drawn = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (drawn % F.greatest(F.size(ids) - length + 1, F.lit(1))).cast("int")
