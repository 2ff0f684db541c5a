"""Lists and replies given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _array(text: Column) -> Column:
    return F.from_json(F.when(strip(text).rlike(r"^(?s)\[.*\]$"), strip(text)), "array<string>", {"allowSingleQuotes": "true"})


def parse_elements(text: Column) -> Column:
    """A list from its JSON or literal form, else from a comma-separated one; null and empty give an empty list."""
    split = F.filter(F.transform(F.split(text, "[,，、]"), strip), lambda x: x != "")
    return F.coalesce(_array(text), F.when(~strip(text).startswith("["), split), F.array().cast("array<string>"))


def array_from_reply(reply: Column) -> Column:
    """The array in a model's reply: all of it, a fenced block, a line, or from the first [ to the last ]; else empty."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    line = F.regexp_extract(reply, r"(?m)^\s*(\[[^\n]*\])\s*$", 1)
    span = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.coalesce(_array(reply), _array(fenced), _array(line), _array(span), F.array().cast("array<string>"))


def after_thought(reply: Column) -> Column:
    return F.element_at(F.split(reply, r"</think>\n\n"), -1)


def parse_choice(reply: Column, fields: int = 2) -> Column:
    """A reply "index,rest" or "index,type,reason" as a struct (index, rest...); no number gives a null index, -1 stays."""
    parts = F.split(after_thought(reply), "[,，]", fields)
    index = F.try_to_number(F.nullif(F.regexp_extract(F.get(parts, 0), r"(-?\d+)", 1), F.lit("")), F.lit("S999999999")).cast("int")
    names = ["rest"] if fields == 2 else ["type", "reason"]
    return F.struct(index.alias("index"), *[strip(F.coalesce(F.get(parts, i + 1), F.lit(""))).alias(n) for i, n in enumerate(names)])


def parse_reply_json(reply: Column, schema: str) -> Column:
    """A struct of the parsed reply and an error where it is no JSON of the schema."""
    parsed = F.from_json(F.regexp_extract(after_thought(reply), r"(?s)(\{.*\})", 1), schema)
    return F.struct(parsed.alias("value"), F.when(parsed.isNull(), F.concat(F.lit("not parsed: "), F.coalesce(F.substring(reply, 1, 200), F.lit("null")))).alias("error"))
