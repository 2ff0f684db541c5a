"""Text expressions: names, annotations, tokens, item lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closing brackets by their opening ones.
BRACKETS = {"(": ")", "（": "）", "【": "】", "［": "］", "「": "」", "《": "》", "<": ">", "[": "]"}
#: What an annotation is, in the order in which they go: bracketed parts, then tails.
ANNOTATIONS = (r"\(.*?\)", r"（.*?）", r"\[.*?\]", r"<.*?>", r"\{.*?\}", r"【.*?】", r"《.*?》", r"—.*$", r":.*$", r"：.*$")
CJK = "[一-鿿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def clean_name(text: Column) -> Column:
    """A name without its code prefix: after the first space, else after a leading bracket pair, else after 、, else from
    the first CJK character. A null is empty."""

    def cut(t: Column) -> Column:
        pair = F.create_map(*[F.lit(x) for kv in BRACKETS.items() for x in kv])
        closing = F.coalesce(F.position(F.element_at(pair, F.substring(t, 1, 1)), t), F.lit(0))
        space, comma = F.position(F.lit(" "), t), F.position(F.lit("、"), t)
        from_cjk = F.regexp_extract(t, f"^[^一-鿿]+({CJK}(?s:.*))$", 1)
        after = lambda at: F.substr(t, at + 1)
        return (
            F.when(space > 0, after(space))
            .when((closing > 0) & (closing < F.length(t)), after(closing))
            .when((comma > 0) & (comma < F.length(t)), after(comma))
            .when(from_cjk != "", from_cjk)
            .otherwise(t)
        )

    return let(strip(F.coalesce(text, F.lit(""))), cut)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remove_annotations(text: Column) -> Column:
    for pattern in ANNOTATIONS:
        text = F.regexp_replace(text, pattern, "")
    return collapse(text)


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits with two characters or more, and the bigrams of CJK runs."""
    bigrams = lambda r: F.when(
        r.rlike(f"^{CJK}") & (F.length(r) > 2), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substr(r, i, F.lit(2)))
    ).otherwise(F.array(r))
    mixed = F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({CJK}{{2,}}|[a-z0-9]{{2,}})"), F.lit(1)), bigrams))
    # most texts have no CJK run, and their words need no second look
    return F.when(text.rlike(CJK), mixed).otherwise(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1)))


def clean_items(items: Column) -> Column:
    """An item string as a list: braces, quotes and brackets dropped, split at commas, trimmed; neither #, nor numbers, nor single characters."""
    parts = F.transform(F.split(F.regexp_replace(items, r'[{}"\[\]]', ""), ","), lambda x: F.trim(F.replace(x, F.lit("#"), F.lit(""))))
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]+$"))


def truncate(text: Column, n: int = 3000) -> Column:
    return F.substring(text, 1, n)


def split_enumeration(text: Column) -> Column:
    """Split at 、 outside brackets, by a fold over the characters; parts are stripped, empty ones dropped."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c.isin("(", "（"), s["depth"] + 1).when(c.isin(")", "）"), F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        cut = (c == "、") & (s["depth"] == 0)
        return F.struct(depth.alias("depth"), F.when(cut, F.lit("")).otherwise(F.concat(s["now"], c)).alias("now"), F.when(cut, F.array_append(s["parts"], s["now"])).otherwise(s["parts"]).alias("parts"))

    whole = F.aggregate(F.split(text, ""), start, step, lambda s: F.array_append(s["parts"], s["now"]))
    return F.filter(F.transform(whole, strip), lambda x: x != "")


def close_brackets(text: Column) -> Column:
    """A part without a trailing 等, and without what follows an opening bracket that nothing closes."""
    text = F.regexp_replace(text, "等$", "")
    for opening, closing in (("（", "）"), ("(", ")")):
        text = F.when(F.contains(text, F.lit(opening)) & ~F.contains(text, F.lit(closing)), F.concat(text, F.lit(closing))).otherwise(text)
    return text
