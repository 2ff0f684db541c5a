"""Knowledge-base tables: records of chunks, de-duplicated, numbered and counted by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from ..session import stored
from .taxonomy import deepest

#: The first id of each kind.
OFFSETS = {"classification": 0, "narrative_classification": 100_000_000, "general_knowledge": 200_000_000}


def expand_records(tax: DataFrame) -> DataFrame:
    """(row_no, kind, text): texts under which a taxonomy row is found: the line as JSON, each value but the grade, lists
    flattened, and all values joined by 、 if there are several."""
    values = F.filter(F.concat(F.col("path"), F.array("feature", "condition"), F.col("elements")), lambda x: F.coalesce(strip(x), F.lit("")) != "")
    line = F.to_json(F.struct("path", "feature", "grade", "condition", "elements"))
    some = tax.select("row_no", line.alias("line"), values.alias("v"))
    entry = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    all_of = F.concat(F.array(entry("line", F.col("line"))), F.transform("v", lambda x: entry("value", x)), F.when(F.size("v") > 1, F.array(entry("joined", F.array_join("v", "、")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>")))
    return some.select("row_no", F.explode(all_of).alias("e")).select("row_no", "e.kind", "e.text")


def expand_lines(chunks: DataFrame, line: str = "line") -> DataFrame:
    """chunks with vectorizing_text rows: the line itself, and of a JSON line in header and data form its values as above."""
    form = "header map<string,string>, data map<string,string>"
    parsed = F.from_json(line, form)
    grades = F.map_keys(F.map_filter(F.col("_p.header"), lambda k, v: v == "等级"))
    lists = lambda v: F.coalesce(F.from_json(F.when(v.startswith("["), v), "array<string>"), F.array(v))
    entries = F.array_sort(F.transform(F.map_entries(F.col("_p.data")), lambda e: F.struct(e["key"].cast("int").alias("k"), e["key"].alias("key"), e["value"].alias("value"))))
    flat = F.filter(F.flatten(F.transform(F.filter(entries, lambda e: ~F.array_contains(grades, e["key"])), lambda e: lists(e["value"]))), lambda x: F.coalesce(strip(x), F.lit("")) != "")
    values = F.when(F.col("_p.data").isNotNull() & F.col("_p.header").isNotNull(), flat).otherwise(F.array().cast("array<string>"))
    staged = chunks.withColumn("_p", parsed).withColumn("_v", values)
    joined = F.when(F.size("_v") > 1, F.array(F.array_join("_v", "、"))).otherwise(F.array().cast("array<string>"))
    return staged.withColumn("vectorizing_text", F.explode(F.concat(F.array(line), F.col("_v"), joined))).drop("_p", "_v")


def items_of(line: Column, category_text: Column) -> Column:
    """Tokens of a record: those of its line and of its category's text."""
    return tokens(F.concat_ws(" ", line, category_text))


def general_records(chunks: DataFrame) -> DataFrame:
    """Records of general-knowledge lines: text, vectorizing_text and items from the line alone."""
    return chunks.select("spec_uid", F.lit("general_knowledge").alias("kind"), F.col("line").alias("text"), F.col("line").alias("vectorizing_text"), tokens(F.col("line")).alias("items"))


def routed(records: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with kind by their document's class (doc_id, doc_class; missing ones are data), and counts of other classes,
    which are left out."""
    own = records.join(classes.select("doc_id", "doc_class"), "doc_id", "left").withColumn("doc_class", F.coalesce("doc_class", F.lit("2")))
    kind = F.when(F.col("doc_class") == "1", "narrative_classification").when(F.col("doc_class") == "2", "classification")
    named = own.withColumn("kind", kind)
    return named.where("kind IS NOT NULL").drop("doc_class"), named.where("kind IS NULL").groupBy("doc_class").agg(F.count("*").alias("n"))


def ranked(rows: DataFrame, digest: Column, *order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with _rank, counted from 1 within keys in the order of a hex digest.

    Numbering is by hash range: rows are counted per leading hex digits first, so no window holds all rows.
    """
    staged = rows.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 3))
    sizes = staged.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_d", *order))
    return staged.join(before, [*keys, "_b"]).withColumn("_rank", (F.col("_before") + place).cast("long")).drop("_b", "_before", "_d")


def numbered(records: DataFrame) -> DataFrame:
    """Records once per content (text and items) in their spec and kind, with an id that counts from the kind's offset in
    the order of content hashes.

    Numbering is by hash range: records are counted per leading hex digits first, so no window holds a whole kind.
    """
    content = F.md5(F.concat_ws("\x1e", "vectorizing_text", "text", F.array_join("items", "\x1f")).cast("binary"))
    once = stored(records.withColumn("content_md5", content).dropDuplicates(["spec_uid", "kind", "content_md5"]))
    offset = F.create_map(*[F.lit(x) for kv in OFFSETS.items() for x in kv])
    placed = ranked(once, F.col("content_md5"), keys=("spec_uid", "kind"))
    return placed.withColumn("id", (offset[F.col("kind")] + F.col("_rank")).cast("long")).drop("_rank")


def consistency(records: DataFrame, tax: DataFrame) -> DataFrame:
    """One row (n, inconsistent): records whose category name is not in their text, nor the text in the name."""
    own = records.join(tax.select("row_no", deepest(F.col("path")).alias("_c")), "row_no")
    fits = F.contains("text", F.col("_c")) | F.contains("_c", F.col("text"))
    return own.agg(F.count("*").alias("n"), F.coalesce(F.sum((~fits).cast("int")), F.lit(0)).alias("inconsistent"))


def build_statistics(records: DataFrame) -> DataFrame:
    """(kind, n) with a row for the total, whose kind is null."""
    return records.rollup("kind").agg(F.count("*").alias("n"))


def standard_elements(tax: DataFrame) -> DataFrame:
    """(id, items, text, source_line): one record per element: classification|subcategory|element."""
    own = tax.select("row_no", F.get("path", F.lit(0)).alias("c"), F.get("path", F.lit(1)).alias("s"), F.posexplode("elements").alias("k", "e")).where("e <> ''")
    parts = F.array(F.coalesce("c", F.lit("")), F.coalesce("s", F.lit("")), F.col("e"))
    # rows are counted by ranges of 4096 row numbers first, so no window holds them all
    counted = own.groupBy("row_no").agg(F.count("*").alias("_n")).withColumn("_r", F.floor(F.col("row_no") / 4096))
    ranges = counted.groupBy("_r").agg(F.sum("_n").alias("_m")).withColumn("_base", F.coalesce(F.sum("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counted.withColumn("_within", within).join(ranges, "_r").select("row_no", (F.col("_base") + F.col("_within")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("row_no").orderBy("k"))
    return own.join(before, "row_no").select((F.col("_before") + rank).alias("id"), F.array_join(parts, "|").alias("items"), F.col("e").alias("text"), F.col("c").alias("classification"), F.col("s").alias("subcategory"), F.col("row_no").alias("source_line"))
