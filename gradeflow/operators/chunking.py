"""Chunks of documents: narrative ones by headings and windows, data ones by records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import collapse, strip

_HEADING = r"^(#{1,6})(?U:\s)+(.*)$"


def _depths(level: Column, rows: Column, order: WindowSpec, stack_rule: str) -> Column:
    """The depth of a heading in the stack of titles: its level, or with "count" at most one more than the depth before it."""
    # the recurrence min(depth + 1, level) is a running minimum once the number of headings so far is taken off
    return level if stack_rule == "level" else F.least(rows, rows + F.min(level - rows).over(order))


def narrative_chunks(lines: DataFrame, size: int = 500, stack_rule: str = "count") -> DataFrame:
    """(doc_id, section, chunk_no, chunk): a section's text, white space collapsed, in windows of ``size`` characters, each
    with the path of titles before it.

    The main title is the first # heading if no text comes before it, else the first line with text, which also stays in the
    text. Fenced lines and their fences go. ``stack_rule`` "count" pops the title stack by its height, so a second heading of
    a level nests under the first; "level" pops by level.
    """
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(r"(?U)^\s*```")
    clear = lines.withColumn("_fence", fence).withColumn("_open", F.sum(F.col("_fence").cast("int")).over(order) % 2).where("NOT _fence AND _open = 0")
    flagged = clear.withColumn("_h", F.col("line").rlike(_HEADING)).withColumn("section", F.sum(F.col("_h").cast("int")).over(order)).withColumn("_below", F.bool_or(F.col("_h") & ~F.col("line").startswith("##")).over(order))
    head = F.struct("pos", F.length(F.regexp_extract("line", _HEADING, 1)).alias("level"), strip(F.regexp_extract("line", _HEADING, 2)).alias("title"))
    body = F.struct("pos", "line")
    # a line leads only above the first level-1 heading; all that follows keeps a document's rows together, so they are shuffled once
    sections = flagged.groupBy("doc_id", "section").agg(
        F.min(F.when(F.col("_h"), head)).alias("h"),
        F.min(F.when(~F.col("_h") & ~F.col("_below") & F.col("line").rlike(r"(?U)\S"), body)).alias("f"),
        collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), body))), lambda x: x["line"]), "\n")).alias("t"),
    )
    first, top = F.min("f").over(whole), F.min(F.when(F.col("h.level") == 1, F.col("h"))).over(whole)
    known = sections.withColumn("_first", first).withColumn("_top", top)
    lead = F.when(F.col("_first").isNotNull(), F.struct(F.col("_first.pos").alias("pos"), strip(F.col("_first.line")).alias("title")))
    # the main title, and the headings that are stacked: all but that
    main = known.withColumn("_lead", lead).withColumn("_main", F.coalesce("_lead", F.struct("_top.pos", "_top.title")))
    stacked = main.withColumn("_s", F.when(F.col("_lead").isNotNull() | F.col("_top").isNull() | (F.col("h.pos") != F.col("_top.pos")), F.col("h")))
    order = whole.orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = stacked.withColumn("_n", F.count("_s").over(order)).withColumn("_d", F.when(F.col("_s").isNotNull(), _depths(F.col("_s.level"), F.col("_n").cast("int"), order, stack_rule)))
    # the last heading of each depth, unless one above it came since
    latest = {k: F.last(F.when(F.col("_d") <= k, F.struct(F.col("_d").alias("d"), F.col("_s.title").alias("title"))), ignorenulls=True).over(order) for k in range(1, 7)}
    placed = counted.withColumns({f"_h{k}": x for k, x in latest.items()})
    titles = F.array(F.when(F.col("_main.pos") <= F.col("h.pos"), F.col("_main.title")), *[F.when(F.col(f"_h{k}.d") == k, F.col(f"_h{k}.title")) for k in latest])
    # text before any heading stands under the leading line alone
    path = F.when(F.col("section") > 0, F.array_join(F.filter(titles, lambda x: x != ""), ":")).otherwise(F.col("_lead.title"))
    prefix = F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).otherwise(F.concat(path, F.lit(":")))
    return placed.where("t <> ''").select("doc_id", "section", windows(F.col("t"), size).alias("w"), prefix.alias("_p")).select("doc_id", "section", F.posexplode("w").alias("chunk_no", "_w"), "_p").select("doc_id", "section", "chunk_no", F.concat("_p", "_w").alias("chunk"))


def windows(text: Column, size: int) -> Column:
    """A text cut every ``size`` characters."""
    # one pass over the text: a substring is sought from the beginning each time
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(text))


def data_chunks(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk): each record line (a JSON object) behind the titles in force, joined by commas; an array line
    gives a chunk for each of its items."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = strip(F.col("line"))
    leveled = lines.select("doc_id", "pos", line.alias("line")).withColumn("level", F.length(F.regexp_extract("line", _HEADING, 1)))
    out = leveled
    for k in range(1, 7):
        # a title is in force until one of its level or a higher one comes
        latest = F.last(F.when((F.col("level") > 0) & (F.col("level") <= k), F.struct("level", strip(F.regexp_extract("line", _HEADING, 2)).alias("title"))), ignorenulls=True).over(order)
        out = out.withColumn(f"_h{k}", latest)
    titles = F.filter(F.array(*[F.when(F.col(f"_h{k}.level") == k, F.col(f"_h{k}.title")) for k in range(1, 7)]), lambda x: F.coalesce(x, F.lit("")) != "")
    items = F.when(F.col("line").startswith("["), F.from_json("line", "array<string>")).when(F.col("line").startswith("{"), F.array("line"))
    return out.where("level = 0").select("doc_id", "pos", titles.alias("_t"), F.explode(items).alias("_r")).select("doc_id", "pos", F.concat_ws(",", "_t", "_r").alias("chunk"))


def routed_chunks(lines: DataFrame, classes: DataFrame, size: int = 500) -> DataFrame:
    """(doc_id, kind, chunk): lines of documents by their class (doc_id, doc_class, has_category): without a category
    narrative chunks as general_knowledge, class 1 narrative, all others data."""
    kind = F.when(~F.col("has_category"), "general_knowledge").when(F.col("doc_class") == "1", "narrative").otherwise("data")
    routed = lines.join(classes.select("doc_id", kind.alias("kind")), "doc_id")
    kinds = routed.select("doc_id", "kind").distinct()
    told = narrative_chunks(routed.where("kind <> 'data'").select("doc_id", "pos", "line"), size).select("doc_id", "chunk").join(kinds, "doc_id")
    return told.unionByName(data_chunks(routed.where("kind = 'data'").select("doc_id", "pos", "line")).select("doc_id", "chunk").withColumn("kind", F.lit("data")))
