"""Documents as line tables (doc_id, pos, line), and back; tables of contents, outlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import strip


#: Rows of documents that are made Python objects at once.
ROWS = 8192


def _order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def to_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text) of the lines in order."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def by_document(rows: DataFrame, fields: tuple[str, ...], told: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """(doc_id, ...) of what ``told`` makes of each document's rows, which it gets in the order of the first field.

    For rules that look at all rows before: a document's rows are one list, and documents go through in Arrow batches.
    """
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitting = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                # rows of some documents at a time, as they are far larger in Python
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + ROWS, side="right")))
                listed = batch.column(1).slice(lo, hi - lo).flatten()
                each = [dict(zip(fields, x)) for x in zip(*(c.to_pylist() for c in listed.flatten()))]
                out = [(i, *x) for i in range(lo, hi) for x in told(each[(int(ends[i - 1]) if i else 0) - before : int(ends[i]) - before])]
                columns = list(zip(*out)) if out else [()] * (len(names) + 1)
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, fitting[x.split(" ")[1]]) for c, x in zip(columns[1:], schema.split(", "))]], names=["doc_id", *names])
                lo = hi

    return listed.mapInArrow(run, f"doc_id {kind}, {schema}")


def renumbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("pos", F.row_number().over(_order()) - 1)


def drop_blank(lines: DataFrame) -> DataFrame:
    return renumbered(lines.where(strip(F.col("line")) != ""))


def is_toc_like(line: Column) -> Column:
    """Ends, white space apart, with two dots or more and a number."""
    return F.regexp_replace(line, r"(?U)\s+", "").rlike(r"[.．…]{2,}[0-9]+$")


def mark_toc(lines: DataFrame) -> DataFrame:
    """lines with is_toc: like an entry of a table of contents, next to another such line."""
    flagged = lines.withColumn("_toc", is_toc_like(F.col("line")))
    near = F.coalesce(F.lag("_toc").over(_order()), F.lit(False)) | F.coalesce(F.lead("_toc").over(_order()), F.lit(False))
    return flagged.withColumn("is_toc", F.col("_toc") & near).drop("_toc")


def remove_toc(lines: DataFrame) -> DataFrame:
    """Without blank lines, then without the table of contents; positions count anew."""
    return renumbered(mark_toc(drop_blank(lines)).where("NOT is_toc").drop("is_toc"))


def titled(stem: Column, text: Column) -> Column:
    return F.concat(F.lit("# "), stem, F.lit("\n\n"), text)


def outline(lines: DataFrame, budget: int = 900) -> DataFrame:
    """(doc_id, text): each line that begins with # and the next line that is neither blank nor a heading, in order, up to a
    budget of characters; the item that crosses it is cut. Joining line ends are not counted."""
    flagged = lines.withColumn("_s", strip(F.col("line"))).withColumn("_h", F.col("_s").startswith("#"))
    ahead = _order().rowsBetween(1, Window.unboundedFollowing)
    follow = F.first(F.when(~F.col("_h") & (F.col("_s") != ""), F.col("_s")), ignorenulls=True).over(ahead)
    heads = flagged.withColumn("_f", follow).where("_h")
    items = heads.select("doc_id", "pos", F.posexplode(F.array("line", "_f")).alias("k", "item")).where("item IS NOT NULL")
    before = F.coalesce(F.sum(F.length("item")).over(Window.partitionBy("doc_id").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = items.withColumn("_b", before).where(F.col("_b") < budget).withColumn("item", F.substr("item", F.lit(1), (F.lit(budget) - F.col("_b")).cast("int")))
    joined = cut.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "item"))), lambda x: x["item"]), "\n").alias("text"))
    return joined


def outline_or_head(docs: DataFrame, budget: int = 900, least: int = 10, head: int = 900) -> DataFrame:
    """(doc_id, text): the outline, or the head of the text where the outline has fewer than ``least`` characters."""
    found = outline(to_lines(docs), budget).withColumnRenamed("text", "_o")
    both = docs.join(found, "doc_id", "left")
    return both.select("doc_id", F.when(F.length("_o") >= least, F.col("_o")).otherwise(F.substring("text", 1, head)).alias("text"))


def preferred_versions(files: DataFrame) -> DataFrame:
    """(base, path, name) of the file to use for each base name, from the folder with the latest 14-digit time stamp:
    _final.md before _with_html.md before .md. files is (path, name), path being the folder."""
    stamped = files.withColumn("_stamp", F.regexp_extract("path", r"(\d{14})(?!\d)", 1))
    latest = stamped.join(stamped.agg(F.max("_stamp").alias("_last")), F.col("_stamp") == F.col("_last"), "left_semi")
    ranked = latest.where(F.col("name").endswith(".md")).withColumn("base", F.regexp_replace("name", r"(_final|_with_html)?\.md$", ""))
    priority = F.when(F.col("name").endswith("_final.md"), 1).when(F.col("name").endswith("_with_html.md"), 2).otherwise(3)
    first = Window.partitionBy("base").orderBy(priority, "path")
    return ranked.withColumn("_rk", F.row_number().over(first)).where("_rk = 1").select("base", "path", "name")
