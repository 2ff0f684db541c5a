"""Documents in files: text, Markdown, CSV and JSON, with their encodings."""

from __future__ import annotations

import csv
import io
import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.grids import fenced
from ..operators.lines import titled

TEXT, TABLES = ("txt", "md"), ("csv", "json")


#: Encodings in the order in which they are tried; the last one can read any bytes.
ENCODINGS = ("utf-8", "gbk", "latin-1")


def _text(content: bytes) -> str:
    for encoding in ENCODINGS[:-1]:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode(ENCODINGS[-1])


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _text(x) for x in content], dtype=object)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else GBK where they are valid, else Latin-1. Only bytes that are no UTF-8 go
    through the Arrow function."""
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(_decoded(F.when(~F.is_valid_utf8(utf8), content)))


def scan(spark: SparkSession, folder: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, stem, suffix, text) of supported files below a folder, and rejects (doc_id, name, error)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    named = files.select(F.col("path").alias("doc_id"), name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), suffix.alias("suffix"), "content")
    ok = F.col("suffix").isin(*TEXT, *TABLES)
    return named.where(ok).select("doc_id", "name", "stem", "suffix", decoded(F.col("content")).alias("text")), named.where(~ok).select("doc_id", "name", F.concat(F.lit("unsupported suffix: "), "suffix").alias("error"))


def markdown(docs: DataFrame) -> DataFrame:
    """Documents as Markdown: text under a title, Markdown as it is, tables fenced as JSON lines."""
    text = F.when(F.col("suffix") == "txt", titled(F.col("stem"), F.col("text"))).when(F.col("suffix") == "md", F.col("text")).otherwise(fenced(F.col("stem"), F.col("text")))
    return docs.withColumn("text", text)


def _records(text: str) -> Iterator[str]:
    """JSON of the rows below a header; repeated names get their column's number, empty ones are _c and the number."""
    rows = (r for r in csv.reader(io.StringIO(text, newline="")) if r)
    header = next(rows, [])
    times = Counter(x.lower() for x in header)
    names = [f"_c{i}" if not x else f"{x}{i}" if times[x.lower()] > 1 else x for i, x in enumerate(header)]
    for row in rows:
        yield json.dumps(dict(zip(names, row[: len(names)] + [""] * (len(names) - len(row)), strict=True)), ensure_ascii=False, separators=(",", ":"))


def csv_records(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(record) JSON of each row of CSV files with a header; missing cells are empty.

    Without an encoding each file's is found as in ``decoded``, so a file is read as a whole by a task; files of more than 2 GB
    need one. With an encoding Spark's reader may split files.
    """
    if encoding is not None:
        rows = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
        return rows.na.fill("").select(F.to_json(F.struct("*")).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = _records(_text(content.as_py()).removeprefix("\ufeff"))
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["record"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, "record string")


def outcome(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """(status, n) of a scan."""
    rows = good.select(F.lit("ok").alias("status")).union(rejects.select(F.lit("failed").alias("status")))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def size_report(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(kind, kb) of files below the folder of each kind; their contents are not read."""
    out = None
    for kind, folder in folders.items():
        own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).agg(F.lit(kind).alias("kind"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1024, 2).alias("kb"))
        out = own if out is None else out.union(own)
    return out
