"""Jobs on the knowledge base of a specification: build, rebuild, change of classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kb
from ..operators.changes import delete_documents
from ..operators.taxonomy import category_text, match_paths, path_key, prune_non_leaf
from ..operators.vectors import no_vector, vectors_of
from ..sources import tables


def build_records(chunks: DataFrame, tax: DataFrame, classes: DataFrame, vector: Column | None = None) -> DataFrame:
    """Collection records of chunk lines (spec_uid, category_path, doc_name, chunk_no, line): each line goes to the taxonomy
    row that its last directory resembles, and stands there under its own text and values; lines below a directory that
    resembles none are left out, lines of general_knowledge stand for themselves."""
    # equal lines of a document give equal records, which count once
    chunks = chunks.select("spec_uid", "category_path", "doc_name", "line").distinct()
    general = F.get("category_path", F.lit(0)) == "general_knowledge"
    own = chunks.where(~F.coalesce(general, F.lit(False))).withColumn("key", path_key(F.col("category_path")))
    matched = match_paths(own, tax).select("key", "row_no")
    # texts only of rows that a path has; a taxonomy's files are far smaller than its rows, so Spark would broadcast it by their size
    texts = category_text(tax.hint("merge").join(matched.select("row_no").distinct(), "row_no", "left_semi"))
    named = matched.join(texts.withColumnRenamed("text", "category_text").hint("merge"), "row_no")
    lines = kb.expand_lines(own.join(named, "key"))
    records = lines.select("spec_uid", F.col("doc_name").alias("doc_id"), F.col("category_text").alias("text"), "vectorizing_text", kb.items_of(F.col("line"), F.col("category_text")).alias("items"))
    typed, _ = kb.routed(records, classes)
    every = typed.drop("doc_id").unionByName(kb.general_records(chunks.where(F.coalesce(general, F.lit(False)))))
    numbered = kb.numbered(every)
    if vector is not None:
        return numbered.withColumn("vector", vector.cast("array<float>"))
    return vectors_of(numbered, "vectorizing_text").withColumn("vector", F.coalesce("vector", no_vector()))


def rebuild(spark: SparkSession, chunk_path: str, collection_path: str, tax: DataFrame, classes: DataFrame, spec_uids: list[str]) -> DataFrame:
    """Rebuilds all collections of the specifications from their chunks; returns counts by kind and the total."""
    chunks = tables.read_chunks(spark, chunk_path).where(F.col("spec_uid").isin(spec_uids))
    tables.rebuild_collections(build_records(chunks, tax, classes), collection_path, spec_uids)
    return kb.build_statistics(tables.current_collections(spark, collection_path).where(F.col("spec_uid").isin(spec_uids)))


def change_classification(spark: SparkSession, chunk_path: str, new_chunk_path: str, collection_path: str, tax: DataFrame, classes: DataFrame, deleted: DataFrame, spec_uids: list[str]) -> DataFrame:
    """Deletes documents, rebuilds from what is left with a taxonomy of leaves alone; returns documents that were not found.

    The chunks that stay are written to a new place, so the job can run again.
    """
    chunks = spark.read.parquet(chunk_path).withColumn("path", F.col("category_path"))
    left, missing = delete_documents(chunks, deleted)
    tables.write_chunks(left.drop("path", "category", "doc"), new_chunk_path)
    rebuild(spark, new_chunk_path, collection_path, prune_non_leaf(tax), classes, spec_uids)
    return missing
