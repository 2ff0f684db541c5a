"""Recognition end to end: whole batches of tables and files as one plan each.

Records are rows of the collections (spec_uid, kind, row_no, text, vector); row_no leads to the taxonomy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_annotations
from ..operators import lexical, recognition, vectors
from ..operators.lines import outline_or_head
from ..operators.scoring import Scorer
from ..session import stored

#: Candidates of a file from each collection, and those that are kept.
FILE_DEPTH, FILE_KEPT = 8, 10
TABLE_TASK = "Choose the category that describes this table best."
FILE_TASK = "Choose the category that describes this file best."


def _collection() -> Column:
    return F.concat_ws(":", "spec_uid", "kind").alias("collection")


def _asked(requests: DataFrame, places: DataFrame) -> DataFrame:
    return places.select("request_id", _collection()).join(requests, "request_id")


def _by_vector(records: DataFrame, asked: DataFrame, depth: int) -> DataFrame:
    found = vectors.ip_topk(records, asked, depth, vec_id="row_no", vector="vector", query_id="request_id", query_vector="vector", by="collection")
    return found.select(F.col("q_id").alias("request_id"), F.lit("vector").alias("source"), F.col("vec_id").alias("row_no"), F.col("ip").alias("score"), "collection")


def _with_texts(found: DataFrame, records: DataFrame) -> DataFrame:
    return found.join(records.select("collection", "row_no", "text"), ["collection", "row_no"]).withColumn("id", F.col("row_no"))


def table_candidates(requests: DataFrame, records: DataFrame, depth: int = recognition.DEPTH, keep: int = recognition.KEPT) -> DataFrame:
    """(request_id, source, row_no, id, text, score, rk, number): candidates of each request.

    Each of its collections is searched by BM25 with the table's comment or name, and by vector with the short sentence; the
    best of each source over all collections are kept, once for each text, and numbered.
    """
    name = F.coalesce(F.nullif(remove_annotations(F.coalesce("tableComment", F.lit(""))), F.lit("")), F.col("tableName"))
    said = requests.select("request_id", "spec_uids", name.alias("name"), recognition.table_sentence(requests, long=False).alias("sentence"))
    known = stored(records.select(_collection(), "spec_uid", "kind", "row_no", "text", F.col("vector").cast("array<float>").alias("vector")))
    asked = stored(vectors.vectors_of(_asked(said, recognition.table_collections(requests, known)), "sentence"))
    posted = stored(lexical.postings(known, "row_no", by="collection"))
    by_word = lexical.bm25_topk(posted, lexical.corpus_figures(known, posted, "collection"), asked, depth, "request_id", "name", by="collection")
    lexicals = by_word.select(F.col("query_id").alias("request_id"), F.lit("bm25").alias("source"), F.col("doc_id").alias("row_no"), "score", "collection")
    found = _with_texts(lexicals.unionByName(_by_vector(known, asked, depth)), known)
    return recognition.number_candidates(recognition.merge_candidates(found, keep)).drop("collection")


def recognise_tables(requests: DataFrame, records: DataFrame, tax: DataFrame, least: float = 0.3, scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(request_id, row_no, category, grade, elements, reason) of each request that a category fits, and (request_id,
    field_no, element, score) of its fields. Requests are (request_id, spec_uids, tableName, tableComment, fields)."""
    candidates = stored(table_candidates(requests, records))
    prompted = None if scorer is None else recognition.prompts(candidates, requests, recognition.table_sentence(requests, long=False), TABLE_TASK)
    resolved = stored(recognition.resolve(recognition.choose(candidates, prompted, scorer), tax))
    return resolved, recognition.map_fields(requests, resolved, least)


def recognise_files(files: DataFrame, records: DataFrame, tax: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(request_id, row_no, category, grade, elements, reason) of each file that a category fits.

    Files are (request_id, spec_uids, name, text), with systemName if known. What is asked is the name and the outline, or the head of the text; the
    nearest records of each collection are candidates, the best of them kept once for each text.
    """
    shown = outline_or_head(files.select(F.col("request_id").alias("doc_id"), "text"))
    system = F.col("systemName") if "systemName" in files.columns else F.lit(None).cast("string")
    named = files.select("request_id", "spec_uids", "name", system.alias("system")).join(shown.withColumnRenamed("doc_id", "request_id"), "request_id")
    said = named.withColumn("sentence", recognition.file_sentence(F.col("name"), F.col("system"), F.col("text")))
    known = stored(records.select(_collection(), "spec_uid", "kind", "row_no", "text", F.col("vector").cast("array<float>").alias("vector")))
    asked = stored(vectors.vectors_of(_asked(said.drop("text"), recognition.file_collections(files, known)), "sentence"))
    found = _with_texts(_by_vector(known, asked, FILE_DEPTH), known)
    candidates = stored(recognition.number_candidates(recognition.merge_candidates(found, FILE_KEPT)))
    prompted = None if scorer is None else recognition.prompts(candidates, said, F.col("sentence"), FILE_TASK)
    return recognition.resolve(recognition.choose(candidates, prompted, scorer), tax, highest=False)
