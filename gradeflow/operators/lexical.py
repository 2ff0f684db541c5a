"""BM25 over stored postings.

Postings are built once: one row per document and token. Corpus figures (documents, mean length) are one row. A search takes
the postings of the asked tokens first, by a broadcast of those tokens where they are few enough (the number is checked), so
the rest of the corpus goes no further than its scan. Scores of frequent tokens are many rows of one key; that join is left
to Spark's skew handling, and the sums per query and document are combined before they are shuffled.

``by`` names a column of collections: figures, rarity and ranks are then those within each collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Fixed values of the published BM25-Okapi: saturation, length normalisation, share of the mean idf for negative ones.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Asked tokens that a search broadcasts at most.
FEW_TOKENS = 200_000


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", items: str | None = None, by: str | None = None) -> DataFrame:
    """(doc_id, token, tf, dl) of each document and token; items, if given, is a column of ready token lists."""
    words, own = F.col(items) if items else tokens(F.col(text)), [by] if by else []
    listed = docs.select(*own, F.col(doc_id).alias("doc_id"), words.alias("words")).withColumn("dl", F.size("words"))
    return listed.select(*own, "doc_id", "dl", F.explode("words").alias("token")).groupBy(*own, "doc_id", "dl", "token").agg(F.count("*").alias("tf"))


def corpus_figures(docs: DataFrame, posted: DataFrame, by: str | None = None) -> DataFrame:
    """(n_docs, avgdl), in one row or one of each collection, of the documents behind postings; those without tokens count as
    documents of length 0."""
    mean = F.when(F.col("n_docs") > 0, F.coalesce("total", F.lit(0)) / F.greatest("n_docs", F.lit(1))).alias("avgdl")
    if by:
        total = posted.groupBy(by).agg(F.sum("tf").alias("total"))
        return docs.groupBy(by).agg(F.count("*").alias("n_docs")).join(total, by, "left").select(by, "n_docs", mean)
    total = posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(total).select("n_docs", mean)


def _with(rows: DataFrame, figures: DataFrame, by: str | None) -> DataFrame:
    """rows beside their collection's figures, which are one row without collections."""
    return rows.join(figures, by) if by else rows.crossJoin(F.broadcast(figures))


def idf(posted: DataFrame, lengths: DataFrame, by: str | None = None) -> DataFrame:
    """(token, idf): log((n - df + 0.5) / (df + 0.5)); negative ones become EPSILON times the mean over all tokens."""
    own = [by] if by else []
    df = posted.groupBy(*own, "token").agg(F.count("*").alias("df"))
    raw = _with(df, lengths.select(*own, "n_docs"), by).select(*own, "token", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy(*own).agg(F.avg("raw").alias("mean"))
    return _with(raw, mean, by).select(*own, "token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(posted: DataFrame, lengths: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "text", within: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every pair that shares a token; a token that a query repeats counts each time.

    ``within``, if given, holds the pairs (query_id, doc_id) that are scored. With ``by`` queries have that column too.
    """
    own = [by] if by else []
    asked = queries.select(*own, F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("token")).groupBy(*own, "query_id", "token").agg(F.count("*").alias("qtf"))
    wanted = asked.select(*own, "token").distinct()
    few = wanted.limit(FEW_TOKENS + 1).count() <= FEW_TOKENS
    wanted = F.broadcast(wanted) if few else wanted
    found = posted.join(wanted, [*own, "token"], "left_semi")
    weighed = asked.join(idf(posted, lengths, by).join(wanted, [*own, "token"], "left_semi"), [*own, "token"]).select(*own, "query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    normed = _with(found, lengths.select(*own, "avgdl"), by).select(*own, "doc_id", "token", (F.col("tf") * (K1 + 1) / norm).alias("share"))
    scored = normed.join(weighed, [*own, "token"]).select(*own, "query_id", "doc_id", (F.col("weight") * F.col("share")).alias("part"))
    if within is not None:
        scored = scored.join(within, ["query_id", "doc_id"], "left_semi")
    return scored.groupBy(*own, "query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25_topk(posted: DataFrame, lengths: DataFrame, queries: DataFrame, k: int = 15, query_id: str = "query_id", text: str = "text", by: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rk) of the k best documents of each query with a positive score; equal ones by id."""
    best = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), "doc_id")
    scored = bm25_scores(posted, lengths, queries, query_id, text, by=by).where("score > 0")
    return scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)


def min_max(scored: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Adds norm_score: the score on 0 to 1 within each query; 1 if all are equal."""
    own = Window.partitionBy(by)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return scored.withColumn("norm_score", F.when(high == low, 1.0).otherwise(F.round((F.col(score) - low) / (high - low), 6)))
