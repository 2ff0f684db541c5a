"""Batch matching of names: embedding similarity, BM25, and their weighted sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lexical import EPSILON, FEW_TOKENS, K1, B
from .vectors import cosine, ip_topk, no_vector, vectors_of


def bm25_among_lists(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request_id, candidate_no, bm25): BM25 of each request (request_id, list_id, query) against the candidates (list_id,
    candidate_no, candidate) of its list, scaled to 0 to 1 within the request; all equal is 1, and a query or candidate list
    without tokens gives 0.

    What BM25 needs of the candidates is made once for each list, however many requests share it. If that is few rows (their
    number is checked) requests go past it where they lie, and only pairs and their scores are shuffled.
    """
    sized = candidates.select("list_id", "candidate_no", tokens(F.col("candidate")).alias("w")).withColumn("dl", F.size("w"))
    stats = sized.groupBy("list_id").agg(F.count("*").alias("n"), F.avg("dl").alias("a"))
    posted = sized.select("list_id", "candidate_no", "dl", F.explode("w").alias("token")).groupBy("list_id", "candidate_no", "dl", "token").agg(F.count("*").alias("tf"))
    df = posted.groupBy("list_id", "token").agg(F.count("*").alias("df")).join(stats, "list_id")
    raw = df.select("list_id", "token", "a", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = F.avg("raw").over(Window.partitionBy("list_id"))
    idf = raw.select("list_id", "token", "a", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))
    share = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("a")))
    weights = posted.join(idf, ["list_id", "token"]).select("list_id", "token", "candidate_no", share.alias("part"))
    listed = sized.select("list_id", "candidate_no").join(stats.select("list_id", "a"), "list_id")
    if max(x.limit(FEW_TOKENS + 1).count() for x in (weights, listed)) <= FEW_TOKENS:
        weights, listed = F.broadcast(weights), F.broadcast(listed)
    asked = requests.select("request_id", "list_id", tokens(F.col("query")).alias("q"))
    # every pair is there with 0, and adds to it for each occurrence of a token that both have
    none = asked.select("request_id", "list_id", F.size("q").alias("_n")).join(listed, "list_id").select("request_id", "candidate_no", F.lit(0.0).alias("part"), ((F.col("_n") > 0) & (F.col("a") > 0)).alias("ok"))
    some = asked.select("request_id", "list_id", F.explode("q").alias("token")).join(weights, ["list_id", "token"]).select("request_id", "candidate_no", "part", F.lit(None).cast("boolean").alias("ok"))
    every = none.union(some).groupBy("request_id", "candidate_no").agg(F.round(F.sum("part"), 6).alias("s"), F.max("ok").alias("ok"))
    w = Window.partitionBy("request_id")
    low, high = F.min("s").over(w), F.max("s").over(w)
    scaled = F.when(~F.col("ok"), 0.0).when(high == low, 1.0).otherwise(F.round((F.col("s") - low) / (high - low), 6))
    return every.select("request_id", "candidate_no", scaled.alias("bm25"))


def bm25_among(pairs: DataFrame, query: str = "query", candidate: str = "candidate") -> DataFrame:
    """The same for pairs (request_id, candidate_no, query, candidate), where each request has a list of its own."""
    requests = pairs.groupBy("request_id").agg(F.first(query).alias("query")).select("request_id", F.col("request_id").alias("list_id"), "query")
    return bm25_among_lists(requests, pairs.select(F.col("request_id").alias("list_id"), "candidate_no", F.col(candidate).alias("candidate")))


def match_elements(requests: DataFrame, embedding_weight: float = 1.0, bm25_weight: float = 0.0, default_threshold: float = 0.0, default_results: int = 1) -> DataFrame:
    """(request_id, name, similarity, rk) of requests (request_id, elementName, elementNames, similarityThreshold, maxResults).

    Spaces are dropped from all names. A candidate's similarity is the weighted sum of the cosine of hash embeddings and
    BM25 among the request's candidates; one candidate alone has its cosine. Results reach the threshold, best first, equal
    ones in the order given.
    """
    bare = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    threshold = F.coalesce("similarityThreshold", F.lit(default_threshold)) if "similarityThreshold" in requests.columns else F.lit(default_threshold)
    results = F.coalesce("maxResults", F.lit(default_results)) if "maxResults" in requests.columns else F.lit(default_results)
    pairs = requests.select("request_id", bare(F.col("elementName")).alias("query"), threshold.alias("t"), results.alias("k"), F.size("elementNames").alias("n"), F.posexplode("elementNames").alias("candidate_no", "name")).withColumn("candidate", bare(F.col("name")))
    # each distinct name is embedded once
    names = pairs.select(F.explode(F.array("query", "candidate")).alias("x")).distinct()
    texts = vectors_of(names, "x").select("x", F.coalesce("vector", no_vector()).alias("v"))
    left, right = texts.select(F.col("x").alias("query"), F.col("v").alias("qv")), texts.select(F.col("x").alias("candidate"), F.col("v").alias("cv"))
    scored = pairs.join(left, "query").join(right, "candidate").withColumn("e", F.round(cosine(F.col("qv"), F.col("cv")), 6))
    if bm25_weight:
        scored = scored.join(bm25_among(pairs), ["request_id", "candidate_no"], "left")
    else:
        scored = scored.withColumn("bm25", F.lit(0.0))
    both = F.round(embedding_weight * F.col("e") + bm25_weight * F.coalesce("bm25", F.lit(0.0)), 6)
    best = scored.withColumn("similarity", F.when(F.col("n") == 1, F.col("e")).otherwise(both)).where(F.col("similarity") >= F.col("t"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("similarity"), "candidate_no"))
    return best.withColumn("rk", rank).where(F.col("rk") <= F.col("k")).select("request_id", "name", "similarity", "rk")


def hybrid(embedded: DataFrame, lexical: DataFrame, keys: list[str], embedding_weight: float = 1.0, bm25_weight: float = 0.0) -> DataFrame:
    """embedded (keys, embedding) with lexical scores (keys, bm25); a missing one is 0; adds sim."""
    both = embedded.join(lexical, keys, "left")
    return both.withColumn("sim", F.round(embedding_weight * F.col("embedding") + bm25_weight * F.coalesce("bm25", F.lit(0.0)), 6))


def nearest_category(names: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, category, cos): of each name the nearest second-level category (name, row_no) by embedding, the first of equals;
    the cosine with a name or category without characters is 0."""

    def unit(rows: DataFrame, text: str) -> DataFrame:
        whole = vectors_of(rows, text).withColumn("_n", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
        scaled = F.transform("vector", lambda x: F.when(F.col("_n") == 0, 0.0).otherwise(x / F.col("_n")))
        return whole.withColumn("unit", F.coalesce(scaled, F.array_repeat(F.lit(0.0), 64)))

    asked = unit(names.select("name").where("name IS NOT NULL").distinct(), "name")
    known = unit(categories.select(F.col("name").alias("category"), "row_no"), "category")
    best = ip_topk(known, asked, 1, vec_id="row_no", vector="unit", query_id="name", query_vector="unit")
    own = categories.select(F.col("name").alias("category"), F.col("row_no").alias("vec_id"))
    return best.join(own, "vec_id").select(F.col("q_id").alias("name"), "category", F.col("ip").alias("cos"))
