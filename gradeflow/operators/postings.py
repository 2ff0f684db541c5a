"""An index for BM25: segments of documents, in each the postings of its tokens.

Built once for a corpus and read by all searches. A search goes over the segments where they lie: no posting is shuffled, and a
token that every document has makes no rows for documents and queries, but an addition to a vector of the segment's scores. From
lengths and counts a task makes each posting's share of a score; with a token's largest share it tells what a query could reach in
a segment, and leaves out those in which no document can come up to the k-th best that it has seen. What is left is scored in full,
so results are those of ``lexical.bm25_topk``.

Tokens are those of ``functions.text.tokens``, read off the bytes of many texts at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.text import tokens
from ..session import scratch_dir, version_of
from .cells import meet
from .lexical import EPSILON, FEW_TOKENS, K1, B

#: Documents of a segment, and words of six bytes that end one.
DOCS, WORDS = 4096, 2_000_000
#: Bytes of texts that are read at once.
PIECE = 1 << 20
#: Of what an index holds; another one has other folders.
FORMAT = 2
#: Queries that meet the segments at once where they are too many to be broadcast.
QUERIES = 1024
#: What rounding to six places may add to a score.
ROUNDING = 1e-6

_SEGMENT = "lengths binary, tokens array<string>, df array<long>, places binary, tf binary, n long, total long"
_READ = ["docs", "lengths", "tokens", "df", "places", "tf"]
#: Lower-case letters and digits by byte, 0 for all others.
_LETTERS = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LETTERS[[_c, ord(chr(_c).upper())]] = _c


class Index(NamedTuple):
    tokens: DataFrame  # (token, idf)
    segments: DataFrame  # (docs, lengths, tokens, df, places, tf, n, total): of each token df places among docs and its counts there
    mean: float  # length of a document


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest one takes."""
    return values.astype(np.min_scalar_type(values.max(initial=0))).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.zeros(0, np.uint8)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts, and the place of each one's text; a text's tokens are in no order."""
    # the two letters outside ASCII whose lower case begins with one of ASCII
    texts = pc.replace_substring(pc.replace_substring(texts.cast(pa.string()), "\u212a", "k"), "\u0130", "i\u0307")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if bounds[0] == bounds[-1]:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
    low = _LETTERS[data]
    inside = low > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]  # a word ends with its text
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - begin > 1
    inside[begin[~long]] = False
    begin, size = begin[long], (end - begin)[long]
    held = low[inside]
    high = np.flatnonzero((data[:-2] >= 0xE4) & (data[:-2] <= 0xE9)) if len(data) > 2 else np.zeros(0, np.int64)
    if len(high):
        code = (data[high].astype(np.int64) & 15) << 12 | (data[high + 1].astype(np.int64) & 63) << 6 | data[high + 2] & 63
        high = high[(code >= 0x4E00) & (code <= 0x9FFF)]
        own = np.searchsorted(bounds, high, side="right")
        pair = high[:-1][(np.diff(high) == 3) & (np.diff(own) == 0)]
        held = np.concatenate([held, data[pair[:, None] + np.arange(6)].ravel()])
        begin, size = np.concatenate([begin, pair]), np.concatenate([size, np.full(len(pair), 6)])
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(held)), np.searchsorted(bounds, begin, side="right") - 1


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by token and document of some thousand documents each, from (doc_id, text)."""
    for batch in batches:
        texts = batch.column(1)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            most = (ends[lo - 1] if lo else 0) + 6 * WORDS
            hi = max(lo + 1, min(lo + DOCS, int(np.searchsorted(ends, most, side="right"))))
            words, places, at = [], [], lo
            while at < hi:
                to = max(at + 1, min(hi, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right"))))
                own, place = _tokens(texts.slice(at, to - at))
                words.append(own)
                places.append(place + (at - lo))
                at = to
            coded = pa.chunked_array(words).dictionary_encode()
            known = coded.chunk(0).dictionary
            kind = np.int32 if len(known) * (hi - lo) < 1 << 31 else np.int64
            key = np.concatenate([c.indices.to_numpy().astype(kind) * kind(hi - lo) + x.astype(kind) for c, x in zip(coded.chunks, places)])
            size = np.bincount(key % kind(hi - lo), minlength=hi - lo)
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            tf, key = np.diff(first, append=len(key)), key[first]
            df = np.bincount(key // kind(hi - lo), minlength=len(known))
            ids = batch.column(0).slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids])),
                    pa.array([_packed(size)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known),
                    pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), pa.array(df.astype(np.int64))),
                    pa.array([_packed(key % kind(hi - lo))], pa.binary()),
                    pa.array([_packed(tf)], pa.binary()),
                    pa.array([hi - lo], pa.int64()),
                    pa.array([int(size.sum())], pa.int64()),
                ],
                names=["docs", *(x.split(" ")[0] for x in _SEGMENT.split(", "))],
            )
            lo = hi


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of documents below a path."""
    spark = docs.sparkSession
    ids = StructField("docs", ArrayType(docs.schema[doc_id].dataType))
    listed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed.mapInArrow(_segments, StructType([ids, *StructType.fromDDL(_SEGMENT)])).write.parquet(f"{path}/segments")
    counts = spark.read.parquet(f"{path}/segments")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = counts.select(F.explode(F.arrays_zip("tokens", "df")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.df").alias("df"))
    raw = df.select("token", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    low = raw.agg(F.avg("raw").alias("mean"))
    raw.crossJoin(F.broadcast(low)).select("token", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")).write.parquet(f"{path}/tokens")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    segments = spark.read.parquet(f"{path}/segments")
    n, total = segments.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Index(spark.read.parquet(f"{path}/tokens"), segments, total / n if n else 0.0)


def index_of(spark: SparkSession, source: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of a Parquet table of documents, built if there is none of the table's present state in the shared folder.

    An index is made in a folder of its own and named when it is whole, so a build that fails leaves none, and of two at once
    either is right.
    """
    place = f"{scratch_dir(spark)}/segments-{FORMAT}-{version_of(spark, source)}-{doc_id}-{text}"
    try:
        return read(spark, spark.read.text(f"{place}/built").agg(F.min("value")).first()[0])
    except AnalysisException:
        path = f"{place}/{uuid.uuid4().hex}"
        index = build(spark.read.parquet(source), path, doc_id, text)
        spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("append").text(f"{place}/built")
        return index


def _weighed(mean: float, n: int, lengths: bytes, df: np.ndarray, places: bytes, tf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment's postings the largest share of each token, the places and the shares."""
    postings = int(df.sum())
    place, times = _unpacked(places, postings).astype(np.int32), _unpacked(tf, postings)
    norm = K1 * (1 - B + B * _unpacked(lengths, n) / (mean or 1))
    share = times * (K1 + 1) / (times + norm[place])
    return np.maximum.reduceat(share, np.cumsum(df) - df) if postings else share, place, share


class _Searcher:
    """The queries (id, tokens, weights) of a task, and the k-th best score of each so far."""

    def __init__(self, queries: list[tuple[Any, list[str], list[float]]], k: int) -> None:
        self.queries, self.k = queries, k
        self.reached: list[list[float]] = [[] for _ in queries]

    def search(self, docs: list, names: list[str], df: np.ndarray, most: np.ndarray, places: bytes | np.ndarray, shares: bytes | np.ndarray) -> Iterator[tuple[Any, Any, float]]:
        """(query, doc, score) of what may be among the k best of all."""
        return self.among(docs, {t: i for i, t in enumerate(names)}, df, most, places, shares)

    def among(self, docs: list, known: dict[str, int], df: np.ndarray, most: np.ndarray, places: bytes | np.ndarray, shares: bytes | np.ndarray) -> Iterator[tuple[Any, Any, float]]:
        """The same, from the numbers that asked tokens have in the segment."""
        ends = np.cumsum(df)
        place, share = np.frombuffer(places, np.int32).astype(np.intp), np.frombuffer(shares, np.float64)
        for number, (query, own, weights) in enumerate(self.queries):
            held = [(known[t], w) for t, w in zip(own, weights, strict=True) if t in known]
            best = self.reached[number]
            if not held or (len(best) == self.k and sum(max(w, 0.0) * most[i] for i, w in held) + ROUNDING < best[-1]):
                continue
            spans = [slice(ends[i] - df[i], ends[i]) for i, _ in held]
            parts = np.concatenate([w * share[at] for at, (_, w) in zip(spans, held)])
            score = np.round(np.bincount(np.concatenate([place[at] for at in spans]), parts, len(docs)), 6)
            at = np.flatnonzero(score > 0)
            if len(at) > self.k:
                least = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
                at = at[score[at] >= least]
            self.reached[number] = sorted([*best, *score[at].tolist()], reverse=True)[: self.k]
            yield from ((query, docs[i], float(score[i])) for i in at.tolist())


def topk(index: Index, queries: DataFrame, k: int = 15, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rk) of the k best documents of each query with a positive score; equal ones by id.

    Queries are broadcast if they have few tokens (their number is checked); more of them are dealt in parts that all segments
    go past.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    weighed = asked.join(index.tokens, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    packed = weighed.groupBy("query_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("weight").alias("weights"))
    kinds = queries.schema[query_id].dataType, index.segments.schema["docs"].dataType.elementType
    few = weighed.limit(FEW_TOKENS + 1).collect()
    mean = index.mean
    if len(few) <= FEW_TOKENS:
        own: dict[Any, tuple[Any, list, list]] = {}
        for q, token, weight in few:
            one = own.setdefault(q, (q, [], []))
            one[1].append(token)
            one[2].append(weight)
        shared = queries.sparkSession.sparkContext.broadcast(list(own.values()))
        schema = StructType([StructField("query_id", kinds[0]), StructField("doc_id", kinds[1]), StructField("score", StructType.fromDDL("s double")[0].dataType)])
        shape = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = _Searcher(shared.value, k)
            asked = pa.array({t for _, own, _ in shared.value for t in own}, pa.string())
            for batch in batches:
                for i in range(batch.num_rows):
                    docs, lengths, names, df, places, tf = (batch.column(c)[i] for c in _READ)
                    at = np.flatnonzero(pc.is_in(names.values, value_set=asked).to_numpy(zero_copy_only=False))
                    known = dict(zip(names.values.take(pa.array(at)).to_pylist(), at.tolist()))
                    n = df.values.to_numpy()
                    found = list(searcher.among(docs.values.to_pylist(), known, n, *_weighed(mean, len(docs), lengths.as_py(), n, places.as_py(), tf.as_py())))
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*found, strict=True) if found else ([], [], []), shape, strict=True)], names=shape.names)

        scored = index.segments.select(_READ).mapInArrow(run, schema)
    else:
        parts = -(-queries.count() // QUERIES)
        held = packed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        streamed = index.segments.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *_READ)

        def through(searcher: _Searcher, row: tuple) -> Iterator[tuple[Any, Any, float]]:
            docs, lengths, names, df, places, tf = row
            n = np.asarray(df, np.int64)
            return searcher.search(docs, names, n, *_weighed(mean, len(docs), lengths, n, places, tf))

        schema = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"
        scored = meet(held, streamed, "part", F.col("docs"), lambda rows: _Searcher(rows, k), through, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.select("query_id", "doc_id", "score").withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
