"""Embeddings and exact vector search.

A search packs queries and corpus into blocks of rows, each block one row of a table, and deals both over a grid: a block of
queries goes to all slabs of the corpus, a block of the corpus to all parts of the queries, and each cell of the grid is one
part and one slab. A task holds the part's queries and takes the slab block by block, and keeps the best k of each query or the
pairs above a threshold; a window merges what the slabs kept. Nothing but the numbers of blocks reaches the driver, and the plan
is the same for any number of queries. Hash embeddings are the same on any engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from ..functions.text import let
from ..session import stored

#: Rows of a block; blocks in a part of the queries and in a slab of the corpus, on average.
BLOCK, PART, SLAB = 1024, 8, 64
#: Blocks hold rows of one group, and groups are counted in so many buckets.
BUCKETS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Within -1 and 1; 0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def _width(rows: DataFrame) -> type:
    return np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64


def _packed(rows: DataFrame) -> DataFrame:
    """(bucket, g, ids, v) blocks of rows (id, v, g): vectors of one group as the bytes of a matrix."""
    kind, width = rows.schema["id"].dataType, _width(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(2).dictionary_encode()
            code = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                name = None if code[own[0]] < 0 else groups.dictionary[int(code[own[0]])].as_py()
                for at in range(0, len(own), BLOCK):
                    block = batch.take(pa.array(own[at : at + BLOCK]))
                    matrix = block.column(1).flatten().to_numpy(zero_copy_only=False).astype(width)
                    ids = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), ids, pa.array([matrix.tobytes()], pa.binary())], names=["g", "ids", "v"])

    schema = StructType([StructField("g", StringType()), StructField("ids", ArrayType(kind)), StructField("v", BinaryType())])
    return rows.select("id", "v", F.col("g").cast("string").alias("g")).mapInArrow(run, schema).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int"))


def _over(vectors: DataFrame, queries: DataFrame, kernel: Callable[[], Kernel], schema: str) -> DataFrame:
    """A kernel for every cell of the grid of queries (id, v, g) and vectors (id, v, g)."""
    spark = vectors.sparkSession
    packed, widths = [stored(_packed(x)) for x in (queries, vectors)], (_width(queries), _width(vectors))
    sizes = np.zeros((2, BUCKETS), int)
    for side, blocks in enumerate(packed):
        for bucket, n in blocks.groupBy("bucket").count().collect():
            sizes[side, bucket] = n
    parts = -(-sizes[0] // PART)
    # a slab more for each task that would be idle, down to one block
    spare = -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, int(parts.sum())))
    slabs = np.maximum(-(-sizes[1] // SLAB), np.minimum(sizes[1], spare))
    number = lambda counts: F.get(F.array(*map(F.lit, counts.tolist())), F.col("bucket"))
    dealt = lambda counts: F.pmod(F.xxhash64("ids"), number(counts).cast("long")).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), number(counts) - 1))
    met = [x.where((number(parts) > 0) & (number(slabs) > 0)) for x in packed]
    asked = met[0].select("bucket", dealt(parts).alias("part"), every(slabs).alias("slab"), F.lit(0).alias("side"), "g", "v", F.col("ids").alias("q_ids"), F.lit(None).cast(packed[1].schema["ids"].dataType).alias("ids"))
    known = met[1].select("bucket", every(parts).alias("part"), dealt(slabs).alias("slab"), F.lit(1).alias("side"), "g", "v", F.lit(None).cast(packed[0].schema["ids"].dataType).alias("q_ids"), "ids")
    cell = ["bucket", "part", "slab"]
    grid = asked.union(known).repartition(*cell).sortWithinPartitions(*cell, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        out = lambda columns: pa.RecordBatch.from_arrays(list(columns), names=[x.split(" ")[0] for x in schema.split(", ")])
        for batch in batches:
            cells = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            for i, (*here, side, g) in enumerate(cells):
                if here != at:
                    yield from map(out, own.kept() if own else ())
                    at, own = here, kernel()
                ids = batch.column(7 if side else 6)[i].values
                matrix = np.frombuffer(batch.column(5)[i].as_buffer(), widths[side]).astype(np.float64).reshape(len(ids), -1)
                if side:
                    yield from map(out, own.meet(g, ids, matrix))
                else:
                    own.ask(g, ids, matrix)
        yield from map(out, own.kept() if own else ())

    return grid.mapInArrow(run, schema)


class Kernel:
    """What a cell does: it is given all its queries, then the corpus block by block."""

    def __init__(self) -> None:
        self.asked: dict[str | None, list[tuple[pa.Array, np.ndarray]]] = {}
        self.whole: dict[str | None, tuple[pa.Array, np.ndarray]] = {}

    def ask(self, g: str | None, ids: pa.Array, matrix: np.ndarray) -> None:
        self.asked.setdefault(g, []).append((ids, matrix))

    def queries(self, g: str | None) -> tuple[pa.Array, np.ndarray] | None:
        if g not in self.whole and g in self.asked:
            own = self.asked.pop(g)
            self.whole[g] = pa.concat_arrays([x for x, _ in own]), np.concatenate([m for _, m in own])
        return self.whole.get(g)

    def meet(self, g: str | None, ids: pa.Array, matrix: np.ndarray) -> Iterator[tuple]:
        raise NotImplementedError

    def kept(self) -> Iterator[tuple]:
        return iter(())


class _Best(Kernel):
    """The k best rows of each query: by score, equal ones by id."""

    def __init__(self, k: int) -> None:
        super().__init__()
        self.k, self.held, self.kind = k, {}, None

    def meet(self, g: str | None, ids: pa.Array, matrix: np.ndarray) -> Iterator[tuple]:
        if (asked := self.queries(g)) is not None:
            self.kind, names = ids.type, np.array(ids.to_pylist())
            # a part may hold many blocks of queries; a block of them at a time bounds the scores
            for begin in range(0, len(asked[0]), BLOCK):
                self._meet((g, begin), asked[1][begin : begin + BLOCK] @ matrix.T, names)
        return iter(())

    def _meet(self, own: tuple[str | None, int], score: np.ndarray, names: np.ndarray) -> None:
        np.round(score, 6, out=score)
        # the least score among a query's best of this block; those that equal it stay for the ids to decide
        size = min(self.k, score.shape[1])
        least = np.partition(score, score.shape[1] - size, axis=1)[:, score.shape[1] - size]
        q, at = np.nonzero(score >= least[:, None])
        found = q, names[at], score[q, at]
        both = found if own not in self.held else tuple(np.concatenate(x) for x in zip(self.held[own], found, strict=True))
        order = np.lexsort((both[1], -both[2], both[0]))
        first = np.searchsorted(both[0][order], both[0][order])
        self.held[own] = tuple(x[order[np.arange(len(order)) - first < self.k]] for x in both)

    def kept(self) -> Iterator[tuple]:
        for (g, begin), (q, ids, score) in self.held.items():
            yield self.whole[g][0].take(pa.array(q + begin)), pa.array([g] * len(q), pa.string()), pa.array(ids.tolist(), self.kind), pa.array(score)


def ip_topk(vectors: DataFrame, queries: DataFrame, k: int, predicate: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", query_id: str = "q_id", query_vector: str = "q_vector", by: str | None = None) -> DataFrame:
    """(q_id, vec_id, ip, rk): the k vectors with the largest inner product with each query, rounded to six places, equal
    ones by id; of those that meet the predicate. ``by`` names a column that query and vector must have in common; rows of
    a query for several values of it are ranked for each, and the result has it as ``collection``."""
    kept = vectors if predicate is None else vectors.where(predicate)
    group = F.col(by) if by else F.lit(0)
    kept = vectors if predicate is None else vectors.where(predicate)
    side = lambda df, i, v: df.where(F.col(v).isNotNull()).select(F.col(i).alias("id"), F.col(v).alias("v"), group.alias("g"))
    corpus, asked = side(kept, vec_id, vector), side(queries, query_id, query_vector)
    kinds = [x.schema["id"].dataType.simpleString() for x in (asked, corpus)]
    scored = _over(corpus, asked, lambda: _Best(k), f"q_id {kinds[0]}, g string, vec_id {kinds[1]}, ip double")
    best = Window.partitionBy("q_id", "g").orderBy(F.desc("ip"), "vec_id")
    ranked = scored.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
    return ranked.select("q_id", *([F.col("g").cast(corpus.schema["g"].dataType).alias("collection")] if by else []), "vec_id", "ip", "rk")


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class _Alike(Kernel):
    def __init__(self, least: float) -> None:
        super().__init__()
        self.least, self.unit = least, {}

    def meet(self, g: str | None, ids: pa.Array, matrix: np.ndarray) -> Iterator[tuple]:
        if (asked := self.queries(g)) is not None:
            if g not in self.unit:
                self.unit[g] = _unit(asked[1])
            other = _unit(matrix).T
            for at in range(0, len(asked[0]), BLOCK):
                cos = np.round(np.clip(self.unit[g][at : at + BLOCK] @ other, -1, 1), 6)
                q, v = np.nonzero(cos >= self.least)
                if len(q):
                    yield asked[0].take(pa.array(q + at)), ids.take(pa.array(v)), pa.array(cos[q, v])


def similar(vectors: DataFrame, queries: DataFrame, least: float, vec_id: str = "vec_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """(a_id, b_id, cos): every query a and every vector b, other than by id itself, whose cosine, rounded to six places, is at
    least ``least``; a zero vector has the cosine 0. ``within`` names a column in which both must be equal."""
    group = F.col(within) if within else F.lit(0)
    side = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(vec_id).alias("id"), F.col(vector).alias("v"), group.alias("g"))
    corpus, asked = side(vectors), side(queries)
    kind = corpus.schema["id"].dataType.simpleString()
    return _over(corpus, asked, lambda: _Alike(least), f"a_id {kind}, b_id {kind}, cos double").where("a_id <> b_id")


def pairs_above(vectors: DataFrame, least: float, vec_id: str = "vec_id", vector: str = "embedding", within: str | None = None) -> DataFrame:
    """(a_id, b_id, cos) of all pairs a < b with a cosine of at least ``least``, as in ``similar``."""
    return similar(vectors, vectors, least, vec_id, vector, within).where("a_id < b_id")


def _grams(text: Column, n: int) -> Column:
    """Character n-grams; a shorter text is its own. Characters are split once and met by index: a substring counts from the
    text's start, and a slice copies the array."""
    whole = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(c) - n)), lambda i: F.concat_ws("", *[F.get(c, i + k) for k in range(n)]))
    return F.when(F.length(text) > 0, let(F.split(text, ""), whole)).otherwise(F.array().cast("array<string>"))


def hash_term(gram: Column, dims: int = 64) -> Column:
    """(dim, sign) of an n-gram: seven leading hex digits of its md5 modulo dims, an eighth for the sign."""
    h = F.md5(gram.cast("binary"))
    return F.struct((F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % dims).cast("int").alias("dim"), F.when(F.substring(h, 8, 1).isin(*"01234567"), 1).otherwise(-1).alias("sign"))


def hash_terms(text: Column, dims: int = 64, n: int = 3) -> Column:
    """(dim, sign) of each character n-gram."""
    return F.transform(_grams(text, n), lambda g: hash_term(g, dims))


def _term(gram: str, dims: int) -> tuple[int, int]:
    h = hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:7], 16) % dims, 1 if h[7] < "8" else -1


def _embedded(texts: list[str], dims: int, n: int, terms: dict[str, tuple[int, int]]) -> np.ndarray:
    """Signed counts (texts x dims) of the n-grams of texts; terms keeps what n-grams are worth."""
    out = np.zeros((len(texts), dims), np.int64)
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    grams = max(0, len(codes) - n + 1)
    key = codes[:grams].copy()
    for i in range(1, n):
        if i > 2:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * 0x110000 + codes[i : i + grams]
    inside = np.flatnonzero(owner[:grams] == owner[n - 1 : n - 1 + grams])
    _, first, kind = np.unique(key[inside], return_index=True, return_inverse=True)
    for at in inside[first].tolist():
        gram = whole[at : at + n]
        if gram not in terms:
            if len(terms) >= 1_000_000:
                terms.clear()
            terms[gram] = _term(gram, dims)
    if len(inside):
        worth = np.array([terms.get(whole[at : at + n]) or _term(whole[at : at + n], dims) for at in inside[first].tolist()])
        cell = owner[inside] * dims + worth[kind, 0]
        out += np.bincount(cell, weights=worth[kind, 1], minlength=out.size).astype(np.int64).reshape(out.shape)
    for i in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        dim, sign = _term(texts[i], dims)
        out[i, dim] += sign
    return out


def hash_embed(texts: DataFrame, text: str = "text", dims: int = 64, n: int = 3) -> DataFrame:
    """(text_md5, dim, weight) of each distinct text: signed counts of its n-grams by dimension; zero ones are left out.

    An embedding depends on its text alone, so distinct texts go through one Arrow pass, and nothing is shuffled after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: dict[str, tuple[int, int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(at, 256).to_pylist()
                weight = _embedded(own, dims, n, terms)
                row, dim = np.nonzero(weight)
                digest = np.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in own], object)
                yield pa.RecordBatch.from_arrays([pa.array(digest[row], pa.string()), pa.array(dim.astype(np.int32)), pa.array(weight[row, dim])], names=["text_md5", "dim", "weight"])

    distinct = texts.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "text_md5 string, dim int, weight long")


def hash_vector(text: Column, dims: int = 64, n: int = 3) -> Column:
    """The same embedding as an array, in one expression."""
    zero = F.array_repeat(F.lit(0.0), dims)
    add = lambda v, x: F.transform(v, lambda w, i: F.when(i == x["dim"], w + x["sign"]).otherwise(w))
    return F.aggregate(hash_terms(text, dims, n), zero, add)


def vectors_of(rows: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """rows with ``vector``, the hash embedding of a text; rows whose text has none have null."""
    named = rows.withColumn("_md5", F.md5(F.col(text).cast("binary")))
    weights = hash_embed(named.select(F.col(text).alias("text")), dims=dims)
    # a bounded number of weights for each text
    by_text = weights.groupBy("text_md5").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("_w"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0)).cast("float"))
    return named.join(by_text, F.col("_md5") == F.col("text_md5"), "left").withColumn("vector", F.when(F.col("_w").isNotNull(), vector)).drop("_md5", "text_md5", "_w")


def no_vector(dims: int = 64) -> Column:
    """The embedding of a text without n-grams."""
    return F.array_repeat(F.lit(0.0).cast("float"), dims)


def embed(df: DataFrame, column: str, embedder: Callable[[list[str]], list[list[float]]], out: str = "vector", longest: int = 3000, cache: DataFrame | None = None) -> DataFrame:
    """Adds the vector that ``embedder`` gives for each text: called with the distinct texts of an Arrow batch, cut to
    ``longest`` characters. ``cache`` (text_md5, vector) spares texts that it holds."""
    keyed = df.withColumn("_md5", F.md5(F.substring(F.coalesce(F.col(column), F.lit("")), 1, longest).cast("binary")))
    texts = keyed.select("_md5", F.substring(F.coalesce(F.col(column), F.lit("")), 1, longest).alias("_text")).dropDuplicates(["_md5"])
    if cache is not None:
        texts = texts.join(cache.select(F.col("text_md5").alias("_md5")), "_md5", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))], names=["_md5", out])

    new = texts.mapInArrow(run, f"_md5 string, {out} array<float>")
    if cache is not None:
        new = new.unionByName(cache.select(F.col("text_md5").alias("_md5"), F.col("vector").cast("array<float>").alias(out)))
    return keyed.join(new, "_md5", "left").drop("_md5")


def fresh(cache: DataFrame, hours: int = 24, created_at: str = "created_at") -> DataFrame:
    """The cache rows that are no older than ``hours``."""
    return cache.where(F.col(created_at) > F.current_timestamp() - F.make_interval(hours=F.lit(hours)))
