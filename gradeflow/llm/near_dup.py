"""N-gram Jaccard join of a document table with itself, with Bayesian pruning of candidates.

1. Each distinct text is one vertex (exact copies count once), with 100 MinHash values over its word 5-grams.
2. 25 bands of 4 values put texts in buckets. Within a bucket, pairs are compared by MinHash values in groups of eight; a
   pair is dropped when the posterior probability that its similarity reaches the threshold falls below the tolerance.
   What survives leaves as a spanning forest, not as pairs.
3. Connected survivors form blocks. The texts of a block are shingled once, the same incremental test is applied to every
   pair in it, and the rest are verified by exact set sizes. A block gives each text its number of links, and a forest.
4. Connected links are the classes.

Buckets and blocks of more than BLOCK texts are dealt to tasks as pairs of sub-blocks, so no task holds a whole large group
and no pair is left out or counted twice. A link at similarity s is missed only if no band agrees (7.5e-5 at s = 0.75,
1.9e-6 at s = 0.8, 1e-8 at 0.85) or if it is pruned, which the tolerance bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest_of, only_kept, shuffle_partitions, text_of, written
from .components import components

BANDS, ROWS = 25, 4
COMPARED, STEP = 64, 8
BLOCK = 1024
TOLERANCE = 1e-7
_VOCABULARY = 8192


@lru_cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a text with 1 to n - 1 words has one, of all its words.

    Words are maximal runs of characters other than ASCII white space.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = len(own) - n + 1 if len(own) >= n else 1
    out = np.full(grams, len(own) if len(own) < n else n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(n, len(own))):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own[i : i + grams]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (len(sets) x BANDS * ROWS) of non-empty sets."""
    a, b = _hashes(BANDS * ROWS)
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    done = 0
    while done < len(sets):
        end, size = done, 0
        while end < len(sets) and (end == done or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[done:end])
        starts = np.cumsum([0, *map(len, sets[done : end - 1])])
        with np.errstate(over="ignore"):
            for i in range(BANDS * ROWS):
                out[done:end, i] = np.minimum.reduceat((flat * a[i] + b[i]) >> np.uint64(16), starts)
        done = end
    return out


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared groups, the least matches with which a pair stays.

    With a uniform prior, m matches of n values give a Beta(m + 1, n - m + 1) posterior of the similarity; P(s >= t) is the
    binomial tail P(X <= m), X ~ B(n + 1, t). A pair is dropped below the tolerance.
    """
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature blocks (rows of COMPARED bytes) that outlive the incremental comparison.

    Signatures keep a byte of each MinHash value; chance agreement of bytes only raises the count, so pruning stays safe.
    """
    least = least_matches(threshold, tolerance)
    matches = np.zeros((len(left), len(right)), np.uint8)
    for i in range(STEP):
        matches += left[:, i, None] == right[None, :, i]
    x, y = np.nonzero(matches >= least[0])
    count = matches[x, y]
    for k in range(1, COMPARED // STEP):
        at = slice(k * STEP, (k + 1) * STEP)
        count = count + (left[x, at] == right[y, at]).sum(1, dtype=np.uint8)
        keep = count >= least[k]
        x, y, count = x[keep], y[keep], count[keep]
    return x, y


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each of n vertices' component under links x, y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of equal keys, from batches sorted by them; runs of one row are left out."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cols = [held[k].to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = np.concatenate([[0], change])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                yield held.slice(a, b - a)
        held = held.slice(int(edges[-1])).combine_chunks()
    if held is not None and len(held) > 1:
        yield held


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sides(run: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two sub-blocks that a run compares; the same ones if it compares one with itself."""
    part, i, j = run["part"].to_numpy(), run["i"][0].as_py(), run["j"][0].as_py()
    return np.flatnonzero(part == i), np.flatnonzero(part == j)


def _deal(rows: DataFrame, key: str, sizes: DataFrame, spark_key: str = "uid") -> DataFrame:
    """rows sorted into runs (key, i, j); a key with more than BLOCK rows has a run for each pair of its sub-blocks."""
    big = sizes.where(F.col("n") > BLOCK).select(F.col(key).alias("_big"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    parts = F.coalesce(F.col("blocks"), F.lit(1))
    dealt = (
        rows.join(big, F.col(key) == F.col("_big"), "left")
        .withColumn("part", F.pmod(F.xxhash64(spark_key), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .drop("_big", "blocks", "other")
    )
    return dealt.repartition(shuffle_partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def _uid(text: str) -> Column:
    return F.substring(digest_of(text_of(text)), 1, 16)


def signatures(texts: DataFrame, n: int) -> DataFrame:
    """(uid, signature, bands) of distinct texts (uid, text) with a word: COMPARED bytes, and a 64-bit key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, sets = [], []
                for u, t in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256]):
                    if u not in seen and len(s := shingles(t.as_py(), n)):
                        seen.add(u)
                        ids.append(u)
                        sets.append(s)
                if not ids:
                    continue
                values = minhashes(sets)
                keys = np.zeros((len(ids), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    keys += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(ROWS):
                        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + values[:, r::ROWS]
                    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                small = np.ascontiguousarray((values[:, :COMPARED] & np.uint64(255)).astype(np.uint8))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([x.tobytes() for x in small], pa.binary()), bands], names=["uid", "signature", "bands"])

    return texts.select("uid", "text").mapInArrow(run, "uid binary, signature binary, bands array<long>")


def candidates(signed: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs in each bucket that outlive the pruning."""
    buckets = signed.select(F.explode("bands").alias("bucket"), "uid", "signature")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["bucket", "i", "j"]):
            sign, (left, right) = _matrix(rows["signature"], COMPARED), _sides(rows)
            x, y = survivors(sign[left], sign[right], threshold, tolerance)
            label = forest(len(rows), left[x], right[y])
            leaf = np.flatnonzero(label != np.arange(len(rows)))
            if len(leaf):
                ids = rows["uid"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(leaf)), ids.take(pa.array(label[leaf]))], names=["a", "b"])

    return _deal(buckets, "bucket", written(sizes.where(F.col("n") > BLOCK))).mapInArrow(run, "a binary, b binary").distinct()


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one, as a matrix product over slices of the terms."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, term, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[term] > 1
    ids, term = np.unique(term[shared], return_inverse=True)
    order = np.argsort(term, kind="stable")
    term, owner = term[order], owner[shared][order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, len(ids), _VOCABULARY):
        a, b = np.searchsorted(term, [first, first + _VOCABULARY])
        table = np.zeros((len(sets), min(_VOCABULARY, len(ids) - first)), np.float32)
        table[owner[a:b], term[a:b] - first] = 1
        out += table[left] @ table[right].T
    return out.astype(np.int64)


def first_in_task(texts: DataFrame) -> DataFrame:
    """texts (uid, text) with one row of each uid in a task: the copies of a hot text shrink before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for u in batch.column(0).to_pylist():
                new.append(u not in seen)
                seen.add(u)
            yield batch.filter(pa.array(new))

    return texts.select("uid", "text").mapInArrow(run, "uid binary, text string")


def verified(members: DataFrame, texts: DataFrame, threshold: float, tolerance: float, n: int) -> DataFrame:
    """(uid, root, links): links of each text within a run, and the least text it is linked to there."""
    sizes = written(members.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), n) for t in part.column(2)]
                small = (minhashes(sets)[:, :COMPARED] & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in small], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["label", "uid", "signature", "grams"])

    percent = round(threshold * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["label", "i", "j"]):
            signs, (left, right) = _matrix(rows["signature"], COMPARED), _sides(rows)
            x, y = survivors(signs[left], signs[right], threshold, tolerance)
            within = rows["i"][0].as_py() == rows["j"][0].as_py()
            keep = x < y if within else slice(None)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            sets = [np.frombuffer(g, np.uint64) for g in rows["grams"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            both = _overlaps(sets, left, right)[x, y]
            x, y = left[x], right[y]
            good = 1_000_000 * both >= percent * (sizes[x] + sizes[y] - both)
            x, y = x[good], y[good]
            links = np.bincount(x, minlength=len(rows)) + np.bincount(y, minlength=len(rows))
            label, linked = forest(len(rows), x, y), np.flatnonzero(links)
            ids = rows["uid"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(label[linked])), pa.array(links[linked].astype(np.int64))], names=["uid", "root", "links"])

    own = first_in_task(texts)
    # shuffled at any size: members are no bounded side, and a plan that changes with them hides its growth
    held = own.join(members.hint("merge"), own["uid"] == members["vertex"]).select("label", "uid", "text").dropDuplicates(["uid"])
    return _deal(held.mapInArrow(sign, "label binary, uid binary, signature binary, grams binary"), "label", sizes).mapInArrow(run, "uid binary, root binary, links long")


def _links(texts: DataFrame, threshold: float, tolerance: float, n: int) -> DataFrame:
    signed = written(signatures(texts, n).dropDuplicates(["uid"]))
    members = written(components(candidates(signed, threshold, tolerance)))
    return written(verified(members, texts, threshold, tolerance, n))


def class_of_texts(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(uid, class) of every different text: class is the least uid of the texts that links connect."""
    texts = docs.select(_uid(text).alias("uid"), text_of(text).alias("text"))
    found = _links(texts, threshold, tolerance, n)
    classes = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    own = docs.select(_uid(text).alias("uid")).distinct()
    return written(own.join(classes, F.col("uid") == F.col("vertex"), "left").select("uid", F.coalesce("label", "uid").alias("class")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = TOLERANCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row.

    Two texts are linked if the Jaccard similarity of their word n-gram sets is at least ``threshold``. class_id is the
    least doc_id of all rows whose texts are connected by links, n_links the number of different texts that the row's text
    is linked to, n_copies the number of rows with exactly its text. Texts without a word are linked to nothing, but equal
    ones are one class, as are all equal texts; a null text is empty. A null doc_id is never a class_id unless a class has
    no other. An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(_uid(text).alias("uid"), text_of(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    found = _links(texts, threshold, tolerance, n)
    classes = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy(F.col("uid").alias("linked")).agg(F.sum("links").alias("n_links"))

    rows = docs.select(_uid(text).alias("uid"), F.col(doc_id).cast("long").alias("doc_id"))
    groups = rows.groupBy("uid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    known = written(
        groups.join(classes, groups["uid"] == classes["vertex"], "left")
        .join(links, F.col("uid") == F.col("linked"), "left")
        .select("uid", F.coalesce("label", "uid").alias("class"), "least", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    least = known.groupBy("class").agg(F.min("least").alias("class_id"))
    return rows.join(known.join(least, "class").select("uid", "class_id", "n_links", "n_copies"), "uid").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class of near copies: that with the least doc_id (null only if the class has no other id).

    If rows of a class share this id, that with the least digest of its text stays; of rows that repeat both, one.
    """
    classes = class_of_texts(docs, threshold, text=text, doc_id=doc_id)
    ids = docs.select(_uid(text).alias("uid"), F.col(doc_id).cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "uid")).alias("m")
    keep = ids.join(classes, "uid").groupBy("class").agg(first).select(F.col("m.uid").alias("digest"), F.col("m.id").alias("keep_id"))
    return only_kept(docs, keep, _uid(text), doc_id)
