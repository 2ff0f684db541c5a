"""Phrase collocation mining: suffix pointers are routed over the cluster by their leading words, and each range of them is
sorted by multikey three-way quicksort, whose equal partitions are the phrase counts.

1. Word counts by language. Words that are rarer than a phrase must be can be in no phrase; a bit filter of fixed size, made of
   the frequent ones, goes to the tasks. It only saves work: a word that passes by chance is counted and then dropped.
2. Each position gives the suffix of its next words, up to the longest phrase, within its piece and before the first word that
   is surely rare. Equal suffixes of a block of text become one with a weight.
3. The suffixes are dealt by ranges of language and words in order. A common leading word or pair is so many ranges
   as it needs, and each task sorts its range. Only prefixes of a range's first and last suffix can go on in another range; they
   are passed on as parts, all others are whole, and partitions below the least count are abandoned.
4. Cuts, containment and ranks are joins and windows over the phrases that remain.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_of, written

_BLOCK = 4 << 20  # bytes of text that a task takes at once
_RANGE = 750_000  # suffixes of a range, on average
_FILTER_BITS = 26  # the filter of frequent words has 2^26 bits, 8 MB
_SALTS = 64  # parts of a language in the first ranking

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and where each value begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[: at[-1]], at


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, distinct words, word codes, language codes, whether the next word is in the same piece) of blocks of a batch;
    blocks end at the end of a piece."""
    data, at = _flat(batch.column(1))
    langs = batch.column(0).dictionary_encode()
    of_row, lo, end = langs.indices.to_numpy(zero_copy_only=False), int(at[0]), int(at[-1])
    while lo < end:
        hi = end
        if end - lo > _BLOCK:
            starts = at[(at > lo) & (at <= lo + _BLOCK)]
            cuts = np.flatnonzero(_KIND[data[lo : lo + _BLOCK]] == 2)
            hi = max(int(starts[-1]) if len(starts) else 0, lo + int(cuts[-1]) + 1 if len(cuts) else 0)
            if not hi:  # one piece is longer than a block
                later = at[at > lo]
                step = lo + _BLOCK
                hi = int(later[0])
                while step < hi:
                    cuts = np.flatnonzero(_KIND[data[step : min(step + _BLOCK, hi)]] == 2)
                    if len(cuts):
                        hi = step + int(cuts[0]) + 1
                    step += _BLOCK
        text = _LOWER[data[lo:hi]]
        kind = _KIND[text]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = at[(at >= lo) & (at < hi)] - lo
        first[begins] = inside[begins]
        starts = np.flatnonzero(first)
        if len(starts):
            breaks = np.cumsum(kind == 2, dtype=np.int32)[starts]
            row = np.searchsorted(at, starts + lo, side="right") - 1
            lengths = np.add.reduceat(inside, starts, dtype=np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(text[inside])]).dictionary_encode()
            same = np.zeros(len(starts), bool)
            same[:-1] = (breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1])
            yield langs.dictionary.to_pylist(), words.dictionary, words.indices.to_numpy(zero_copy_only=False), of_row[row], same
        lo = hi


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for langs, words, code, lang, _ in _blocks(batch):
            key, n = np.unique(lang.astype(np.int64) * len(words) + code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(key // len(words))), words.take(pa.array(key % len(words))).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])


def _suffixes(bits: bytes, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, suffix, n): the distinct suffixes of each block that have two words at least; a blank follows each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(bits, np.uint8)
        for batch in batches:
            for langs, words, code, lang, same in _blocks(batch):
                bit = np.array([zlib.crc32(w) for w in words.to_pylist()], np.int64) & ((1 << _FILTER_BITS) - 1)
                usable = (often[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)[code]
                at = np.flatnonzero(usable[:-1] & usable[1:] & same[:-1])
                if not len(at):
                    continue
                # each round adds a word to the suffixes' keys; keys are numbered anew, so they stay small
                key, going, columns = lang[at].astype(np.int64) * len(words) + code[at], np.ones(len(at), bool), [code[at]]
                for k in range(1, longest):
                    place = np.minimum(at + k, len(code) - 1)
                    going &= same[place - 1] & usable[place] & (at + k < len(code))
                    columns.append(np.where(going, code[place], -1))
                    key = np.unique(key, return_inverse=True)[1] * (len(words) + 1) + columns[-1] + 1
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                taken = [words.take(pa.array(c[first], mask=c[first] < 0)) for c in columns]
                suffix = pc.binary_join_element_wise(*taken, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()), null_handling="skip")
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[at][first])), suffix.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "suffix", "n"])

    return run


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the columns of ``keys`` (depth x n), to its last row.

    Yields (depth, one pointer of each, weight) of equal partitions: pointers that agree in their first ``depth`` keys. Partitions
    under ``least`` are abandoned. A pass splits all open partitions at once, each by its own pivot, a median of three.
    """
    pointer = np.arange(keys.shape[1])
    sizes, depth = np.array([len(pointer)]), np.array([0])
    while len(pointer):
        start, part = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        key = keys[depth[part], pointer]
        three = np.stack([key[start], key[start + sizes // 2], key[start + sizes - 1]])
        pivot = np.sort(three, axis=0)[1][part]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        piece = part * 3 + side
        count = np.bincount(piece, minlength=3 * len(sizes))
        weight = np.bincount(piece, weights[pointer], minlength=3 * len(sizes)).astype(np.int64)
        begin, moved = np.cumsum(count) - count, np.empty_like(pointer)
        for s in range(3):
            own, n = np.flatnonzero(side == s), count[s::3]
            moved[np.repeat(begin[s::3] - (np.cumsum(n) - n), n) + np.arange(len(own))] = pointer[own]
        level = np.repeat(depth, 3)
        level[1::3] += 1
        held = (weight >= least) & (count > 0)
        equal = np.flatnonzero(held[1::3]) * 3 + 1
        for d in np.unique(level[equal]):
            at = equal[level[equal] == d]
            yield int(d), moved[begin[at]], weight[at]
        held &= level < len(keys)
        pointer = moved[np.repeat(held, count)]
        sizes, depth = count[held], level[held]


def _coded(suffixes: pa.Array, longest: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of suffixes, and the codes of each one's words from 1, 0 beyond its end (longest x n)."""
    data, at = _flat(suffixes)
    data, at = data[at[0] :], at - at[0]
    blank = data == 0x20
    ends = np.flatnonzero(blank)
    lengths = np.diff(ends, prepend=-1) - 1
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(data[~blank])]).dictionary_encode()
    code = np.append(words.indices.to_numpy(zero_copy_only=False) + 1, 0)
    first = np.searchsorted(ends, at)
    return words.dictionary, np.stack([np.where(first[:-1] + k < first[1:], code[np.minimum(first[:-1] + k, len(code) - 1)], 0) for k in range(longest)])


def _sorted_range(longest: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, size, n): the phrases of a range of suffixes that reach ``least``, and parts of those that may go on in
    another range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n, lang = table.column("n").to_numpy(), table.column("lang").combine_chunks().dictionary_encode()
        suffix = table.column("suffix").cast(pa.large_binary()).combine_chunks()
        words, codes = _coded(suffix, longest)
        keys = np.concatenate([lang.indices.to_numpy(zero_copy_only=False)[None], codes])
        bounds = pc.min_max(lang.dictionary)
        edges = []
        for end in ("min", "max"):  # the range's first and last suffix: what they begin with may go on in another range
            own = np.flatnonzero(keys[0] == pc.index(lang.dictionary, bounds[end]).as_py())
            some = suffix.take(pa.array(own))
            edges.append(own[pc.index(some, pc.min_max(some)[end]).as_py()])
        del table, held, suffix
        edges = keys[:, np.unique(edges)].T

        def rows(pointers: np.ndarray, size: int, weight: np.ndarray) -> pa.RecordBatch:
            taken = [words.take(pa.array(keys[k + 1][pointers] - 1)) for k in range(size)]
            phrase = pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.large_binary()))
            return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(keys[0][pointers])).cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(pointers), size, np.int32)), pa.array(weight)], names=["lang", "phrase", "size", "n"])

        for size in range(2, longest):
            for edge in np.unique(edges[:, : size + 1], axis=0):
                own = np.flatnonzero((keys[: size + 1] == edge[:, None]).all(axis=0))
                if edge[size]:
                    yield rows(own[:1], size, np.array([n[own].sum()]))
        for depth, pointers, weight in equal_partitions(keys, n, least):
            size = depth - 1
            if size < 2:
                continue
            whole = keys[size][pointers] > 0
            if size < longest:
                for edge in edges:
                    whole &= (keys[:depth, pointers] != edge[:depth, None]).any(axis=0)
            if whole.any():
                yield rows(pointers[whole], size, weight[whole])

    return run


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): how often each word occurs. A null language is ``und``, a null text empty."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    return rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _filter(words: DataFrame) -> bytes:
    """A bit for each frequent word, 2^26 bits whatever their number."""
    bit = F.crc32(F.col("word").cast("binary")).bitwiseAND((1 << _FILTER_BITS) - 1) + 1
    parts = words.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits = bytearray(1 << (_FILTER_BITS - 3))
    for b, part in parts.collect():
        bits[(b - 1) * len(part) : b * len(part)] = part
    return bytes(bits)


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = 10, longest: int = 3, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, size, n): phrases of 2 to ``longest`` words that occur ``least`` times within pieces. ``words`` are the
    counts of those that occur so often."""
    spark = docs.sparkSession
    bits = _filter(words)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    suffixes = written(rows.mapInArrow(_suffixes(bits, longest), "lang string, suffix string, n long"))
    ranges = max(shuffle_partitions(spark), suffixes.count() // _RANGE + 1)
    routed = suffixes.repartitionByRange(ranges, "lang", "suffix")
    found = routed.mapInArrow(_sorted_range(longest, least), "lang string, phrase string, size int, n long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mine(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, absorb: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """The collocations of each language: (lang, rank, phrase, a, l, r, n, score), the first ``top`` by score, a and phrase.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words at blanks and tabs; a is a
    phrase's count within pieces, n the words of its language. Of its cuts the one with the least floor(10^6 a^2 / (l r)) counts,
    the first of equal ones, where l and r count its two parts. A phrase goes if a longer one that has its words in a row holds
    ``absorb`` per cent of its count. Counts may reach 10^16: products are decimals of 38 digits.

    A null language is ``und``, a null text is empty, repeated rows count each time, an empty table gives no rows; other columns
    are not read.
    """
    counted = written(word_counts(docs, text, lang))
    words = counted.where(F.col("n") >= least)
    phrases = written(phrase_counts(docs, words, least, longest, text, lang))
    parts = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).union(phrases.select("lang", "phrase", "n"))

    inner = F.split("phrase", " ")
    sub = lambda first, size: F.array_join(F.slice(inner, first, size), " ")
    held_in = [
        phrases.where(F.col("size") == size).select("lang", F.explode(F.array(*(sub(F.lit(i + 1), F.lit(k)) for k in range(2, size) for i in range(size - k + 1)))).alias("phrase"), "n")
        for size in range(3, longest + 1)
    ]
    left = phrases
    if held_in:
        longer = held_in[0]
        for more in held_in[1:]:
            longer = longer.union(more)
        longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
        left = phrases.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < absorb * F.col("n"), F.lit(True))).drop("most")

    cuts = left.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", sub(F.lit(1), F.col("k")).alias("head"), sub(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
