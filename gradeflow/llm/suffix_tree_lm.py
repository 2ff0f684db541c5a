"""Language-model scoring by a probabilistic suffix tree over bytes, beside a unigram base score over words.

A document is the byte stream of its lower-cased words joined by spaces, then an end symbol. Spark counts every context of
up to DEPTH bytes with its next byte over the whole training part; tasks combine equal n-grams before they are shuffled, as
lists by parts of their hashes. A
context stays in the tree if it occurs twice or more and its next-byte distribution diverges from that of its suffix: n times
the Kullback-Leibler divergence, which is what the context saves, is at least d * (ln(N) / 2 + ln(A)), the cost of naming its d
next bytes, of A in use, and their shares, for N positions. No share of the corpus is asked for, so the tree grows with the corpus
and stays a Spark table.

A state's distribution is smoothed by its suffix's (Witten-Bell), the root's by adding one. The contexts above a count that
at most HEAD_CONTEXTS contexts reach are broadcast. Scoring walks their automaton: its states are the beginnings of
contexts, each knows the longest context that ends there. A state depends on the last DEPTH bytes alone, so a batch is cut
into segments that overlap by DEPTH bytes and all segments take their steps together in numpy. A suffix occurs at least as
often as its context, so rarer contexts only refine what the head gives: positions where a filter of fixed size says that
there may be one are joined by their bytes with the rest of the tree.

Word counts of the base score are grouped by Spark. Words above a count that at most HEAD_WORDS words reach are looked up
from a broadcast; all others are joined by word.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, shuffle_partitions, text_of, written

DEPTH = 6
HEAD_CONTEXTS = 80_000
HEAD_WORDS = 100_000
#: The filter of rarer contexts has 2 to this power bits, 8 MB. Before it, one of 2 to the 21 bytes, by a hash of the last three
#: bytes, says how long the rarer contexts are that end so.
FILTER_BITS = 26
_LAST = 24
_ENDINGS = 21
END = 10
_END_WORD = b"\n"
_STREAM = 1 << 21
_SEGMENT = 256
#: What a counting task holds before it emits: different n-grams, different words.
HELD_GRAMS, HELD_WORDS = 2_000_000, 200_000
#: Parts into which counts are dealt for each shuffle partition, so that a part is as large for any corpus.
_DEALT = 16


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than ASCII white space, then the end."""
    return [*text.lower().split(), _END_WORD]


def stream_of(docs: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' bytes, each behind ``depth`` end symbols and before one, with the begin and end of what is predicted."""
    pad = bytes([END]) * depth
    parts = [pad + b" ".join(words[:-1]) + _END_WORD for words in docs]
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts] + depth, ends


def _grams(stream: np.ndarray, begins: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The last depth + 1 bytes at each position that is predicted, as a number, and which positions behind the first pad are."""
    # the eight bytes that end at each position, as one number
    padded = np.concatenate([np.zeros(8, np.uint8), stream])
    code = np.ndarray(len(stream) - depth, ">u8", padded, depth + 1, (1,)).astype(np.uint64) & np.uint64((1 << 8 * (depth + 1)) - 1)
    edge = np.zeros(len(code) + 1, np.int8)
    np.add.at(edge, begins - depth, 1)
    np.add.at(edge, ends - depth, -1)
    predicted = np.cumsum(edge[:-1], dtype=np.int8) > 0
    return code[predicted], predicted


def _words(stream: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a stream of documents without the end words, and how many each document has."""
    cuts = np.flatnonzero((stream == 32) | (stream == END)) + 1
    firsts = np.concatenate([[0], cuts[:-1]])
    real = cuts - firsts > 1
    if not real.any():
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    # two offsets for each word: its first byte and the separator behind it, which every other entry holds
    bounds = np.stack([firsts[real], cuts[real] - 1], 1).ravel().astype(np.int32)
    both = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(stream)])
    number = np.concatenate([[0], np.cumsum(real)])
    place = np.searchsorted(cuts, np.stack([begins, ends]), side="right")
    return both.take(pa.array(np.arange(0, len(both), 2))), number[place[1]] - number[place[0]]


def _grouped(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, word lists) of consecutive rows with about _STREAM bytes."""
    first, size, held = 0, 0, []
    for row, value in enumerate(batch.column(column)):
        text = value.as_buffer().to_pybytes()
        held.append(words_of(text))
        size += len(text)
        if size >= _STREAM:
            yield first, held
            first, size, held = row + 1, 0, []
    if held:
        yield first, held


def _merged(held: tuple[np.ndarray, np.ndarray] | None, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their counts, after those of another sorted list are added."""
    if held is None:
        return codes, n
    at = np.searchsorted(held[0], codes)
    known = held[0][np.minimum(at, len(held[0]) - 1)] == codes
    held[1][at[known]] += n[known]
    new = ~known
    return np.insert(held[0], at[new], codes[new]), np.insert(held[1], at[new], n[new])


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(word, null, n) and (null, gram, n): counts that a task combines as far as its memory is bounded."""
    _models.clear()  # of an earlier run in this worker
    words: Counter[bytes] = Counter()
    held: tuple[np.ndarray, np.ndarray] | None = None
    names = ["word", "gram", "n"]

    def word_rows() -> pa.RecordBatch:
        keys, n = pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())
        words.clear()
        return pa.RecordBatch.from_arrays([keys, pa.nulls(len(keys), pa.int64()), n], names=names)

    def gram_rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.binary()), pa.array(codes.astype(np.int64)), pa.array(n)], names=names)

    for batch in batches:
        for _, docs in _grouped(batch, 0):
            for d in docs:
                words.update(d)
            codes, n = np.unique(_grams(*stream_of(docs, depth), depth)[0], return_counts=True)
            held = _merged(held, codes, n.astype(np.int64))
            if len(held[0]) > HELD_GRAMS:
                yield gram_rows(*held)
                held = None
            if len(words) > HELD_WORDS:
                yield word_rows()
    if held is not None:
        yield gram_rows(*held)
    if words:
        yield word_rows()


def _dealt(counts: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, words, grams, n): the counts as lists, each in the part that its word or n-gram has by its hash."""
    for batch in counts:
        words, grams, n = batch.columns
        if grams.null_count:
            part = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.uint64, len(words)) % np.uint64(parts)
        else:
            with np.errstate(over="ignore"):
                part = (grams.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        own, ends = np.unique(part[order], return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32))
        listed = [pa.nulls(len(own), pa.list_(c.type)) if c.null_count else pa.ListArray.from_arrays(offsets, c.take(pa.array(order))) for c in (words, grams, n)]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *listed], names=["part", "words", "grams", "n"])


def _summed(part: pa.Table) -> pa.Table:
    """(word, null, n) and (null, gram, n) of a part, each word and n-gram once."""
    out = []
    for kind, name in (("words", "word"), ("grams", "gram")):
        rows = part.filter(part[kind].is_valid())
        flat = pa.table({name: rows[kind].combine_chunks().flatten(), "n": rows["n"].combine_chunks().flatten()})
        total = flat.group_by(name, use_threads=False).aggregate([("n", "sum")])
        columns = {"word": pa.nulls(len(total), pa.binary()), "gram": pa.nulls(len(total), pa.int64()), "n": total["n_sum"]}
        out.append(pa.table(columns | {name: total[name]}))
    return pa.concat_tables(out)


class Tree(NamedTuple):
    symbols: np.ndarray  # 256: the class of each byte, the last class for bytes that training never met
    steps: np.ndarray  # states x classes: the state after a symbol, and the log10 that the state gives it
    log10: np.ndarray  # contexts x classes


def contexts(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(length, context, next, n, total) of the retained contexts and of the root; grams are (gram, n) of depth + 1 bytes, summed."""
    total, alphabet = grams.agg(F.sum("n"), F.count_distinct(F.col("gram").bitwiseAND(255))).first()
    total = total or 0
    of_context = Window.partitionBy("context")
    whole = lambda df: written(df.withColumn("total", F.sum("n").over(of_context)).withColumn("kinds", F.count("*").over(of_context)))
    level = whole(grams.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).cast("int").alias("next"), "n"))
    levels = [level]
    for length in range(depth - 1, -1, -1):
        level = whole(level.groupBy(F.col("context").bitwiseAND((1 << 8 * length) - 1).alias("context"), "next").agg(F.sum("n").alias("n")))
        levels.append(level)
    levels.reverse()
    out = levels[0].select(F.lit(0).alias("length"), "context", "next", "n", "total")
    for length in range(1, depth + 1):
        rows = levels[length].where(F.col("total") >= 2).withColumn("parent", F.col("context").bitwiseAND((1 << 8 * (length - 1)) - 1))
        parents = levels[length - 1].select(F.col("context").alias("parent"), "next", F.col("n").alias("parent_n"), F.col("total").alias("parent_total"))
        # shuffled at any size: both sides grow with the corpus
        both = rows.join(parents.hint("merge"), ["parent", "next"])
        gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("parent_n") / F.col("parent_total"))))
        stay = both.groupBy("context", "total", "kinds").agg(gain.alias("gain"), F.collect_list(F.struct("next", "n")).alias("following")).where(F.col("gain") >= F.col("kinds") * float(np.log(max(2, total)) / 2 + np.log(max(1, alphabet))))
        # each level is a plan of its own, so the driver never holds one over all of them
        out = out.union(written(stay.select(F.lit(length).alias("length"), "context", F.inline("following"), "total").select("length", "context", "next", "n", "total")))
    return out


def build_tree(length: np.ndarray, context: np.ndarray, following: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> Tree:
    """The automaton of the retained contexts; rows of the root have length 0."""
    seen = np.union1d(following[n > 0], [END])
    symbols = np.full(256, len(seen), np.int64)
    symbols[seen] = np.arange(len(seen))
    width = len(seen) + 1
    context = context.astype(np.uint64)
    # states: all beginnings of contexts, by length; at: the number of the first one of each length
    begins = [np.unique(np.concatenate([context[length == k] >> np.uint64(8 * (k - size)) for k in range(size, depth + 1)])) for size in range(depth + 1)]
    begins[0] = np.zeros(1, np.uint64)
    at = np.cumsum([0, *map(len, begins)])
    own = [np.unique(context[length == size]) for size in range(depth + 1)]
    own[0] = begins[0]
    row = np.cumsum([0, *map(len, own)])
    step = np.zeros((at[-1], width), np.int32)
    fail, longest = np.zeros(at[-1], np.int64), np.zeros(at[-1], np.int32)
    chance = np.zeros((row[-1], width))
    for size in range(depth + 1):
        states = np.arange(at[size], at[size + 1])
        rows = length == size
        place = np.searchsorted(own[size], context[rows])
        counts = np.zeros((len(own[size]), width))
        np.add.at(counts, (place, symbols[following[rows]]), n[rows])
        if size:
            parent = at[size - 1] + np.searchsorted(begins[size - 1], begins[size] >> np.uint64(8))
            last = symbols[(begins[size] & np.uint64(255)).astype(np.int64)]
            if size > 1:
                fail[states] = step[fail[parent], last]
            step[parent, last] = states
            longest[states] = longest[fail[states]]
            held = at[size] + np.searchsorted(begins[size], own[size])
            kinds = (counts > 0).sum(1, keepdims=True)
            chance[row[size] : row[size + 1]] = (counts + kinds * chance[longest[fail[held]]]) / (counts.sum(1, keepdims=True) + kinds)
            longest[held] = np.arange(row[size], row[size + 1])
        else:
            chance[0] = (counts[0] + 1) / (counts.sum() + 256)
        # until a longer state is met, a symbol leads where it leads from the longest suffix
        if size > 0:
            step[states] = step[fail[states]]
    log10 = np.log10(chance).astype(np.float32)
    steps = np.empty(step.shape, [("state", np.int32), ("log10", np.float32)])
    steps["state"], steps["log10"] = step, log10[longest]
    return Tree(symbols, steps, log10)


def score_stream(tree: Tree, stream: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each byte after those before it; the first bytes of the stream are its document's pad."""
    width = tree.log10.shape[1]
    classes = tree.symbols[stream].astype(np.int32)
    rows = -(-len(classes) // _SEGMENT)
    padded = np.full(depth + rows * _SEGMENT, tree.symbols[END], np.int32)
    padded[depth : depth + len(classes)] = classes
    table = np.lib.stride_tricks.as_strided(padded, (_SEGMENT + depth, rows), (padded.strides[0], padded.strides[0] * _SEGMENT))
    out = np.empty((_SEGMENT, rows), np.float32)
    # the next state and the chance of a symbol lie side by side, so a step is one look-up
    steps, met = tree.steps.ravel().view(np.int64), np.empty(rows, np.int64)
    state, chance = met.view(np.int32)[::2], met.view(np.float32)[1::2]
    met[:] = 0
    place = np.empty(rows, np.int64)
    for t in range(_SEGMENT + depth):
        np.multiply(state, width, out=place)
        place += table[t]
        np.take(steps, place, out=met, mode="clip")
        if t >= depth:
            out[t - depth] = chance
    return out.T.ravel()[: len(classes)]


def document_scores(tree: Tree, docs: list[list[bytes]], depth: int = DEPTH) -> np.ndarray:
    return stream_scores(tree, *stream_of(docs, depth), depth)


def stream_scores(tree: Tree, stream: np.ndarray, begins: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of each document of a stream."""
    each = np.concatenate([score_stream(tree, stream, depth).astype(np.float64), [0.0]])
    return np.add.reduceat(each, np.stack([begins, ends], 1).ravel())[::2]


def _slots(length: np.ndarray | int, context: np.ndarray) -> np.ndarray:
    """The bit of the filter that stands for a context."""
    with np.errstate(over="ignore"):
        key = (context.astype(np.uint64) | (np.asarray(length).astype(np.uint64) << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _endings(length: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The bits of the filter of endings: those of each context's last three bytes and length; for a shorter one, those of all
    bytes that may precede it."""
    long = length >= 3
    out = [_ending_slots(context[long]) << 3 | length[long]]
    for size in (1, 2):
        for c in np.unique(context[length == size]).tolist():
            out.append(_ending_slots((np.arange(1 << _LAST - 8 * size) << 8 * size) | c) << 3 | size)
    return np.unique(np.concatenate(out))


def _ending_slots(ends: np.ndarray) -> np.ndarray:
    """The byte of the filter of endings for the last three bytes of each number."""
    with np.errstate(over="ignore"):
        return ((ends.astype(np.uint32) & np.uint32((1 << _LAST) - 1)) * np.uint32(0x9E3779B1) >> np.uint32(32 - _ENDINGS)).astype(np.int64)


def _filter(rare: DataFrame) -> np.ndarray:
    """A bit for each slot that a context of ``rare`` has, then a byte of lengths for each ending; empty if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, context = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            slots = np.concatenate([_slots(length, context), (1 << FILTER_BITS) + _endings(length, context)])
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.int64(1) << (slots & 63))], names=["word", "bits"])

    words = rare.select("length", "context").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not words.num_rows:
        return np.zeros(0, np.uint8)
    out = np.zeros((1 << FILTER_BITS - 6) + (1 << _ENDINGS - 3), "<i8")
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _may_be(bits: np.ndarray, length: int, grams: np.ndarray) -> np.ndarray:
    """Whether the last ``length`` bytes before the end of each gram may be a rarer context."""
    slots = _slots(length, (grams >> np.uint64(8)) & np.uint64((1 << 8 * length) - 1))
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def rarer_grams(bits: np.ndarray, stream: np.ndarray, begins: np.ndarray, ends: np.ndarray, depth: int = DEPTH) -> pa.Array:
    """For each document the grams of its positions that may have a rarer context."""
    if not len(bits):
        return pa.array([[]] * len(ends), pa.list_(pa.int64()))
    grams, predicted = _grams(stream, begins, ends, depth)
    lengths = bits[1 << FILTER_BITS - 3 :][_ending_slots(grams >> np.uint64(8))]
    some = np.flatnonzero(lengths)
    lengths, own = lengths[some], grams[some]
    found = np.zeros(len(own), bool)
    for length in range(1, depth + 1):
        left = np.flatnonzero((lengths >> length & 1 > 0) & ~found)
        found[left] = _may_be(bits, length, own[left])
    hit = np.zeros(len(grams), bool)
    hit[some[found]] = True
    at = np.flatnonzero(predicted)[hit] + depth
    offsets = np.concatenate([[0], np.searchsorted(at, ends)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[hit].astype(np.int64)))


def gram_scores(tree: Tree, grams: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability that the tree gives the last byte of each gram after the bytes before it."""
    symbol = lambda k: tree.symbols[((grams >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)]
    state = np.zeros(len(grams), np.int32)
    for k in range(depth, 0, -1):
        state = tree.steps["state"][state, symbol(k)]
    return tree.steps["log10"][state, symbol(0)].astype(np.float64)


def word_gains(frequent: pa.Array, gains: np.ndarray, stream: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each document of a stream how many of its words, the end among them, are frequent, their gains' sum, and the others."""
    words, sizes = _words(stream, begins, ends)
    at = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy()
    last = np.cumsum(sizes)
    summed = lambda each: np.where(sizes > 0, np.add.reduceat(np.append(each, 0), np.stack([last - sizes, last], 1).ravel())[::2], 0)
    known, gain = summed((at >= 0).astype(np.int64)), summed(np.append(gains, 0.0)[at])
    others, place = words.filter(pa.array(at < 0)), np.cumsum(sizes - known)
    end = pc.index(frequent, pa.scalar(_END_WORD, pa.binary())).as_py()
    if end >= 0:
        known, gain = known + 1, gain + gains[end]
    else:
        # the end is one of the others of each document
        others = pa.concat_arrays([others, pa.array([_END_WORD], pa.binary())]).take(pa.array(np.insert(np.arange(len(others)), place, len(others))))
        place = place + np.arange(1, len(place) + 1)
    return known, gain, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], place]).astype(np.int32)), others)


def _least(counts: DataFrame, most: int) -> int | None:
    """The least n that at most ``most`` rows reach, by bins; None if there is none."""
    # counts are binned by powers of 2^(1/8): at most 504 bins reach the driver
    bins = counts.groupBy(F.floor(8 * F.log2("n")).alias("bin")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("bin")).collect()
    least, held = None, 0
    for b in bins:
        held += b["rows"]
        if held > most:
            break
        least = b["n"]
    return least


def _reach(column: str, least: int | None) -> Column:
    return F.lit(False) if least is None else F.col(column) >= least


_models: dict[str, tuple[Tree, pa.Array, np.ndarray]] = {}


def _model(key: str, tables: tuple[pa.Table, pa.Table], depth: int) -> tuple[Tree, pa.Array, np.ndarray]:
    """The automaton, and the frequent words with their gains, built once in a worker from their tables."""
    if key not in _models:
        kept, head = tables
        _models.clear()
        tree = build_tree(*(kept[c].to_numpy() for c in ("length", "context", "next", "n")), depth)
        _models[key] = tree, head["word"].combine_chunks(), np.log10(head["n"].to_numpy() + 1.0)
    return _models[key]


def score_documents(docs: DataFrame, is_training: Column | None = None, depth: int = DEPTH, head_contexts: int = HEAD_CONTEXTS, head_words: int = HEAD_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    The model learns from the rows where ``is_training`` (an expression over doc_id; by default all rows with an id). A
    null text is empty: one token, the end. Rows with equal or null ids are scored each for itself. Without training rows
    train_tokens is 0, the base gives every token probability 1 and the model every byte 1/256. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    learned = rows.where(F.col("doc_id").isNotNull() if is_training is None else is_training).select("text")
    parts = min(1 << 16, _DEALT * shuffle_partitions(spark))
    # equal n-grams meet as lists, not row by row
    dealt = learned.mapInArrow(lambda b: _dealt(_count(b, depth), parts), "part int, words array<binary>, grams array<long>, n array<long>")
    counted = written(dealt.groupBy("part").applyInArrow(_summed, "word binary, gram long, n long"))
    counts, grams = counted.where("word IS NOT NULL").select("word", "n"), counted.where("gram IS NOT NULL").select("gram", "n")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    kept = contexts(grams, depth)
    often = (F.col("length") == 0) | _reach("total", _least(kept.groupBy("length", "context").agg(F.max("total").alias("n")), head_contexts))
    rarer = written(kept.where(~often).groupBy("length", "context").agg(F.max("total").alias("total"), F.count("*").alias("kinds"), F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("following")))
    # bounded tables go through the driver as they are; workers build the model from them
    head = kept.where(often).select("length", "context", "next", "n").toArrow(), counts.where(_reach("n", _least(counts, head_words))).toArrow()
    shared, bits = spark.sparkContext.broadcast(head), spark.sparkContext.broadcast(_filter(rarer))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, frequent, gains = _model(key, shared.value, depth)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, group in _grouped(batch, 1):
                stream = stream_of(group, depth)
                known, gain, rare = word_gains(frequent, gains, *stream)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + len(group)), pa.int64()),
                        batch.column(0).slice(first, len(group)),
                        pa.array([len(w) for w in group], pa.int64()),
                        pa.array(known),
                        pa.array(gain),
                        pa.array(stream_scores(tree, *stream, depth)),
                        rare,
                        rarer_grams(bits.value, *stream, depth),
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "gain", "score", "rare", "grams"],
                )
                row += len(group)

    def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _, _ = _model(key, shared.value, depth)
        for batch in batches:
            grams = batch.column(0).to_numpy().astype(np.uint64)
            scores = gram_scores(tree, grams, depth)
            for length in range(1, depth + 1):
                hit = _may_be(bits.value, length, grams)
                own = (grams[hit] >> np.uint64(8)) & np.uint64((1 << 8 * length) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(grams[hit].astype(np.int64)), pa.array(scores[hit]), pa.array(np.full(len(own), length, np.int32)), pa.array(own.astype(np.int64))], names=["gram", "head", "length", "context"])

    scored = written(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, gain double, score double, rare array<binary>, grams array<long>"))
    places = scored.select("row", F.explode("grams").alias("gram"))
    met = places.select("gram").distinct().mapInArrow(by_length, "gram long, head double, length int, context long").join(rarer.hint("merge"), ["length", "context"])
    step = F.struct("length", F.coalesce(F.try_element_at("following", F.col("gram").bitwiseAND(255).cast("int")), F.lit(0)).alias("n"), "total", "kinds")
    chance = F.aggregate("steps", F.pow(F.lit(10.0), "head"), lambda p, s: (s["n"] + s["kinds"] * p) / (s["total"] + s["kinds"]))
    gains = written(met.groupBy("gram").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(step)).alias("steps")).select("gram", (F.log10(chance) - F.col("head")).alias("more")))
    shared.destroy()
    bits.destroy()
    deep = places.join(gains.hint("merge"), "gram").groupBy("row").agg(F.sum("more").alias("more"))
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_gain"))
    return scored.drop("rare", "grams").join(rare, "row", "left").join(deep, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("rare_gain", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
