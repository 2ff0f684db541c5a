"""Quality classifier: a byte-level convolutional network in numpy over the whole text.

Bytes are embedded; 8-byte filters at a stride of 4 run over the text; their activations are averaged over overlapping
chunks of 256 bytes (128 apart) that cover the document; a second layer of learned filters reads each chunk's profile; both
layers are max-pooled over the document and one logistic unit combines the maxima into a probability.

Training takes a bounded, documented sample of labelled rows (TRAIN_ROWS of each label, none longer than TRAIN_LONGEST bytes)
to the driver and reads their whole texts; scoring maps every row of the table, whole texts of any length, in Arrow batches with
the fitted weights, about 60 KB, in the task's closure, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_of

#: Labelled rows of each label that training may take, chosen by a hash of the id over the whole table.
TRAIN_ROWS = 1500
#: Labelled rows with longer texts, in bytes, are not in the sample; so it is bounded in bytes too.
TRAIN_LONGEST = 1 << 18
KEEP_FROM = 0.7
EMBED, FILTERS, UNITS = 6, 32, 24
HALF, STRIDE = 128, 4
STEPS = HALF // STRIDE
EPOCHS, BATCH = 14, 32
#: Bytes that a training step holds at once; gradients of a batch are summed over parts of this size.
_AT_ONCE = 1 << 18


class Weights(NamedTuple):
    embed: np.ndarray  # 256 x EMBED
    first: np.ndarray  # STRIDE * EMBED x FILTERS, the filter's first four bytes
    second: np.ndarray  # the same, its last four
    bias: np.ndarray  # FILTERS
    unit: np.ndarray  # FILTERS x UNITS
    unit_bias: np.ndarray
    out: np.ndarray  # FILTERS + UNITS
    out_bias: np.ndarray  # 1


def _start(rng: np.random.Generator) -> Weights:
    normal = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    wide = STRIDE * EMBED
    return Weights(normal(256, EMBED, by=0.5), normal(wide, FILTERS, by=0.2), normal(wide, FILTERS, by=0.2), np.zeros(FILTERS, np.float32), normal(FILTERS, UNITS, by=1.0), np.zeros(UNITS, np.float32), normal(FILTERS + UNITS, by=0.1), np.zeros(1, np.float32))


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, each padded with zero bytes to whole half-chunks (two at least), and their first half-chunks."""
    halves = np.array([max(2, -(-len(t) // HALF)) for t in texts])
    starts = np.concatenate([[0], np.cumsum(halves)])
    flat = np.zeros(int(starts[-1]) * HALF, np.uint8)
    for t, s in zip(texts, starts.tolist()):
        flat[s * HALF : s * HALF + len(t)] = np.frombuffer(t, np.uint8)
    return flat, starts


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


class _Pass(NamedTuple):
    blocks: np.ndarray
    active: np.ndarray
    chunks: np.ndarray
    units: np.ndarray
    tops: np.ndarray
    pooled: np.ndarray


def forward(w: Weights, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, _Pass]:
    """A logit for each text."""
    blocks = w.embed[flat].reshape(-1, STRIDE * EMBED)
    active = blocks @ w.first
    active[:-1] += blocks[1:] @ w.second
    border = starts[1:-1] * STEPS  # where a text ends, the filter's second half sees nothing of the next one
    active[border - 1] -= blocks[border] @ w.second
    active += w.bias
    np.maximum(active, 0, out=active)
    steps = active.reshape(-1, STEPS, FILTERS)
    mean, top = steps.sum(1), steps.max(1)
    # a chunk is a half and the next one; the last half of a text is also a chunk of its own
    chunks = mean / STEPS
    inner = np.ones(len(mean), bool)
    inner[starts[1:] - 1] = False
    at = np.flatnonzero(inner)
    chunks[at] = (mean[at] + mean[at + 1]) / (2 * STEPS)
    units = np.maximum(chunks @ w.unit + w.unit_bias, 0)
    pooled = np.concatenate([np.maximum.reduceat(top, starts[:-1], 0), np.maximum.reduceat(units, starts[:-1], 0)], 1)
    return pooled @ w.out + w.out_bias[0], _Pass(blocks, active, chunks, units, top, pooled)


def _argmax(values: np.ndarray, best: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first row of each segment that holds its maximum, by column."""
    owner = np.repeat(np.arange(len(best)), np.diff(starts))
    rows = np.where(values == best[owner], np.arange(len(values))[:, None], len(values))
    return np.minimum.reduceat(rows, starts[:-1], 0)


def gradient(w: Weights, flat: np.ndarray, starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Weights:
    """Of the weighted logistic loss."""
    logit, p = forward(w, flat, starts)
    error = ((probability(logit) - target) * weight / len(target)).astype(np.float32)
    back = error[:, None] * w.out[None, :]
    # the second layer
    best = _argmax(p.units, p.pooled[:, FILTERS:], starts)
    columns = np.broadcast_to(np.arange(UNITS), best.shape)
    d_units = np.zeros_like(p.units)
    d_units[best, columns] = back[:, FILTERS:]
    d_units *= p.units > 0
    d_chunks = d_units @ w.unit.T
    d_mean = d_chunks / STEPS
    inner = np.ones(len(d_mean), bool)
    inner[starts[1:] - 1] = False
    at = np.flatnonzero(inner)
    d_mean[at] /= 2
    d_mean[at + 1] += d_chunks[at] / (2 * STEPS)
    # the first layer
    d_active = np.repeat(d_mean, STEPS, 0)
    best = _argmax(p.tops, p.pooled[:, :FILTERS], starts)
    columns = np.broadcast_to(np.arange(FILTERS), best.shape)
    inside = p.active.reshape(-1, STEPS, FILTERS)[best, :, columns].argmax(-1)
    np.add.at(d_active, (best * STEPS + inside, columns), back[:, :FILTERS])
    d_active *= p.active > 0
    d_blocks = d_active @ w.first.T
    ahead = d_active[:-1].copy()
    ahead[starts[1:-1] * STEPS - 1] = 0
    d_blocks[1:] += ahead @ w.second.T
    each = d_blocks.reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(flat, weights=each[:, k], minlength=256) for k in range(EMBED)], 1)
    return Weights(d_embed, p.blocks.T @ d_active, p.blocks[1:].T @ ahead, d_active.sum(0), p.chunks.T @ d_units, d_units.sum(0), p.pooled.T @ error, error.sum(keepdims=True))


def _batch_gradient(w: Weights, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> Weights:
    """The gradient over a batch, part by part."""
    ends = np.cumsum([max(2 * HALF, len(t)) for t in texts])
    part = (ends - 1) // _AT_ONCE
    total: list[np.ndarray] = []
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        own = gradient(w, *laid_out([texts[i] for i in at]), labels[at], weights[at])
        own = [g * (len(at) / len(texts)) for g in own]
        total = [a + b for a, b in zip(total, own)] if total else own
    return Weights(*total)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Weights:
    """Adam on balanced minibatches; the last step moves the bias so that KEEP_FROM is the best border on the sample."""
    rng = np.random.default_rng(seed)
    w = _start(rng)
    if len(texts) == 0 or len(np.unique(labels)) < 2:
        return w._replace(out=np.zeros_like(w.out), out_bias=np.array([4.0 if len(labels) == 0 or labels[0] else -4.0], np.float32))
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    m, v, t = [np.zeros(x.shape) for x in w], [np.zeros(x.shape) for x in w], 0
    total = EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            own = order[first : first + BATCH]
            grad = _batch_gradient(w, [texts[i] for i in own], labels[own], weights[own])
            t += 1
            rate = 0.01 * (1 - t / total) + 1e-4
            new = []
            for k, (x, g) in enumerate(zip(w, grad)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * np.square(g)
                step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                new.append((x - step - rate * 1e-3 * x).astype(np.float32))
            w = Weights(*new)
    logits = logits_of(w, texts)
    order = np.sort(logits)
    borders = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    good, bad = np.sort(logits[labels == 1]), np.sort(logits[labels == 0])
    right = (1 - np.searchsorted(good, borders) / len(good)) + np.searchsorted(bad, borders) / len(bad)
    best = borders[right >= right.max() - 1e-9].mean()
    return w._replace(out_bias=(w.out_bias + np.log(KEEP_FROM / (1 - KEEP_FROM)) - best).astype(np.float32))


def logits_of(w: Weights, texts: list[bytes], at_once: int = 1 << 19) -> np.ndarray:
    """Logits of whole texts, some at a time; a long text is taken in pieces that overlap, which changes nothing."""
    out = np.empty(len(texts))
    done = 0
    while done < len(texts):
        end, size = done, 0
        while end < len(texts) and (end == done or size + len(texts[end]) <= at_once):
            size += len(texts[end])
            end += 1
        if size <= 2 * at_once:
            out[done:end] = forward(w, *laid_out(texts[done:end]))[0]
        else:
            (long,) = texts[done:end]
            step = at_once // HALF
            pooled = []
            for first in range(0, -(-len(long) // HALF), step):
                # two half-chunks more, so that those before them see all that follows; the last piece takes them too
                p = forward(w, *laid_out([long[first * HALF : (first + step + 2) * HALF]]))[1]
                ends = len(long) <= (first + step + 2) * HALF
                own = len(p.tops) if ends else step
                pooled.append(np.concatenate([p.tops[:own].max(0), p.units[:own].max(0)]))
                if ends:
                    break
            out[done:end] = np.max(pooled, 0) @ w.out + w.out_bias[0]
        done = end
    return out


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, rows: int = TRAIN_ROWS) -> Weights:
    """Fits on at most ``rows`` rows of each quality label, those with the least hashes of their ids.

    Rows with a null text, id or label, and those of the fold ``held_out`` (of 4; None: no fold) are not learned from. An id
    with both labels has the low one; of repeated ids the texts with the least hashes come first. Only the text is an input.
    """
    # texts meet ids with no other column beside them, so none clashes
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").groupBy("_id").agg(F.min("quality").alias("quality"))
    if held_out is not None:
        known = known.where(fold(F.col("_id"), 4) != held_out)
    texts, y = [], []
    for label in (0, 1):
        # a hash that has no part in the fold; twice as many ids as rows, in case some have no document
        ids = known.where(F.col("quality") == label).orderBy(F.xxhash64("_id"), "_id").limit(2 * rows).select("_id")
        readable = docs.where(F.octet_length("text") <= TRAIN_LONGEST)
        found = readable.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("_id"), "_id", F.xxhash64("text")).limit(rows).select("text")
        own = [r["text"].encode("utf-8", "surrogatepass") for r in found.toLocalIterator()]
        texts += own
        y += [label] * len(own)
    return fit(texts, np.array(y, np.int64))


def score(docs: DataFrame, w: Weights, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row: the probability, 0 to 1, that its quality is 1; a null text counts as empty.

    Rows are scored each for itself; ids may be null or repeated. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            order = np.argsort([len(t) for t in texts], kind="stable")
            logits = np.empty(len(texts))
            logits[order] = logits_of(w, [texts[i] for i in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(logits))], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, w: Weights, text: str = "text", at_least: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that score at least ``at_least``; all columns stay as they are."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(where).to_pylist()]
            logits = logits_of(w, [t.encode("utf-8", "surrogatepass") for t in texts])
            yield batch.filter(pa.array(probability(logits) >= at_least))

    return docs.mapInArrow(run, docs.schema)
