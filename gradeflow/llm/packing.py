"""Order-preserving packing of token streams into fixed windows by dynamic programming.

The documents of a partition form one stream in input order. Cuts fall at ends of documents and of sentences; a sentence that is
longer than a window may also be cut within, at every 16th token. The best cuts minimise, over all windows of at most ``size``
tokens, padding plus the penalty of the cut at the window's end plus a fixed price of a window:

    best[j] = penalty[j] + price + min over i of best[i] + pad(position[j] - position[i])

pad(L) is size - L, or 0 if L is a power of two. The first form is a minimum of best[i] + position[i] over a sliding range,
kept in a monotone queue, so a candidate costs amortised constant time; lengths of a power of two are a second, exact lookup.

Each Spark partition packs its own stream and nothing is shuffled. A stream is read block by block: a cut is made final when the
best ways to all places where a later window may begin go through it, so the cuts are those of the whole stream at once. The last
window of a stream, if it would need much padding, is split at powers of two.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

END = 1
SENTENCE_PENALTY, INNER_PENALTY, WINDOW_PRICE, INNER_EVERY = 2, 8, 64, 16
#: Longer texts are encoded piece by piece; this bounds a list of ids and changes none.
PIECE = 1 << 20
BLOCK_TOKENS = 1 << 18
_SPACES = re.compile(r"\s\s")
#: A single space between two other characters begins a token, so encoding may start anew there.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[tuple[str, bool], tuple[Callable[[str], list[int]], np.ndarray]] = {}


def _path(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encoder(vocabulary: str = "byte_bpe_50k", added_tokens: bool = False) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """A function from text to ids, and for each id whether it ends a sentence.

    vocabulary: the path, or the name in public_tokenizers, of a byte-level BPE without its ending; both its .tiktoken and
    its .json file are read. The rank form of the vocabulary gives the same ids as the json form and is several times
    faster; where two white-space characters never meet, its pattern needs no look-ahead, which is faster still. The json form
    takes over for texts that the rank form refuses. added_tokens: strings of the json file's added tokens get their own ids,
    as by its default setting; such texts are read by the json form. Without it they are ordinary text.
    """
    if (vocabulary, added_tokens) not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        with open(_path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        full = tiktoken.Encoding("full", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})

        with open(_path(f"{vocabulary}.json"), encoding="utf-8") as file:
            added = [t["content"] for t in json.load(file).get("added_tokens", [])] if added_tokens else []
        slow: list = []

        def by_json(text: str) -> list[int]:
            from tokenizers import Tokenizer

            if not slow:
                slow.append(Tokenizer.from_file(_path(f"{vocabulary}.json")))
                slow[0].encode_special_tokens = not added_tokens
            return slow[0].encode(text, add_special_tokens=False).ids

        def encode(text: str) -> list[int]:
            if any(t in text for t in added):
                return by_json(text)
            try:
                return (full if _SPACES.search(text) else plain).encode_ordinary(text)
            except BaseException as e:  # the library's panics are no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
                return by_json(text)

        ends = np.zeros(max(ranks.values()) + 1, bool)
        ends[[i for b, i in ranks.items() if b.endswith((b".", b"!", b"?", b"\n"))]] = True
        _encoders[vocabulary, added_tokens] = encode, ends
    return _encoders[vocabulary, added_tokens]


def padding(lengths: np.ndarray, size: int) -> np.ndarray:
    return np.where(lengths & (lengths - 1) == 0, 0, size - lengths)


def encoded(encode: Callable[[str], list[int]], text: str, piece: int = PIECE) -> np.ndarray:
    """The ids of a text and END."""
    parts, at = [], 0
    while len(text) - at > piece and (more := _BREAK.search(text, at + piece)):
        parts.append(np.array(encode(text[at : more.start()]), np.uint32))
        at = more.start()
    return np.concatenate([*parts, np.array([*encode(text[at:]), END], np.uint32)])


def candidates(bounds: np.ndarray, sentence_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may fall, and its penalty. bounds: the documents' ends; sentence_ends: other good places."""
    natural = np.union1d(bounds, sentence_ends)
    before = np.concatenate([[0], natural[:-1]])
    inner = [np.arange(a + INNER_EVERY, b, INNER_EVERY) for a, b in zip(before, natural) if b - a > size]
    at = np.union1d(natural, np.concatenate(inner)) if inner else natural
    penalty = np.full(len(at), INNER_PENALTY)
    penalty[np.searchsorted(at, sentence_ends)] = SENTENCE_PENALTY
    penalty[np.searchsorted(at, bounds)] = 0
    return at, penalty


class Cuts:
    """The best cuts of a stream whose places come in order; gaps between places are at most size."""

    def __init__(self, size: int):
        self.size, self.powers = size, [1 << k for k in range(size.bit_length())]
        self.where, self.best, self.parent = [0], [0], [0]
        self.keys = [0]  # best[i] + where[i]
        self.number = {0: 0}
        self.queue: deque[int] = deque([0])

    def extend(self, at: list[int], penalty: list[int]) -> None:
        size, powers, where, best, keys, number, queue = self.size, self.powers, self.where, self.best, self.keys, self.number, self.queue
        for here, price in zip(at, penalty):
            while where[queue[0]] < here - size:
                queue.popleft()
            i = queue[0]
            cost = keys[i] + size - here
            for k in powers:
                if (x := number.get(here - k)) is not None and best[x] < cost:
                    cost, i = best[x], x
            cost += price + WINDOW_PRICE
            j = number[here] = len(where)
            where.append(here)
            best.append(cost)
            self.parent.append(i)
            keys.append(cost + here)
            while queue and keys[queue[-1]] >= cost + here:
                queue.pop()
            queue.append(j)

    def path(self, j: int) -> list[int]:
        """Positions of the best cuts up to place j."""
        out = []
        while j:
            out.append(self.where[j])
            j = self.parent[j]
        return out[::-1]

    def settled(self) -> list[int]:
        """The cuts that no later place can change; what is kept then begins at the last of them, as position 0."""
        live = [-j for j in range(bisect_right(self.where, self.where[-1] - self.size), len(self.where))]
        heapify(live)
        while len(live) > 1:
            j = -heappop(live)
            if -self.parent[j] not in live:
                heappush(live, -self.parent[j])
        first = -live[0]
        out = self.path(first)
        if first:
            begin, base = self.where[first], self.best[first]
            self.queue = deque(i - first for i in self.queue if i >= first)
            self.where = [x - begin for x in self.where[first:]]
            self.best = [x - base for x in self.best[first:]]
            self.keys = [a + b for a, b in zip(self.best, self.where)]
            self.parent = [max(0, x - first) for x in self.parent[first:]]
            self.number = {x: i for i, x in enumerate(self.where)}
        return out


def cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Positions of the best cuts; at is ascending, its gaps are at most size, and its last position is always cut."""
    out = Cuts(size)
    out.extend(at.tolist(), penalty.tolist())
    return out.path(len(out.where) - 1)


def _tail(start: int, end: int, size: int) -> list[int]:
    """Cuts of a last window: at powers of two, largest first, where that costs less than its padding."""
    out, length = [], end - start
    if int(padding(np.array([length]), size)[0]) <= (length.bit_count() - 1) * (INNER_PENALTY + WINDOW_PRICE):
        return [end]
    while length:
        step = min(size, 1 << (length.bit_length() - 1))
        start, length = start + step, length - step
        out.append(start)
    return out


class Packer:
    """Takes (doc_id, ids) in order and yields pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""

    def __init__(self, size: int, ends: np.ndarray, first_sequence: int):
        self.size, self.ends, self.sequence = size, ends, first_sequence
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []  # id, ids not yet placed, ids before them, all ids
        self.cuts = Cuts(size)
        self.seen = 0  # documents whose places the cuts know
        self.fresh = 0  # ids of the others

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.fresh += len(ids)
        if self.fresh >= BLOCK_TOKENS:
            self._read()
            yield from self._place(self.cuts.settled())

    def _read(self) -> None:
        new = [d[1] for d in self.docs[self.seen :]]
        self.seen, self.fresh = len(self.docs), 0
        if new:
            ids, bounds = np.concatenate(new), np.cumsum([len(x) for x in new])
            closing = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            at, penalty = candidates(bounds, closing[closing < bounds[-1]], self.size)
            self.cuts.extend((at + self.cuts.where[-1]).tolist(), penalty.tolist())

    def flush(self) -> Iterator[tuple]:
        self._read()
        windows = self.cuts.path(len(self.cuts.where) - 1)
        if windows:
            start = windows[-2] if len(windows) > 1 else 0
            yield from self._place([*windows[:-1], *_tail(start, windows[-1], self.size)])

    def _place(self, windows: list[int]) -> Iterator[tuple]:
        """The pieces before the last of the windows' ends; what is behind it stays."""
        if not windows:
            return
        lengths = np.cumsum([len(d[1]) for d in self.docs])
        done = windows[-1]
        used = int(np.searchsorted(lengths, done)) + 1
        yield from self._pieces(np.concatenate([d[1] for d in self.docs[:used]]), lengths[:used], np.array(windows))
        first = int(np.searchsorted(lengths, done, side="right"))
        rest = self.docs[first:]
        if rest:
            doc_id, own, before, total = rest[0]
            gone = len(own) - int(lengths[first] - done)
            rest[0] = (doc_id, own[gone:], before + gone, total)
        self.docs, self.seen = rest, len(rest) - (len(self.docs) - self.seen)

    def _pieces(self, ids: np.ndarray, bounds: np.ndarray, windows: np.ndarray) -> Iterator[tuple]:
        begins = np.concatenate([[0], bounds[:-1]])
        edges = np.union1d(windows, bounds[bounds < windows[-1]])
        starts = np.concatenate([[0], edges[:-1]])
        doc, window = np.searchsorted(bounds, starts, side="right"), np.searchsorted(windows, starts, side="right")
        opened = np.concatenate([[0], windows])[window]
        raw = ids.astype("<u4")
        for a, b, d, w, o in zip(starts.tolist(), edges.tolist(), doc.tolist(), window.tolist(), opened.tolist()):
            doc_id, _, before, total = self.docs[d]
            own = raw[a:b]
            yield doc_id, before + a - int(begins[d]), b - a, zlib.crc32(own.tobytes()), total, self.sequence + w, a - o, own
        self.sequence += len(windows)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"


def pack(docs: DataFrame, size: int = 2048, vocabulary: str = "byte_bpe_50k", text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` (a power of two) tokens.

    doc_id; start, length: the piece within the document's ids, which end with id 1; ids_crc32 of the piece's ids as
    little-endian 32-bit integers; doc_tokens; sequence_id, offset: its place; padding: what its sequence needs to reach
    ``size``, 0 at a power of two; ids, if asked for. Ids are those of the json form, its added tokens included. A null or
    empty text is one piece holding the id 1. Documents with equal or null ids are packed each for itself. Sequences never
    span Spark partitions. An empty table gives no rows. Other columns are ignored.
    """
    schema = _PIECE + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(vocabulary, added_tokens=True)
        packer = Packer(size, ends, TaskContext.get().partitionId() << 36)
        held: list[tuple] = []

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            # pieces of a sequence that is still open wait for its length
            n = next((i for i in range(len(held) - 1, -1, -1) if held[i][5] != held[-1][5]), -1) + 1 if held and not last else len(held)
            if not n:
                return
            cols = list(zip(*held[:n]))
            del held[:n]
            seq, lengths = np.array(cols[5]), np.array(cols[2])
            _, inverse = np.unique(seq, return_inverse=True)
            pad = padding(np.bincount(inverse, weights=lengths).astype(np.int64), size)[inverse]
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(pad, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in packer.add(i, encoded(encode, t.as_py())):
                    held.append(piece if with_ids else piece[:7])
                if len(held) > 4096:
                    yield from rows(last=False)
        held += [p if with_ids else p[:7] for p in packer.flush()]
        yield from rows(last=True)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)
