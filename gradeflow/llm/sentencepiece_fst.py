"""SentencePiece BPE encoding and decoding as a shortest path in a weighted transducer over the tropical semiring.

Compiled once per worker from the model file:

* the normaliser: the model's flags (a leading space, runs of spaces kept or joined) and every space as U+2581;
* the pieces, as arcs over code points, and for a code point that no piece has an arc of its bytes, at weight 1;
* the order of merges, as weights: an arc of piece v behind an arc of piece u has weight 0, or infinity if merging by the
  model's scores would join something across their border. That is read off the two pieces' derivations, which are compiled
  with them: a pair that meets at the border is joined if its score is better than those of the next merges on both sides.

An input is composed with these parts from left to right, and the least sum of weights to each position is kept with its last
arc. A sequence of pieces is the model's encoding exactly if all its neighbours are, so every beginning of an input has one path
of finite weight and one state for each position is enough. Weights of scores alone would not do: a merge model's encoding is not
its best-scoring segmentation. No piece joins a space to what stands before it, so the composition is done word by word and kept
for words that come again.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACE = "▁"
#: Entries that a worker keeps of words and of adjacency weights; when full, a table starts anew.
KEPT_WORDS, KEPT_PAIRS = 700_000, 2_000_000
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_RUNS = re.compile(" {2,}")
INFINITE = float("inf")
_loaded: dict[str, Transducer] = {}


class _Words(dict):
    def __init__(self, of: Transducer):
        self.of = of

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self.of.token_ids(token)
        if len(token) <= 64:
            self[token] = out
        return out


class Normaliser(NamedTuple):
    """What the model file says about spaces; models with a character map of their own are refused."""

    leading: bool
    joined: bool

    @classmethod
    def of(cls, model: bytes) -> Normaliser:
        flags = {3: 1, 4: 1}  # the format's defaults
        for field, value in _fields(model):
            if field == 3:
                for number, x in _fields(value):
                    flags[number] = x
        if flags.get(2):
            raise ValueError("the model's normaliser has a character map")
        return cls(bool(flags[3]), bool(flags[4]))

    def __call__(self, text: str) -> str:
        if self.joined:
            text = _RUNS.sub(" ", text.strip(" "))
        return (SPACE if self.leading and text else "") + text.replace(" ", SPACE)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class Derivation(NamedTuple):
    """How merging makes a piece of its characters: the score of each merge in turn, and the piece at either end before it
    and after the last one."""

    scores: list[float]
    left: list[str]
    right: list[str]


class Transducer:
    def __init__(self, pieces: list[str], scores: list[float], first_byte: int, special: set[int], normaliser: Normaliser):
        self.pieces = pieces
        self.first_byte = first_byte
        self.normaliser = normaliser
        inner = {p: i for i, p in enumerate(pieces) if i not in special and not first_byte <= i < first_byte + 256}
        self.score = {p: scores[i] for p, i in inner.items()}
        self.number = inner
        self.blank = inner[SPACE]
        if any(SPACE in p[1:] for p in inner if p.strip(SPACE)):
            raise ValueError("a piece joins a space to other characters before it")
        self.text = [p.replace(SPACE, " ") if i not in special else "" for i, p in enumerate(pieces)]
        self.bytes = frozenset(range(first_byte, first_byte + 256))
        self.size, self.deepest = len(pieces), max(map(len, inner))
        #: The trie of the pieces: by code point the piece that ends there, or -1, and what may follow.
        self.arcs: dict[str, tuple] = {}
        for p, v in inner.items():
            node = self.arcs
            for c in p[:-1]:
                node = node.setdefault(c, (-1, {}))[1]
            node[p[-1]] = v, node.get(p[-1], (-1, {}))[1]
        self.derivations: dict[int, Derivation] = {}
        self.weights: dict[int, float] = {}
        self.runs: dict[int, tuple[int, ...]] = {}
        self.words = _Words(self)

    def merges(self, symbols: list[str]) -> Iterator[tuple[float, list[str]]]:
        """The score of each merge in turn, the best first and of equal ones the leftmost, and the symbols, which change."""
        n = len(symbols)
        left, right, live = list(range(-1, n - 1)), list(range(1, n + 1)), symbols
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (score := self.score.get(live[i] + live[j])) is not None:
                heapq.heappush(heap, (-score, i, j, live[i] + live[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            score, i, j, both = heapq.heappop(heap)
            if not live[i] or not live[j] or right[i] != j or live[i] + live[j] != both:
                continue
            live[i], live[j] = both, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
            yield -score, live

    def derivation(self, piece: int) -> Derivation | None:
        """None if merging the piece's characters does not give the piece."""
        if piece not in self.derivations:
            live = list(self.pieces[piece])
            out = Derivation([], [live[0]], [live[-1]])
            for score, _ in self.merges(live):
                out.scores.append(score)
                out.left.append(live[0])
                out.right.append(next(x for x in reversed(live) if x))
            self.derivations[piece] = out if out.left[-1] == self.pieces[piece] else None
        return self.derivations[piece]

    def weight(self, u: int, v: int) -> float:
        """Of an arc of piece v behind one of piece u."""
        key = u * self.size + v
        if (known := self.weights.get(key)) is not None:
            return known
        if len(self.weights) >= KEPT_PAIRS:
            self.weights.clear()
        out = self.weights[key] = INFINITE if self._joins(self.derivation(u), self.derivation(v)) else 0.0
        return out

    def _joins(self, a: Derivation | None, b: Derivation | None) -> bool:
        if a is None or b is None:
            return True
        i = j = 0
        while True:
            mine = a.scores[i] if i < len(a.scores) else -INFINITE
            other = b.scores[j] if j < len(b.scores) else -INFINITE
            # of equal scores the leftmost merge comes first
            if (across := self.score.get(a.right[i] + b.left[j])) is not None and across > mine and across >= other:
                return True
            if mine == other == -INFINITE:
                return False
            if mine >= other:
                i += 1
            else:
                j += 1

    def word_ids(self, word: str) -> tuple[int, ...]:
        """The shortest path of a word without spaces but at its start.

        least[j] is the least weight of a path to position j, last[j] its last arc: a piece, or -1 for bytes and at the start.
        """
        arcs, weights, size, n, inner, deepest = self.arcs, self.weights, self.size, len(word), self.number, self.deepest
        least, last = [INFINITE] * (n + 1), [-1] * (n + 1)
        least[0] = 0.0
        for i in range(n):
            so_far, u = least[i], last[i]
            node, j, row = arcs, i, u * size
            for c in word[i : i + deepest]:
                found = node.get(c)
                if found is None:
                    break
                v, node = found
                j += 1
                if v >= 0 and so_far < least[j]:
                    # a piece follows bytes and the start freely
                    if u >= 0:
                        w = weights.get(row + v)
                        if w is None:
                            w = self.weight(u, v)
                        if so_far + w >= least[j]:
                            continue
                        least[j], last[j] = so_far + w, v
                    else:
                        least[j], last[j] = so_far, v
            if so_far + 1.0 < least[i + 1] and word[i] not in inner:
                least[i + 1], last[i + 1] = so_far + 1.0, -1
        out: list[int] = []
        j = n
        while j:
            v = last[j]
            if v < 0:
                out += [self.first_byte + b for b in reversed(word[j - 1].encode("utf-8", "surrogatepass"))]
                j -= 1
            else:
                out.append(v)
                j -= len(self.pieces[v])
        return tuple(reversed(out))

    def run_ids(self, n: int) -> tuple[int, ...]:
        """The path of n spaces that join nothing else."""
        if n not in self.runs:
            live = [SPACE] * n
            for _ in self.merges(live):
                pass
            out = tuple(self.number[p] for p in live if p)
            if n > 1000:
                return out
            self.runs[n] = out
        return self.runs[n]

    def token_ids(self, token: str) -> tuple[int, ...]:
        """The path of spaces and the characters behind them."""
        body = token.lstrip(SPACE)
        spaces = len(token) - len(body)
        if not body:
            return self.run_ids(spaces)
        if not spaces:
            return self.word_ids(body)
        # merges of spaces score below all others, so the last space joins the word if it can
        own = self.word_ids(SPACE + body)
        return self.run_ids(spaces) + own[1:] if own[0] == self.blank else self.run_ids(spaces - 1) + own

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, _WORDS.findall(self.normaliser(text)))))

    def decode(self, ids: list[int]) -> str:
        """The pieces' text, bytes joined to characters, without the leading space if the normaliser adds one."""
        if self.bytes.isdisjoint(ids):
            out = list(map(self.text.__getitem__, ids))
        else:
            out, held = [], bytearray()
            low, high, text = self.first_byte, self.first_byte + 256, self.text
            for i in ids:
                if low <= i < high:
                    held.append(i - low)
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(text[i])
            if held:
                out.append(held.decode("utf-8", "replace"))
        joined = "".join(out)
        return joined[1:] if self.normaliser.leading and joined.startswith(" ") else joined


def transducer(model: str = "piece_bpe_32k.model") -> Transducer:
    """Compiled from a model file: its path, or its name in public_tokenizers."""
    if model not in _loaded:
        import sentencepiece

        path = model
        if "/" not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        with open(path, "rb") as file:
            normaliser = Normaliser.of(file.read())
        _loaded[model] = Transducer([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], next(i for i in range(n) if sp.is_byte(i)), special, normaliser)
    return _loaded[model]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), round_trip (decoding gives the text again), and ids if asked for.

    A null text counts as empty and has no ids. Each row is handled for itself. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, sums, same, all_ids = [], [], [], []
                for value in part.column(1):
                    own = value.as_py()
                    ids = fst.encode(own)
                    raw = np.array(ids, "<i4")
                    counts.append(len(ids))
                    sums.append(zlib.crc32(raw.tobytes()))
                    same.append(fst.decode(ids) == own)
                    if with_ids:
                        all_ids.append(raw)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of id lists; null and empty lists give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fst.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
