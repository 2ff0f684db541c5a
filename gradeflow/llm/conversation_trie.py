"""Conversation prefix trie: z-fast tries over batches of conversations, merged by prefix digest.

A conversation is a string of turns, and a prefix of it is named by a chained SHA-256, so equal prefixes have equal names on every
executor. Each task inserts its conversations, batch by batch, in z-fast tries: a dictionary holds each compacted node at its
handle, the prefix of the two-fattest length of its edge; a fat binary search finds a conversation's exit node in a logarithmic
number of look-ups. A batch's edges are then expanded to one row for each prefix, with sums over its members, and these partial
nodes are added up by digest: a prefix that a third of all conversations share is one row of each batch.

Sums over subtrees need no walk through levels: each node's share is credited to its smallest member, and the credits of all
members of a node, put through the tries as weights, give the sum (see ``build``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_SEGMENT = 1024  # turns in a row; a longer conversation goes on in another one, whose root is the prefix so far
_BATCH = 200_000  # turns in the tries of a task at once
_ROWS = 20_000
_PIECE = 4096  # ids in a piece of a list
_ROOT = hashlib.sha256().digest()
_SEGMENTS = "conv_id long, start long, digests array<binary>, sizes array<long>, ends boolean"


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Tries:
    """Z-fast tries over segments; the digest of its first prefix tells which trie a segment is of."""

    def __init__(self) -> None:
        self.top: list[int] = []  # where a node's edge begins; it ends at the node's extent
        self.end: list[int] = []
        self.of: list[int] = []  # a segment whose digests name the prefixes along the edge
        self.parent: list[int] = []
        self.digests: list[list[bytes]] = []
        self.at: list[int] = []  # the node where each segment ends
        self.roots: dict[bytes, int] = {}
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}  # children by the first prefix of their edge

    def _node(self, top: int, end: int, of: int, parent: int) -> int:
        node = len(self.top)
        for column, value in ((self.top, top), (self.end, end), (self.of, of), (self.parent, parent)):
            column.append(value)
        if parent >= 0:
            self._hold(node)
        return node

    def _hold(self, node: int) -> None:
        """Enters the node at its handle and at the first prefix of its edge."""
        names, top = self.digests[self.of[node]], self.top[node]
        self.handles[names[fattest(top, self.end[node])]] = node
        self.first[names[top + 1]] = node

    def locate(self, names: list[bytes]) -> tuple[int, int | None]:
        """The deepest node whose extent is a prefix of the segment, and the node on whose edge it leaves the trie."""
        low, high, parent = 0, len(names) - 1, self.roots[names[0]]
        while low < high:
            middle = fattest(low, high)
            node = self.handles.get(names[middle])
            if node is None:
                high = middle - 1
            elif (end := self.end[node]) < len(names) and self.digests[self.of[node]][end] == names[end]:
                low, parent = end, node
            else:
                return self.parent[node], node
        return parent, self.first.get(names[low + 1]) if low + 1 < len(names) else None

    def insert(self, names: list[bytes]) -> None:
        segment, length = len(self.digests), len(names) - 1
        self.digests.append(names)
        if names[0] not in self.roots:
            self.roots[names[0]] = self._node(0, 0, segment, -1)
        parent, node = self.locate(names)
        if self.end[parent] < length:
            if node is not None:
                own, low, high = self.digests[self.of[node]], self.top[node] + 1, min(length, self.end[node] - 1)
                while low < high:  # equal up to their common prefix
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if own[middle] == names[middle] else (low, middle - 1)
                del self.handles[own[fattest(self.top[node], self.end[node])]]
                parent = self._node(self.top[node], low, self.of[node], parent)
                self.top[node], self.parent[node] = low, parent
                self._hold(node)
            if self.end[parent] < length:
                parent = self._node(self.end[parent], length, segment, parent)
        self.at.append(parent)

    def sums(self, weights: list[list[int]], ids: list[int]) -> tuple[list[list[int]], list[int]]:
        """Each node's sums of the weights of its members, and its smallest member."""
        total, least = [[0] * len(self.top) for _ in weights], [None] * len(self.top)
        for k, node in enumerate(self.at):
            for t, w in zip(total, weights, strict=True):
                t[node] += w[k]
            least[node] = ids[k] if least[node] is None else min(least[node], ids[k])
        for node in sorted(range(len(self.top)), key=self.end.__getitem__, reverse=True):
            if (up := self.parent[node]) >= 0:
                for t in total:
                    t[up] += t[node]
                least[up] = least[node] if least[up] is None else min(least[up], least[node])
        return total, least


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with chained digests, from turns (conv_id, pos, digest, size) in order; each conversation begins with pos 0."""
    out: list[tuple] = []
    conv, start, names, sizes = None, 0, [_ROOT], [0]
    types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.bool_()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "start", "digests", "sizes", "ends"])
    held = 0
    for batch in batches:
        for c, pos, digest, size in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if not pos:
                if conv is not None:
                    out.append((conv, start, names, sizes, True))
                conv, start, names, sizes = c, 0, [_ROOT], [0]
                continue
            if len(names) > _SEGMENT:
                out.append((conv, start, names, sizes, False))
                start, names, sizes = start + len(names) - 1, names[-1:], [0]
            names.append(hashlib.sha256(names[-1] + digest).digest())
            sizes.append(size)
            held += 1
            if held >= _ROWS and out:
                yield batch_of(out)
                out, held = [], 0
    if conv is not None:
        out.append((conv, start, names, sizes, True))
    if out:
        yield batch_of(out)


def _tries(n_weights: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(digest, depth, parent, size, least, s0, s1, ...): the prefixes of each batch of segments with sums of the members' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * (2 + n_weights)]
        heads = ["digest", "depth", "parent", "size", "least", *(f"s{k}" for k in range(n_weights))]

        def expanded() -> Iterator[pa.RecordBatch]:
            total, least = tries.sums(weights, ids)
            rows: list[tuple] = []
            for node, (top, end, of) in enumerate(zip(tries.top, tries.end, tries.of, strict=True)):
                names, own = tries.digests[of], (least[node], *(t[node] for t in total))
                if not end and not starts[of]:
                    rows.append((names[0], 0, None, 0, *own))
                rows.extend((names[d], starts[of] + d, names[d - 1], sizes[of][d], *own) for d in range(top + 1, end + 1))
                if len(rows) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=heads)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=heads)

        tries, ids, starts, sizes, weights, held = Tries(), [], [], [], [[] for _ in range(n_weights)], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                tries.insert(row[2])
                for column, value in zip((ids, starts, sizes, *weights), (row[0], row[1], row[3], *row[5:]), strict=True):
                    column.append(value)
                held += len(row[2])
                if held >= _BATCH:
                    yield from expanded()
                    tries, ids, starts, sizes, weights, held = Tries(), [], [], [], [[] for _ in range(n_weights)], 0
        if ids:
            yield from expanded()

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, first id, ids joined): runs of ids that follow on another, from (digest, conv_id) in order."""
    digest, ids, out = None, [], []

    def flushed() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])
            out.clear()

    for batch in batches:
        for d, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if d != digest or len(ids) == _PIECE:
                if ids:
                    out.append((digest, ids[0], ",".join(map(str, ids))))
                digest, ids = d, []
            ids.append(i)
        if len(out) >= 1000:
            yield from flushed()
    if ids:
        out.append((digest, ids[0], ",".join(map(str, ids))))
    yield from flushed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, sha256 of its pieces joined by commas), from pieces in order."""
    digest, state, out = None, None, []
    for batch in batches:
        for d, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if d != digest:
                if state:
                    out.append((digest, state.hexdigest()))
                digest, state = d, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["digest", "ends_sha256"])
            out = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size): the turns of each conversation, numbered from 1 by turn (null first), role and text.

    A null role or text is empty. Rows without conv_id are of no conversation. The digest is of role and text, size the text's
    UTF-8 bytes.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("conv_id", pos.cast("long").alias("pos"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))


def with_shared_heads(turns: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c anew: the first h turns of conversation c - c % every, then its own after its first h, where h is the
    crc32 of c modulo ``heads``. Rows of turns_of and a row with pos 0 for each conversation, also those left without turns."""
    at, c = written(turns), F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(heads))
    every_one = at.select("conv_id").distinct()
    begun = every_one.select("conv_id", (c - c % every).alias("head"), h.alias("h")).join(at.where(F.col("pos") < heads).withColumnRenamed("conv_id", "head"), "head").where(F.col("pos") <= F.col("h"))
    return begun.select("conv_id", "pos", "digest", "size").union(at.where(F.col("pos") > h)).union(_beginnings(every_one))


def _beginnings(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"))


def with_beginnings(turns: DataFrame) -> DataFrame:
    """The turns as they are, and a row with pos 0 for each conversation."""
    return turns.union(_beginnings(turns.select("conv_id").distinct()))


def build(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).

    ``turns`` has (conv_id, pos, digest, size) with a row of pos 0 for each conversation; equal pairs of pos count in any order.
    A node is a distinct sequence of first turns, from the root of depth 0 down; conv_id is its smallest member. n_leaves counts
    the childless nodes of its subtree, saved_tokens adds (n_convs - 1) * size over it, ends_sha256 is of the members that end
    there. An empty table has no nodes, one with conversations without turns only the root.

    Sums over a subtree: the nodes that conversation c is the smallest member of are the last ones of its path. With T(c) their
    sum of (n_convs - 1) * size, and S(u) the part of it from u down for u's own smallest member m, a node's sum is that of T over
    its members, less T(m), plus S(u): all others of its members own nodes below u only. A leaf is counted at its smallest member
    likewise.
    """
    in_order = turns.select("conv_id", "pos", "digest", "size").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    segments = written(in_order.mapInArrow(_chain, _SEGMENTS))
    schema = "digest binary, depth long, parent binary, size long, least long, s0 long"
    parts = segments.withColumn("w", F.lit(1).cast("long")).mapInArrow(_tries(1), schema)
    nodes = written(parts.groupBy("digest", "depth", "parent", "size").agg(F.min("least").alias("least"), F.sum("s0").alias("n")))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n") - 1) * F.col("size")
    owned = nodes.join(children, "digest", "left").select("digest", "depth", "parent", "n", "least", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved.alias("saved"))
    path = Window.partitionBy("least").orderBy(F.col("depth").desc())
    owned = written(owned.withColumn("below", F.sum("saved").over(path.rowsBetween(Window.unboundedPreceding, 0))))
    owners = owned.groupBy("least").agg(F.sum("saved").alias("t"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    weighted = segments.join(owners.withColumnRenamed("least", "conv_id"), "conv_id", "left")
    credit = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    sums = weighted.select("conv_id", "start", "digests", "sizes", "ends", credit("t"), credit("leaf")).mapInArrow(_tries(2), schema + ", s1 long")
    sums = sums.groupBy("digest").agg(F.sum("s0").alias("t"), F.sum("s1").alias("n_leaves"))
    ended = segments.where("ends").select(F.element_at("digests", -1).alias("digest"), "conv_id")
    pieces = ended.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pieces, "digest binary, first long, ids string")
    ends = pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")
    up = nodes.select(F.col("digest").alias("parent"), F.col("least").alias("parent_conv_id"))
    own_t = owners.select("least", F.col("t").alias("own_t"))
    out = owned.join(own_t, "least").join(sums, "digest").join(ends, "digest", "left").join(up, "parent", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
        (F.col("t") - F.col("own_t") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that take the first turns of another one."""
    return build(with_shared_heads(turns_of(conversations)))
