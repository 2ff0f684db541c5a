"""Exact dedup against a minimal perfect hash of the distinct digests seen so far.

The history of a corpus is an index of shards. A shard is a minimal perfect hash function over its digests (hash and
displace): a displacement for each bucket, and one slot for each digest holding the full 32 bytes with the locator of the
row that stays (its doc_id) and the number of rows. A lookup computes the slot of a digest and compares all 32 bytes
there: equal ones repeat history, the others are new and are grouped among themselves.

Digests are aggregated before they are looked up, so a text that holds a third of all rows reaches a shard as one row.
The shard count follows the number of digests, so a shard stays small at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest_of, only_kept, text_of, written

#: Digests that a shard of the index holds on average: 1.6 MB of slots.
SHARD_DIGESTS = 40_000
_LAMBDA = 4
_TRIES = 256
_INDEX = "shard long, n long, displacements binary, digests binary, winners array<long>, sizes array<long>"


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view(">u8").astype(np.uint64).reshape(len(digests), 4)


def _slots(words: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slots of digests' words (k x 4) under seeds that broadcast against them."""
    with np.errstate(over="ignore"):
        z = words[:, 2] + seeds.astype(np.uint64) * (words[:, 3] | np.uint64(1))
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return ((z ^ (z >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def build_hash(digests: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over n distinct digests (n x 32 bytes).

    A bucket's displacement d >= 0 seeds the slots of its digests; a bucket of one digest takes a free slot s directly, as
    -1 - s.
    """
    n = len(digests)
    words = _words(digests)
    m = max(1, n // _LAMBDA)
    buckets = (words[:, 1] % np.uint64(m)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    counts = np.bincount(buckets, minlength=m)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    taken = np.zeros(n, bool)
    out = np.zeros(m, np.int64)
    by_size = np.argsort(-counts, kind="stable")
    for b in by_size[counts[by_size] > 1]:
        own = words[order[starts[b] : starts[b] + counts[b]]]
        first = 0
        while True:
            at = _slots(own, np.arange(first, first + _TRIES)[:, None], n)
            free = ~taken[at].any(axis=1)
            ranked = np.sort(at, axis=1)
            good = np.flatnonzero(free & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))
            if len(good):
                taken[at[good[0]]] = True
                out[b] = first + good[0]
                break
            first += _TRIES
    singles = by_size[counts[by_size] == 1]
    out[singles] = -1 - np.flatnonzero(~taken)[: len(singles)]
    return out


def slots_of(digests: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    """The slot of each digest; any 32 bytes have one, members or not."""
    words = _words(digests)
    d = displacements[(words[:, 1] % np.uint64(len(displacements))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _slots(words, np.maximum(d, 0), n))


def _as_rows(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in values), np.uint8).reshape(len(values), 32).copy()


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards))


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _as_rows(pdf["digest"])
    displacements = build_hash(digests)
    at = slots_of(digests, displacements, len(digests))
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    winners = pdf["winner"].astype("Int64").to_numpy(object, na_value=None)[order]
    return pd.DataFrame(
        {
            "shard": [pdf["shard"].iloc[0]],
            "n": [len(digests)],
            "displacements": [displacements.astype("<i8").tobytes()],
            "digests": [digests[order].tobytes()],
            "winners": [list(winners)],
            "sizes": [list(pdf["size"].to_numpy()[order])],
        }
    )


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """New digests with what history knows of them, and the members of history that no new row repeats."""
    out = []
    if len(index):
        held = index.iloc[0]
        n = int(held["n"])
        slots = np.frombuffer(held["digests"], np.uint8).reshape(n, 32)
        winners, sizes = list(held["winners"]), np.array(held["sizes"], np.int64)
        met = np.zeros(n, bool)
    if len(new):
        row = {"digest": new["digest"], "winner": new["winner"].astype("Int64"), "size": new["size"], "old_winner": pd.array([None] * len(new), "Int64"), "old_size": 0}
        found = pd.DataFrame(row)
        if len(index):
            digests = _as_rows(new["digest"])
            at = slots_of(digests, np.frombuffer(held["displacements"], "<i8"), n)
            member = (slots[at] == digests).all(axis=1)
            met[at[member]] = True
            found["old_winner"] = pd.array([winners[s] if m else None for s, m in zip(at, member)], "Int64")
            found["old_size"] = np.where(member, sizes[at], 0)
        out.append(found)
    if len(index) and not met.all():
        rest = np.flatnonzero(~met)
        out.append(
            pd.DataFrame(
                {
                    "digest": [slots[i].tobytes() for i in rest],
                    "winner": pd.array([None] * len(rest), "Int64"),
                    "size": 0,
                    "old_winner": pd.array([winners[i] for i in rest], "Int64"),
                    "old_size": sizes[rest],
                }
            )
        )
    return pd.concat(out) if out else pd.DataFrame(columns=["digest", "winner", "size", "old_winner", "old_size"])


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest) of every row; a null text counts as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text_of(text)).alias("digest"))


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))


def build_history(rows: DataFrame, shards: int) -> DataFrame:
    """The index over the distinct digests of rows (doc_id, digest): one row per shard."""
    return _distinct(rows).withColumn("shard", _shard(F.col("digest"), shards)).groupBy("shard").applyInPandas(_build_shard, _INDEX)


def resolve(history: DataFrame, new_rows: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of every distinct digest in history or among the new rows."""
    new = _distinct(new_rows).withColumn("shard", _shard(F.col("digest"), shards))
    met = new.groupBy("shard").cogroup(history.groupBy("shard")).applyInPandas(lambda a, b: _look_up(a, b), "digest binary, winner long, size long, old_winner long, old_size long")
    return met.select("digest", F.greatest("winner", "old_winner").alias("keep_id"), (F.col("size") + F.col("old_size")).alias("group_size"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", is_history: Column | None = None) -> DataFrame:
    """Every row of docs with the row of its text that stays: doc_id, keep_id, group_size, kept, text_sha256.

    ``is_history`` says which rows were seen before; by default the half with the smaller ids. The result is the same for
    any choice: of equal texts (identical bytes, a null as the empty text) the largest doc_id stays.

    Rows that repeat both id and text are alike in the result, each counted in group_size. A null doc_id is below any
    other; if all ids of a group are null, keep_id is null and its rows are kept. An empty table gives an empty result.
    Other columns are ignored.
    """
    rows = written(digests(docs, text, doc_id))
    n, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    shards = max(1, -(-n // SHARD_DIGESTS))
    if is_history is None:
        middle = 0 if low is None else (low + high) // 2
        is_history = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    history = build_history(rows.where(is_history), shards)
    groups = resolve(history, rows.where(~is_history), shards)
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each text: that with the largest doc_id, null below all others.

    Of rows that repeat this id and text one stays, the least by its columns. A null text is equal to an empty one.
    """
    keep = exact_dedup(docs, text, doc_id).where("kept").select(F.unhex("text_sha256").alias("digest"), "keep_id").distinct()
    return only_kept(docs, keep, digest_of(text_of(text)), doc_id)
