import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.llm.exact_dedup import build_hash, drop_repeats, exact_dedup, slots_of


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.frombuffer(os.urandom(32 * n), np.uint8).reshape(n, 32).copy()
    assert sorted(slots_of(keys, build_hash(keys), n)) == list(range(n))


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(docs_of, extra):
    rows = [(1, "a"), (2, "b"), (3, "a"), (9, None), (4, ""), (5, "a "), (6, "é" * 70_000), (7, "é" * 70_000), (7, "é" * 70_000), (None, "n"), (None, "n"), (None, "a")]
    got = exact_dedup(docs_of(rows, extra))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_hot_group_and_any_history(docs_of):
    from pyspark.sql import functions as F

    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(600)]
    for history in (None, F.lit(False), F.lit(True), F.col("doc_id") % 2 == 0):
        got = exact_dedup(docs_of(rows), is_history=history)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table_and_filter(docs_of):
    assert exact_dedup(docs_of([])).collect() == []
    kept = drop_repeats(docs_of(["x", "y", "x", None]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def brute_rows(rows):
    """One row of each text: the largest id, null below all others."""
    best = {}
    for i, t in rows:
        key = t or ""
        if key not in best or (i is not None and (best[key] is None or i > best[key])):
            best[key] = i
    return sorted(((i, t) for t, i in best.items()), key=repr)


@pytest.mark.parametrize("rows", [
    [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "b")],
    [(None, "x"), (None, "x"), (5, "x"), (None, "y"), (None, "y"), (7, None), (8, "")],
    [(1, "same")] * 30 + [(2, "other"), (1, "other")],
    [(4, "é" * 50_000), (5, "é" * 50_000), (5, "é" * 50_000 + ".")],
    [],
])
def test_rows_are_told_by_id_and_text(docs_of, rows):
    got = drop_repeats(docs_of(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == brute_rows(rows)


def test_clashing_names_and_maps(docs_of):
    docs = docs_of(["x", "y", "x", None])
    for name in ("_pair", "pair", "_row", "row", "_id", "digest", "keep_id"):
        docs = docs.withColumn(name, F.lit("own"))
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    kept = drop_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r._pair, r.pair, r.row, r.tags["k"]) for r in kept.collect()) == [(1, "y", "own", "own", "own", 1), (2, "x", "own", "own", "own", 2), (3, None, "own", "own", "own", 3)]
