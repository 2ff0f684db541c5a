import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import near_dup
from gradeflow.llm.components import components
from gradeflow.llm.near_dup import keep_one, least_matches, minhashes, near_duplicates, shingles, survivors


def grams(text, n=5):
    w = text.encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = {t: grams(t) for t in texts}
    parent, links = {t: t for t in texts}, dict.fromkeys(texts, 0)

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        least.setdefault(root(t or ""), []).append(i)
    copies = [t or "" for _, t in rows]
    return sorted([(i, min((x for x in least[root(t or "")] if x is not None), default=None), links[t or ""], copies.count(t or "")) for i, t in rows], key=repr)


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 40, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + ["", None, "", "one", "one", "one ", "a b c d e", "a b c d e f"]


def test_shingles_are_sets_of_word_ngrams():
    for t in corpus(3):
        assert len(shingles(t or "")) == len(grams(t or ""))
    assert len(np.intersect1d(shingles("a b c d e f"), shingles("x a b c d e"))) == 1


def test_pruning_bound():
    least = least_matches(0.8, 1e-7)
    assert least == tuple(sorted(least)) and 20 < least[-1] < 45
    a = minhashes([shingles(" ".join(map(str, range(200)))), shingles(" ".join(map(str, [*range(190), *range(900, 910)]))), shingles("x y z u v w")])
    sig = (a[:, :64] & np.uint64(255)).astype(np.uint8)
    x, y = survivors(sig, sig, 0.8, 1e-7)
    assert {(i, j) for i, j in zip(x.tolist(), y.tolist()) if i < j} == {(0, 1)}


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(docs_of, extra):
    rows = [*enumerate(corpus()), (None, "nobody knows this one at all"), (7, "a b c d e")]
    got = near_duplicates(docs_of(rows, extra)).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got], key=repr) == brute(rows)


def test_large_groups_are_split(docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"n{i}x{rng.random()}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = near_duplicates(docs_of(rows)).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got], key=repr) == brute(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), (6, 10), (10, 11), (11, 12), (12, 13), (13, 3), (20, 21), (20, 21)]
    got = {r.vertex: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4, 5, 6, 10, 11, 12, 13)}, 20: 20, 21: 20}


def test_empty_and_keep_one(docs_of):
    assert near_duplicates(docs_of([])).collect() == []
    kept = keep_one(docs_of(["a b c d e f g", "x", "a b c d e f g", None, "", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]


@pytest.mark.parametrize("rows", [
    [(2, "b c d e f g"), (2, "x y z u v w"), (3, "b c d e f g"), (1, "p q r s t"), (1, "p q r s t")],
    [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (None, "only null here now yes"), (None, None), (9, "")],
    [(7, " ".join(f"w{i}" for i in range(60))), (7, " ".join(f"w{i}" for i in range(1, 60))), (8, " ".join(f"w{i}" for i in range(60)) + " z")],
    [(3, "word " * 30_000), (4, "word " * 30_000), (5, "Word " * 30_000)],
])
def test_one_row_of_each_class_stays(docs_of, rows):
    import hashlib

    classes = {}
    for (i, t), (_, c, _, _) in zip(sorted(rows, key=repr), brute_classes(rows)):
        classes.setdefault(c, []).append((i is None, i or 0, hashlib.sha256((t or "").encode()).digest(), i, t or ""))
    want = sorted((min(v)[3:] for v in classes.values()), key=repr)
    got = keep_one(docs_of(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == want


def brute_classes(rows):
    """(id, class, -, -) in the order of the rows' sorted reprs; a class is named by its least text."""
    texts = sorted({t or "" for _, t in rows})
    name = {t: t for t in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                both = len(grams(a) & grams(b))
                if both and 5 * both >= 4 * len(grams(a) | grams(b)):
                    name[a] = name[b] = min(name[a], name[b])
    return [(i, name[t or ""], None, None) for i, t in sorted(rows, key=repr)]


def test_very_long_texts(docs_of):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "t0 " + long), (4, long.upper())]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}


def test_clashing_names_and_maps(docs_of):
    docs = docs_of(["a b c d e f g", "x", "a b c d e f g"])
    for name in ("_pair", "pair", "_row", "row", "uid", "digest", "keep_id"):
        docs = docs.withColumn(name, F.lit("own"))
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text, r._pair, r.row, r.tags["k"] == r.doc_id) for r in kept.collect()) == [("a b c d e f g", "own", "own", True), ("x", "own", "own", True)]
