import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeflow.llm import collocations
from gradeflow.llm.collocations import equal_partitions, mine

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top, absorb):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        holds = (f for (other, w), f in found.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w))))
        if any(100 * f >= absorb * a for f in holds):
            continue
        cuts = [(10**6 * a * a // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, best in out.items() for i, (s, a, p, l, r) in enumerate(sorted(best)[:top]))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, n string")


def texts(seed, n, vocabulary):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" if i % 7 else f"É{i}Ä" for i in range(vocabulary)])
    marks = np.array([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "])
    out = []
    for _ in range(n):
        size = rng.integers(0, 60)
        pick = np.minimum(rng.zipf(1.5, size) - 1, vocabulary - 1)
        out.append((["en", "de", None][rng.integers(0, 3)], "".join(words[w] + marks[m] for w, m in zip(pick, rng.integers(0, len(marks), size), strict=True))))
    return out


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (3, 2, 40), (2, 5, 2000), (4, 3, 2000)])
def test_against_brute_force(spark, monkeypatch, longest, least, top):
    monkeypatch.setattr(collocations, "_RANGE", 400)  # many ranges, whose edges fall within phrases
    rows = texts(longest, 250, 40) + [("en", "New York City, new york city. NEW\tYORK  city")] * 5 + [("en", None), (None, ""), ("fr", " . , \n")]
    got = sorted(tuple(r) for r in mine(table(spark, rows).repartition(5), least, longest, top).collect())
    assert got == brute(rows, least, longest, top, 50) and got


def test_hot_pair_long_text_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_RANGE", 300)
    rows = [("en", f"of the {'x' * (i % 9 + 1)} of the word{i % 70}") for i in range(400)] + [("en", "tic tac " * 40_000), ("en", "longword" * 5000 + " tic")]
    got = sorted(tuple(r) for r in mine(table(spark, rows), 10).collect())
    assert got == brute(rows, 10, 3, 2000, 50) and got


def test_blocks_end_at_pieces(spark, monkeypatch):
    rows = [("en", "a b c. " * 300 + "d e f g " * 500 + "\n" + "a b, c a b " * 200), ("de", "a b " * 900)] * 2
    held = collocations._BLOCK
    try:
        import pyarrow as pa

        for size in (held, 1000, 64):
            collocations._BLOCK = size
            batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])
            got = Counter()
            for langs, words, code, lang, same in collocations._blocks(batch):
                words = words.to_pylist()
                got.update((langs[a], words[x]) + ((words[y],) if s else ()) for x, y, a, s in zip(code, [*code[1:], 0], lang, same, strict=True))
            want = Counter()
            for lang, text in rows:
                for piece in re.split("[.,\n]", text):
                    w = [x.encode() for x in piece.split()]
                    want.update([(lang, x, y) for x, y in pairwise(w)] + [(lang, w[-1])] * bool(w))
            assert got == want
    finally:
        collocations._BLOCK = held


def test_empty_table(spark):
    assert mine(table(spark, [])).collect() == [] == mine(table(spark, [("en", None), (None, " ")])).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 4)] * 3, st.integers(1, 3)), min_size=1, max_size=80), st.integers(1, 6))
def test_quicksort_finds_every_equal_partition(rows, least):
    keys = np.array([r[:3] for r in rows], np.int32).T.copy()
    weights = np.array([r[3] for r in rows])
    got = sorted((d, tuple(keys[:d, p])) + (w,) for d, ps, ws in equal_partitions(keys, weights, least) for p, w in zip(ps, ws, strict=True))
    count = Counter()
    for r in rows:
        for d in (1, 2, 3):
            count[d, r[:d]] += r[3]
    assert got == sorted((d, k, w) for (d, k), w in count.items() if w >= least)
