import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.llm.common import fold
from gradeflow.llm.suffix_tree_lm import _count, build_tree, contexts, document_scores, score_documents, stream_of, words_of


def brute_base(rows, train):
    counts = Counter(w for i, t in rows if train(i) for w in words_of((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = words_of((t or "").encode())
        out.append((i, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)))
    return sorted(out, key=repr)


def test_words():
    assert words_of("ÀB c\x0bD\x1cE　 x".encode()) == ["Àb".encode(), b"c", "d\x1ce　".encode(), b"x", b"\n"]
    assert words_of(b" ") == [b"\n"]


def brute_model(docs, depth, share):
    """(context bytes -> Counter) of retained contexts, by the definition."""
    counts = {}
    for d in docs:
        s = b"\n" * depth + b" ".join(d[:-1]) + b"\n"
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    total = sum(counts[b""].values())
    kept = {b"": counts[b""]}
    for c, n in counts.items():
        t, p = sum(n.values()), counts.get(c[1:])
        if c and t >= max(2, share * total):
            pt = sum(p.values())
            gain = sum(k * math.log((k / t) / (p[x] / pt)) for x, k in n.items())
            if gain >= len(n) * (math.log(total) / 2 + math.log(len(counts[b""]))):
                kept[c] = n
    return kept


def brute_score(kept, doc, depth):
    def chance(context, x):
        own = kept.get(context)
        if not context:
            return ((own or {}).get(x, 0) + 1) / (sum((own or {}).values()) + 256)
        below = chance(context[1:], x)
        return below if own is None else (own.get(x, 0) + len(own) * below) / (sum(own.values()) + len(own))

    s = b"\n" * depth + b" ".join(doc[:-1]) + b"\n"
    return sum(math.log10(chance(s[i - depth : i], s[i])) for i in range(depth, len(s)))


def test_tree_against_definition(spark):
    rng = random.Random(2)
    syllables = ["the", "an", "ti", "on", "er", "ou"]
    docs = [words_of(" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 60))).encode()) for _ in range(60)]
    texts = [b" ".join(d[:-1]) for d in docs]
    depth, share = 3, 0
    import pyarrow as pa

    parts = pa.Table.from_batches(_count(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])]), depth)).to_pandas()
    grams = parts[parts.gram.notna()][["gram", "n"]].astype("int64")
    rows = contexts(spark.createDataFrame(grams), depth).toPandas()
    kept = brute_model(docs, depth, share)
    got = {}
    for r in rows.itertuples():
        got.setdefault(int(r.context).to_bytes(8, "big")[8 - r.length :], Counter())[r.next] += r.n
    assert got == kept and len(kept) > 10
    tree = build_tree(*(rows[c].to_numpy() for c in ("length", "context", "next", "n")), depth)
    tests = [*docs, words_of(b""), words_of("été Zürich thethe".encode()), words_of(b"the " * 400)]
    assert np.allclose(document_scores(tree, tests, depth), [brute_score(kept, d, depth) for d in tests], atol=1e-2, rtol=1e-5)
    seen = int(tree.symbols.max())
    assert np.allclose((10.0 ** tree.log10[:, :seen]).sum(1) + (256 - seen) * 10.0 ** tree.log10[:, seen], 1, atol=1e-4)


@pytest.mark.parametrize("head", [0, 20, 10**6])
def test_base_against_brute_force(docs_of, head):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["The", "the", "a", "b\t", f"x{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "é " * 3000), (5, "repeat The"), (5, "repeat The"), (None, "nobody")]
    got = score_documents(docs_of(rows, extra=True), fold(F.col("doc_id"), 7) != 2, head_words=head).collect()
    want = brute_base(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == want
    assert all(r.score < 0 for r in got)


def test_beats_the_base_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = score_documents(docs, fold(F.col("doc_id"), 7) != 2).where(fold(F.col("doc_id"), 7) == 2).agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 1000 and got[0] > got[1]


def test_empty(docs_of):
    assert score_documents(docs_of([])).collect() == []
    (r,) = score_documents(docs_of([(None, "ab")])).collect()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and abs(r.score + 3 * math.log10(256)) < 1e-4
    assert stream_of([words_of(b"a")])[0].tobytes() == b"\n\n\n\n\n\na\n"


def test_rare_contexts_stay_in_a_large_corpus(spark):
    # "qu" comes 30 times among ten million positions and is always before "x", which is rare elsewhere
    def gram(text):
        return int.from_bytes(text, "big")

    rows = [(gram(b"aaaa"), 5_000_000), (gram(b"aaab"), 4_999_000), (gram(b"aaax"), 900), (gram(b"zqux"), 30)]
    kept = {(r.length, r.context) for r in contexts(spark.createDataFrame(rows, "gram long, n long"), 3).collect()}
    assert (1, ord("u")) in kept


@pytest.mark.parametrize("head", [0, 4, 10**6])
def test_scores_do_not_depend_on_the_head(docs_of, head):
    rng = random.Random(3)
    vocabulary = ["the", "then", "other", "quiz", "queue", "zebra", "été"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50)))) for i in range(80)] + [(90, "quite unseen wörds then"), (91, None)]
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    docs = {i: words_of((t or "").encode()) for i, t in rows}
    kept = brute_model([d for i, d in docs.items() if learned(i)], 6, 0)
    assert len(kept) > 30
    got = {r.doc_id: r.score for r in score_documents(docs_of(rows), fold(F.col("doc_id"), 7) != 2, head_contexts=head).collect()}
    want = {i: brute_score(kept, d, 6) for i, d in docs.items()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-2 for i in want)


def test_long_texts_and_repeated_rows(docs_of):
    rng = random.Random(8)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été"]) for _ in range(40_000))
    rows = [(i, "alpha beta gamma " * 5) for i in range(20)] + [(50, long), (51, long), (51, long), (None, long)]
    got = score_documents(docs_of(rows, extra=True), fold(F.col("doc_id"), 7) != 2).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (50, 51)} == {40_001}
    same = [r.score for r in got if r.n_tokens == 40_001]
    assert len(same) == 4 and max(same) - min(same) < 1e-3 * abs(same[0])
    kept = brute_model([words_of((t or "").encode()) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2], 6, 0)
    assert abs(same[0] - brute_score(kept, words_of(long.encode()), 6)) < 1e-4 * abs(same[0])


def test_counts_meet_as_lists_by_parts():
    import pyarrow as pa

    from gradeflow.llm.suffix_tree_lm import _dealt, _summed

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "then", "été", f"n{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(50)]
    tasks = [list(_count(iter([pa.RecordBatch.from_arrays([pa.array(texts[k::3], pa.binary())], names=["text"])]), 6)) for k in range(3)]
    want = Counter()
    for word, gram, n in (r.values() for task in tasks for batch in task for r in batch.to_pylist()):
        want[word, gram] += n
    dealt = pa.Table.from_batches([b for task in tasks for b in _dealt(iter(task), 8)])
    # a task sends a list of words and one of n-grams to a part, however many there are
    assert dealt.num_rows <= 3 * 2 * 8 < len(want)
    parts = [_summed(dealt.filter(pa.compute.equal(dealt["part"], k))).to_pylist() for k in range(8)]
    got = [(r["word"], r["gram"], r["n"]) for part in parts for r in part]
    assert len(got) == len(want) and all(want[word, gram] == n for word, gram, n in got)
    assert sum(map(bool, parts)) > 4


@pytest.mark.parametrize("frequent", [[], [b"the", b"q"], [b"the", b"\n"]])
def test_gains_of_words(frequent):
    import pyarrow as pa

    from gradeflow.llm.suffix_tree_lm import word_gains

    docs = [words_of(t) for t in (b"", b"The the  x", b" ", "été the".encode(), b"q")]
    known, gain, others = word_gains(pa.array(frequent, pa.binary()), np.arange(1.0, len(frequent) + 1), *stream_of(docs))
    assert known.tolist() == [sum(w in frequent for w in d) for d in docs]
    assert gain.tolist() == [sum(frequent.index(w) + 1.0 for w in d if w in frequent) for d in docs]
    assert others.to_pylist() == [[w for w in d if w not in frequent] for d in docs]
