import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import quality_cnn as q


@pytest.fixture(scope="module")
def weights():
    return q._start(np.random.default_rng(3))


def test_gradient_is_numeric_gradient(weights):
    w = q.Weights(*(x.astype(np.float64) for x in weights))
    texts = [b"abc" * 60, b"", b"The cat sat on the mat. " * 30]
    flat, starts = q.laid_out(texts)
    target, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss(w):
        z, _ = q.forward(w, flat, starts)
        return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - target * z)).mean())

    grad = q.gradient(w, flat, starts, target, weight)
    rng = np.random.default_rng(0)
    for k, name in enumerate(q.Weights._fields):
        rows = {97, 98, 84, 32}
        for _ in range(4):
            i = tuple(int(rng.integers(n)) for n in w[k].shape)
            if name == "embed":
                i = (rows.pop(), i[1])
            diff = []
            for sign in (1, -1):
                x = w[k].copy()
                x[i] += sign * 1e-6
                diff.append(loss(w._replace(**{name: x})))
            assert abs((diff[0] - diff[1]) / 2e-6 - grad[k][i]) < 1e-4, (name, i)


def test_score_of_a_text_depends_on_it_alone(weights):
    texts = [b"", b"x", b"y" * 127, b"abc " * 64, b"lorem ipsum " * 500, bytes(range(256)) * 9]
    alone = [q.logits_of(weights, [t])[0] for t in texts]
    assert np.allclose(q.logits_of(weights, texts), alone, atol=1e-4)
    assert np.allclose(q.logits_of(weights, texts[::-1])[::-1], alone, atol=1e-4)


def test_long_texts_in_pieces(weights):
    rng = np.random.default_rng(1)
    for n in (5000, 4096, 4097, 128 * 33):
        text = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert np.allclose(q.logits_of(weights, [text], at_once=1024), q.logits_of(weights, [text]), atol=1e-4)


def test_learns_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    w = q.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r.score for r in q.score(docs, w).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    held = [i for i in truth if i in got and zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= q.KEEP_FROM) == (truth[i] == 1) for i in held)
    assert right >= 0.9 * len(held)
    kept = {r.doc_id for r in q.keep_good(docs, w).collect()}
    assert kept == {i for i, s in got.items() if s >= q.KEEP_FROM}


def test_edge_rows(spark, docs_of, weights):
    docs = docs_of([None, "", "x" * 300_000, "same", "same", (None, "é"), (3, "same")], extra=True)
    got = q.score(docs, weights).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({round(r.score, 5) for r in got if r.doc_id in (3, 4)}) == 1
    assert q.keep_good(docs, weights, at_least=0.0).count() == 7
    assert q.score(docs_of([]), weights).collect() == []
    labels = spark.createDataFrame([(2, 1), (3, None), (None, 0), (99, 0)], "doc_id long, quality int")
    w = q.train(docs, labels, held_out=None)
    assert q.logits_of(w, [b"any"])[0] > 0 and q.train(docs_of([]), labels.limit(0)).out_bias[0] > 0


def slow_logit(w, text):
    """The network by its definition: a filter is eight embedded bytes wide, chunks are 256 bytes, 128 apart."""
    padded = text + bytes(max(2, -(-len(text) // 128)) * 128 - len(text))
    embedded = [[float(x) for x in w.embed[b]] for b in padded]
    filters = np.concatenate([w.first.reshape(4, 6, -1), w.second.reshape(4, 6, -1)]).astype(float)
    active = []
    for at in range(0, len(padded), 4):
        total = w.bias.astype(float).copy()
        for k in range(8):
            if at + k < len(padded):
                for e in range(6):
                    total += embedded[at + k][e] * filters[k, e]
        active.append(np.maximum(total, 0))
    halves = [active[i : i + 32] for i in range(0, len(active), 32)]
    chunks = [np.mean(a + b, axis=0) for a, b in zip(halves, halves[1:])] + [np.mean(halves[-1], axis=0)]
    units = [np.maximum(c @ w.unit.astype(float) + w.unit_bias, 0) for c in chunks]
    pooled = [*np.max(active, axis=0), *np.max(units, axis=0)]
    return sum(a * float(b) for a, b in zip(pooled, w.out)) + float(w.out_bias[0])


def test_scores_against_the_definition(docs_of, weights):
    texts = ["", "x", "The cat sat on the mat. " * 40, "é" * 129, "a" * 256, "b" * 257]
    got = {r.doc_id: r.score for r in q.score(docs_of(texts), weights).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - 1 / (1 + np.exp(-slow_logit(weights, t.encode())))) < 1e-4, i


def test_batches_in_parts(weights, monkeypatch):
    texts, labels, weight = [b"abc " * n for n in (1, 100, 700, 30, 2)], np.array([1, 0, 1, 0, 0]), np.array([1, 2, 1, 0.5, 1])
    whole = q.gradient(weights, *q.laid_out(texts), labels, weight)
    monkeypatch.setattr(q, "_AT_ONCE", 600)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, q._batch_gradient(weights, texts, labels, weight)))


def test_repeated_labels_and_ids_train_alike(spark, docs_of):
    rows = [(i, "good text here. " * 5 if i % 2 else "## $$ ## " * 9) for i in range(40)] + [(1, "another good text"), (1, "another good text")]
    labels = [(i, i % 2) for i in range(40)] + [(3, 0), (3, 1)]
    fits = [q.train(docs_of(r), spark.createDataFrame(x, "doc_id long, quality int"), held_out=None) for r, x in ((rows, labels), (rows[::-1], labels[::-1]))]
    assert all(np.allclose(a, b) for a, b in zip(*fits))


def test_extra_columns_of_documents_do_not_clash(spark, docs_of):
    docs = docs_of(["good text here. " * 5 if i % 2 else "## $$ ## " * 9 for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    more = docs.select("*", *(F.lit(7).alias(c) for c in ("_id", "quality", "label")))
    assert all(np.allclose(a, b) for a, b in zip(q.train(docs, labels, held_out=None), q.train(more, labels.select("*", F.lit(1).alias("_id")), held_out=None)))
