"""Search over segments against scoring all documents."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeflow.functions.text import tokens
from gradeflow.operators import lexical, postings


@pytest.fixture(params=[(4096, 2_000_000, 200_000, 1024), (7, 60, 200_000, 1024), (16, 10**6, 3, 5)], ids=["one segment", "many segments", "many queries"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(postings, "FEW_TOKENS", request.param[2])
    for name, value in zip(("DOCS", "WORDS", "_", "QUERIES"), request.param, strict=True):
        if name == "_":
            continue
        monkeypatch.setattr(postings, name, value)


def corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(["common"] * (i % 7 + 1) + rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randrange(1, 30))) for i in range(n)]
    docs = spark.createDataFrame([*enumerate(texts), (n, None), (n + 1, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(["common", "common", "nowhere", *words], k=rng.randrange(1, 9)))) for i in range(25)] + [(90, "common"), (91, None), (92, "nowhere")], "query_id long, text string")
    return docs, asked


@pytest.mark.parametrize("k", [1, 5, 400])
def test_equals_scoring_every_document(spark, tmp_path, sizes, k):
    docs, asked = corpus(spark)
    index = postings.build(docs, str(tmp_path / "index"))
    posted = lexical.postings(docs)
    want = lexical.bm25_topk(posted, lexical.corpus_figures(docs, posted), asked, k)
    rows = lambda df: sorted((r.query_id, r.rk, r.doc_id, round(r.score, 5)) for r in df.collect())
    assert rows(postings.topk(index, asked, k)) == rows(want)


def test_all_idf_low(spark, tmp_path, sizes):
    docs = spark.createDataFrame([(i, "a1 b1" + " c1" * (i % 3)) for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a1 c1"), (2, "a1")], "query_id long, text string")
    index, posted = postings.build(docs, str(tmp_path / "index")), lexical.postings(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(postings.topk(index, asked, 5)) == rows(lexical.bm25_topk(posted, lexical.corpus_figures(docs, posted), asked, 5))


def test_hopeless_segments_are_left_out():
    queries = [("q", ["rare", "common"], [2.0, 0.1])]
    searcher = postings._Searcher(queries, 2)
    segment = lambda docs, names, df, places, shares: (docs, names, np.array(df), np.array([shares[sum(df[:i])] for i in range(len(df))]), np.array(places, np.int32).tobytes(), np.array(shares).tobytes())
    assert list(searcher.search(*segment([1, 2, 3], ["rare", "common"], [2, 3], [1, 0, 2, 1, 0], [2.0, 1.0, 2.0, 1.0, 0.5]))) == [("q", 1, 2.05), ("q", 2, 4.1)]
    assert list(searcher.search(*segment([4], ["common"], [1], [0], [2.0]))) == []  # 0.2 at most
    assert list(searcher.search(*segment([5], ["rare"], [1], [0], [1.025]))) == [("q", 5, 2.05)]  # an equal score may count by its id


def test_an_index_serves_one_state_of_a_table(spark, tmp_path):
    docs, asked = corpus(spark, 50)
    source = str(tmp_path / "documents.parquet")
    docs.write.parquet(source)
    first = postings.index_of(spark, source)
    again = postings.index_of(spark, source)
    assert first.segments.inputFiles() == again.segments.inputFiles()
    docs.limit(10).write.mode("append").parquet(source)
    assert postings.index_of(spark, source).segments.inputFiles() != first.segments.inputFiles()


def test_empty_corpus(spark, tmp_path):
    docs, asked = corpus(spark, 3)
    index = postings.build(docs.limit(0), str(tmp_path / "index"))
    assert postings.topk(index, asked, 3).collect() == []


def test_tokens_are_those_of_the_expression(spark):
    texts = ["", "a", "ab c", "AbC-9x y1", "ab", "cd ef", "北", "北京", "北京市x1上海 abc", "京", "海", "Kelvin İstanbul naïve", "㐀㐁 鿿鿾鿿ꀀ", "\U0001f600ok", "䷿一丁", "Straße ÉCOLE x²", "北a1京", "tab\tnew\nline", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", tokens(F.col("text")).alias("w"))
    want = [sorted(r.w or []) for r in frame.orderBy("doc_id").collect()]
    for part in (pa.array([t or "" for t in texts]), pa.array(["zz", *(t or "" for t in texts)]).slice(1), pa.array([t or "" for t in texts], pa.large_string())):
        words, place = postings._tokens(part)
        got = [[] for _ in texts]
        for w, i in zip(words.to_pylist(), place.tolist(), strict=True):
            got[i].append(w)
        assert [sorted(x) for x in got] == want


def test_a_segment_holds_no_word_lists_and_few_bytes_a_posting(spark, tmp_path):
    docs, _ = corpus(spark)
    index = postings.build(docs, str(tmp_path / "index"))
    row = index.segments.agg(F.sum(F.length("places") + F.length("tf")).alias("bytes"), F.sum(F.aggregate("df", F.lit(0).cast("long"), lambda a, x: a + x)).alias("postings")).first()
    assert row.bytes <= 3 * row.postings
    assert not (tmp_path / "index" / "counts").exists()


def test_texts_are_read_in_pieces(spark, monkeypatch):
    docs, _ = corpus(spark)
    read, seen = postings._tokens, []
    monkeypatch.setattr(postings, "PIECE", 100)
    monkeypatch.setattr(postings, "_tokens", lambda texts: seen.append(sum(len(t) for t in texts.to_pylist())) or read(texts))
    rows = docs.select("doc_id", F.coalesce("text", F.lit(""))).toArrow().combine_chunks().to_batches()
    got = list(postings._segments(iter(rows)))
    assert len(seen) > 50 and max(seen) < 400
    assert sum(b["n"][0].as_py() for b in got) == 302
    monkeypatch.undo()
    one = list(postings._segments(iter(rows)))
    assert [b.to_pydict() for b in got] == [b.to_pydict() for b in one]
