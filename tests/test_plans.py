"""Blocked search against brute force, BM25 within collections, recognition with a scorer, paths, files and trigger spans."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import lexical, recognition, taxonomy, vectors
from gradeflow.plans import interpret, recognise
from gradeflow.sources import documents, tables
from gradeflow.streaming import triggers


@pytest.mark.parametrize("block, part", [(1024, 8), (3, 2), (2, 1)])
def test_blocked_search(spark, monkeypatch, block, part):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "SLAB", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), i % 2) for i in range(40)] + [(40, None, 0)]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = vec.where("vec_id < 9").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"), "label")
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6)
    for by in (None, "label"):
        want = set()
        for q, qv, ql in rows[:9]:
            scored = sorted((-dot(qv, v), i) for i, v, label in rows[:40] if by is None or label == ql)[:5]
            want |= {(q, i, -s, k + 1) for k, (s, i) in enumerate(scored)}
        assert {(r.q_id, r.vec_id, r.ip, r.rk) for r in vectors.ip_topk(vec, asked, 5, by=by).collect()} == want
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    pairs = {(a, b): round(float(unit(x) @ unit(y)), 6) for a, x, _ in rows[:40] for b, y, _ in rows[:40] if a < b}
    got = {(r.a_id, r.b_id): r.cos for r in vectors.pairs_above(vec, 0.5).collect()}
    assert got.keys() == {k for k, c in pairs.items() if c >= 0.5} and all(abs(got[k] - pairs[k]) < 2e-6 for k in got)
    assert vectors.ip_topk(vec, asked.limit(0), 3).collect() == [] and vectors.ip_topk(vec.limit(0), asked, 3).collect() == []


def test_many_queries_stay_off_the_driver(spark):
    rng = np.random.default_rng(2)
    vec = spark.createDataFrame([(i, rng.normal(size=8).tolist(), f"g{i % 30}") for i in range(3000)], "vec_id long, embedding array<float>, c string")
    asked = spark.range(50_000).select(F.col("id").alias("q_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.rand(3).cast("float")).alias("q_vector"), F.concat(F.lit("g"), F.col("id") % 40).alias("c"))
    asked = spark.createDataFrame(asked.toPandas(), asked.schema)  # random numbers are drawn once
    few, many = vectors.ip_topk(vec, asked.where("q_id < 1000"), 2, by="c"), vectors.ip_topk(vec, asked, 2, by="c")
    size = lambda df: df._jdf.queryExecution().toString().count("\n")
    assert abs(size(few) - size(many)) <= 2
    assert many.count() == 2 * asked.where("cast(substr(c, 2) as int) < 30").count()
    assert few.exceptAll(many).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_hash_embedding_against_its_definition(spark, n):
    import hashlib

    texts = ["", "a", "ab", "abc", "abcabc", "été 語😀", "x" * 300, "the cat sat on the mat"]
    want = {}
    for t in texts:
        for g in [t[i : i + n] for i in range(max(1, len(t) - n + 1))] if t else []:
            h = hashlib.md5(g.encode()).hexdigest()
            key = hashlib.md5(t.encode()).hexdigest(), int(h[:7], 16) % 64
            want[key] = want.get(key, 0) + (1 if h[7] < "8" else -1)
    got = vectors.hash_embed(spark.createDataFrame([(t,) for t in [*texts, None, "abc"]], "text string"), n=n).collect()
    assert {(r.text_md5, r.dim): r.weight for r in got} == {k: v for k, v in want.items() if v}


def test_bm25_within_collections(spark):
    rows = [("x", 1, "red apple"), ("x", 2, "green apple pie"), ("x", 3, "plain bread"), ("y", 4, "red car"), ("y", 5, "blue boat at sea"), ("y", 6, "green tree"), ("y", 8, "old stone")]
    docs = spark.createDataFrame(rows, "c string, id long, text string")
    asked = spark.createDataFrame([("x", 7, "red apple"), ("y", 7, "red apple")], "c string, query_id long, text string")
    posted = lexical.postings(docs, "id", by="c")
    got = {(r.c, r.doc_id): r.score for r in lexical.bm25_topk(posted, lexical.corpus_figures(docs, posted, "c"), asked, by="c").collect()}
    for c in "xy":
        own = docs.where(F.col("c") == c)
        alone = lexical.postings(own, "id")
        want = {(c, r.doc_id): r.score for r in lexical.bm25_topk(alone, lexical.corpus_figures(own, alone), asked.where(F.col("c") == c)).collect()}
        assert {k: v for k, v in got.items() if k[0] == c} == want and want


def test_recognition_with_a_scorer(spark):
    tax = spark.createDataFrame([(1, ["客户", "联系"], "第1级/第3级", ["phone number", "email"]), (2, ["设备", "型号"], "第2级", ["serial"])], "row_no long, path array<string>, grade string, elements array<string>")
    records = vectors.vectors_of(spark.createDataFrame([("s", "classification", 1, "customer phone number"), ("s", "classification", 2, "device serial"), ("t", "classification", 2, "other spec")], "spec_uid string, kind string, row_no long, text string"), "text")
    field = "fields array<struct<fieldName:string,fieldComment:string>>"
    requests = spark.createDataFrame([("q", ["s"], "t1", "customer phone", [("tel", "phone number"), ("zz", "")]), ("r", ["none"], "t2", "device", [])], f"request_id string, spec_uids array<string>, tableName string, tableComment string, {field}")
    resolved, mapped = recognise.recognise_tables(requests, records, tax)
    assert [(r.request_id, r.category, r.grade) for r in resolved.collect()] == [("q", "联系", "第3级")]
    assert [(r.field_no, r.element, r.score) for r in mapped.collect()] == [(0, "phone number", 1.0)]
    second = lambda prompts: ["<think>hm</think>\n\n2, because" if "Candidates:\n1. " in p else "-1" for p in prompts]
    resolved, _ = recognise.recognise_tables(requests, records, tax, scorer=second)
    assert [(r.request_id, r.row_no, r.reason) for r in resolved.collect()] == [("q", 2, "because")]
    files = spark.createDataFrame([("f", ["s"], "a.md", "# device serial\n\nnumber list")], "request_id string, spec_uids array<string>, name string, text string")
    assert [(r.request_id, r.row_no, r.grade) for r in recognise.recognise_files(files, records, tax).collect()] == [("f", 2, "第2级")]
    assert recognition.DEPTH == 15


def test_paths_below_an_unmatched_directory_are_left_out(spark):
    tax = spark.createDataFrame([(1, ["客户资料", "联系方式"]), (2, ["设备", "型号"])], "row_no long, path array<string>")
    paths = spark.createDataFrame([(["客户资料", "联系方式"],), (["unknown", "联系方式"],), (["设备"],), ([],)], "category_path array<string>")
    got = {r.key: r.row_no for r in taxonomy.match_paths(paths, tax).collect()}
    assert got == {taxonomy.SEPARATOR.join(["客户资料", "联系方式"]): 1, "设备": 2}


def test_files_by_encoding_and_line(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes("k,v\n1,été\n".encode())
    (tmp_path / "csv" / "b.csv").write_bytes("k,v\n2,été\n".encode("latin-1"))
    assert {r.record for r in documents.csv_records(spark, str(tmp_path / "csv")).collect()} == {'{"k":"1","v":"été"}', '{"k":"2","v":"été"}'}
    (tmp_path / "csv" / "c.csv").write_bytes('k,v,k\n3,"客,户\n""资""",x,more\n\n4\n'.encode("gbk"))
    (tmp_path / "csv" / "d.csv").write_bytes(b"")
    (tmp_path / "csv" / "e.csv").write_bytes("\ufeffk,v\n5,\n".encode())
    assert {r.record for r in documents.csv_records(spark, str(tmp_path / "csv")).collect()} == {'{"k":"1","v":"été"}', '{"k":"2","v":"été"}', '{"k0":"3","v":"客,户\\n\\"资\\"","k2":"x"}', '{"k0":"4","v":"","k2":""}', '{"k":"5","v":""}'}
    folder = tmp_path / "c(h)u.n+ks" / "甲" / "乙"
    folder.mkdir(parents=True)
    (folder / "d.md").write_text("one\n\n  three \n")
    got = tables.read_chunk_files(spark, str(tmp_path / "c(h)u.n+ks")).collect()
    assert [(r.doc_name, r.line_no, r.line) for r in got] == [("d.md", 1, "one"), ("d.md", 3, "three")]


def test_letters_and_repeated_cells(spark):
    got = {r.n: r.x for r in spark.createDataFrame([(1,), (26,), (27,), (18278,), (18279,), (475254,), (475255,)], "n long").select("n", interpret.letters(F.col("n")).alias("x")).collect()}
    assert got == {1: "A", 26: "Z", 27: "AA", 18278: "ZZZ", 18279: "AAAA", 475254: "ZZZZ", 475255: "AAAAA"}
    cells = spark.createDataFrame([("x、y",), ("x、y",), ("z",), (None,), (None,)], "text string")
    names = spark.createDataFrame([("x", "A1 x")], "original string, coded string")
    assert sorted((r.text for r in interpret.replace_names(cells, names).collect()), key=repr) == sorted(["A1 x、y", "A1 x、y", "z", None, None], key=repr)


def brute_trigger(calls, timeout):
    out, by = [], {}
    for spec, kind, ts, n in calls:
        by.setdefault(spec, []).append((ts, n, kind))
    end = max(c[2] for c in calls)
    wait = dt.timedelta(seconds=timeout)
    for spec, own in by.items():
        seen, last = set(), None
        for ts, _, kind in sorted(own):
            if seen == {"classification"} and ts > last + wait:
                out.append((spec, last + wait, "timeout"))
                seen = set()
            seen, last = seen | {kind}, ts
            if len(seen) == 2:
                out.append((spec, ts, "both"))
                seen = set()
        if seen == {"classification"} and end > last + wait:
            out.append((spec, last + wait, "timeout"))
    return sorted(out)


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_trigger_spans_against_brute_force(spark, span):
    rng = random.Random(span)
    at = dt.datetime(2024, 1, 1)
    calls = [(f"s{rng.randint(0, 2)}", rng.choice(["classification", "classification", "data_element"]), at + dt.timedelta(seconds=rng.randint(0, 6000)), n) for n in range(150)]
    df = spark.createDataFrame(calls, "spec_uid string, kind string, ts timestamp, n long")
    assert sorted((r.spec_uid, r.fired_at, r.reason) for r in triggers.trigger_batch(df, span=span).collect()) == brute_trigger(calls, 120)
