import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gradeflow.operators import lexical, matching, recognition, vectors
from gradeflow.plans import interpret


def test_bm25_against_definition(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(0, 12))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    queries = spark.createDataFrame([(0, "alpha beta beta"), (1, "zeta"), (2, "")], "query_id int, text string")
    words = [t.split() for t in texts]
    n, avg = len(words), sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: r if r >= 0 else 0.25 * mean for w, r in raw.items()}
    want = {}
    for i, ws in enumerate(words):
        tf = Counter(ws)
        s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in ("alpha", "beta", "beta") if tf[w])
        if s > 0:
            want[i] = round(s, 6)
    posted = lexical.postings(docs)
    got = lexical.bm25_topk(posted, lexical.corpus_figures(docs, posted), queries, k=5).collect()
    top = sorted(want, key=lambda i: (-want[i], i))[:5]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rk)] == top and all(abs(r.score - want[r.doc_id]) < 2e-6 for r in got)
    three = {r.doc_id for r in lexical.bm25_topk(posted, lexical.corpus_figures(docs, posted), queries, k=3).collect()}
    assert three <= {r.doc_id for r in got}


def test_blocked_search_equals_expressions(spark):
    rng = np.random.default_rng(0)
    vec = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 8)))], "vec_id int, embedding array<double>")
    asked = vec.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"))
    many = {tuple(r) for r in vectors.ip_topk(vec, asked, 3).collect()}
    few = {tuple(r) for r in vectors.ip_topk(vec, asked.where("q_id < 60"), 3).collect()}
    assert few == {t for t in many if t[0] < 60} and len(many) == 450


def test_cosine_and_embed(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0]
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "i int, t string")
    cache = spark.createDataFrame([("900150983cd24fb0d6963f7d28e17f72", [9.0])], "text_md5 string, vector array<double>")
    got = {r.i: r.vector for r in vectors.embed(df, "t", lambda xs: [[float(len(x))] for x in xs], cache=cache).collect()}
    assert got == {1: [9.0], 2: [9.0], 3: [0.0]}


def test_match_elements(spark):
    rows = [(1, "user name", ["username", "user names", "phone"], 0.5, 2), (2, "phone", ["phone"], 0.0, 1), (3, "q", ["a", "b"], 1.1, 5)]
    requests = spark.createDataFrame(rows, "request_id int, elementName string, elementNames array<string>, similarityThreshold double, maxResults int")
    got = {(r.request_id, r.rk): r.name for r in matching.match_elements(requests, 0.5, 0.5).collect()}
    assert got[1, 1] == "username" and got[2, 1] == "phone" and not any(k[0] == 3 for k in got)
    same = spark.createDataFrame([(1, 0, "alpha", "alpha x1"), (1, 1, "alpha", "alpha x2"), (2, 0, "", "b")], "request_id int, candidate_no int, query string, candidate string")
    assert {(r.request_id, r.candidate_no): r.bm25 for r in matching.bm25_among(same).collect()} == {(1, 0): 1.0, (1, 1): 1.0, (2, 0): 0.0}


REQUEST = "request_id int, spec_uids array<string>, tableName string, tableComment string, dbName string, fields array<struct<fieldName:string,fieldComment:string>>"


def test_recognition(spark):
    requests = spark.createDataFrame([(1, ["s"], "t_user", "用户（表）", "crm", [("nm", "姓名"), ("zz", "")]), (2, ["x"], "t", "", "", []), (3, [], "t", "", "", [])], REQUEST)
    good, bad = recognition.gate(requests, spark.createDataFrame([("s",)], "spec_uid string"))
    assert [r.request_id for r in good.collect()] == [1] and {r.request_id: r.reason for r in bad.collect()} == {2: "no such specification", 3: "no specification given"}
    collections = spark.createDataFrame([("s", "classification"), ("s", "narrative_classification"), ("u", "general_knowledge")], "spec_uid string, kind string")
    assert {tuple(r) for r in recognition.table_collections(requests, collections).collect()} == {(1, "s", "classification"), (3, "s", "classification"), (3, "u", "general_knowledge")}
    assert {tuple(r) for r in recognition.file_collections(requests, collections).collect()} == {(1, "s", "narrative_classification")}
    assert good.select(recognition.table_sentence(good, long=False).alias("q")).first().q == "用户,姓名,zz" and good.select(recognition.table_sentence(good).alias("q")).first().q == "database:crm,用户,姓名,zz"
    found = spark.createDataFrame([(1, "bm25", 7, 7, "a", 2.0), (1, "bm25", 8, 8, "b", 3.0), (1, "vector", 7, 7, "a", 0.5), (1, "vector", 9, 9, "a", 0.4)], "request_id int, source string, row_no int, id int, text string, score double")
    numbered = recognition.number_candidates(recognition.merge_candidates(found))
    assert {(r.source, r.row_no): r.number for r in numbered.collect()} == {("bm25", 8): 1, ("bm25", 7): 2, ("vector", 7): 3}
    tax = spark.createDataFrame([(7, ["客户", "身份"], "第1级/第2级", ["姓名", "电话"]), (8, ["网络"], "L1", ["ip"])], "row_no int, path array<string>, grade string, elements array<string>")
    resolved = recognition.resolve(recognition.choose(numbered), tax)
    assert [(r.category, r.grade) for r in resolved.collect()] == [("身份", "第2级")]
    mapped = recognition.map_fields(good, resolved)
    assert [tuple(r) for r in mapped.collect()] == [(1, 0, "姓名", 1.0)]
    assert recognition.recognized(good, resolved, mapped).first().fieldElements[0].element == "姓名"
    prompted = recognition.prompts(numbered, good, recognition.table_sentence(good), "Choose.")
    assert "2. a" in prompted.first().prompt
    asked = lambda reply: [tuple(r) for r in recognition.choose(numbered, prompted, lambda ps: [reply] * len(ps)).collect()]
    assert asked("1, fits") == [(1, 8, "fits")] and asked("-1,none") == [] and asked("9,x") == []
    assert [r.row_no for r in recognition.classify_fields(good, tax, numbered).collect()] == []


def test_numbering(spark):
    rows = spark.createDataFrame([(0, ["甲", "a"]), (1, ["甲", "b"]), (2, ["乙", "a"]), (3, ["甲", "a"]), (4, ["甲", ""])], "row_no int, cells array<string>")
    numbered = interpret.number_levels(rows, 2)
    assert {r.row_no: r.p for r in numbered.select("row_no", interpret.coded_path().alias("p")).collect()} == {0: ["A 甲", "A1 a"], 1: ["A 甲", "A2 b"], 2: ["B 乙", "B1 a"], 3: ["A 甲", "A1 a"], 4: ["A 甲", ""]}
    got = [r.x for r in spark.range(1, 800).orderBy("id").select(interpret.letters(F.col("id")).alias("x")).collect()]
    assert got[0] == "A" and got[25:28] == ["Z", "AA", "AB"] and got[701:703] == ["ZZ", "AAA"]
    names = interpret.replacements(numbered)
    assert {r.original: r.coded for r in names.collect()} == {"甲": "A 甲", "乙": "B 乙", "a": "A1 a", "b": "A2 b"}
    cells = spark.createDataFrame([(0, "甲、x乙y、z"), (1, "b"), (2, None), (3, "q")], "row int, text string")
    assert {r.row: r.text for r in interpret.replace_names(cells, names).collect()} == {0: "A 甲、xB 乙y、z", 1: "A2 b", 2: None, 3: "q"}


def test_interpretation(spark, tmp_path):
    bad = spark.createDataFrame([("Sheet1", 0, "一级分类"), ("Sheet1", 1, "对应特征"), ("Sheet2", 0, "类别"), ("Sheet2", 1, "范围")], "sheet string, col int, text string")
    assert [(r.sheet, r.col) for r in interpret.validate(bad).collect()] == [("Sheet2", 1)]
    rows = spark.createDataFrame([(0, "A 客户", 0), (0, "A1 用户资料", 1), (0, "A1-1 用户身份资料信息全集", 2)], "row_no int, text string, col int")
    assert [tuple(r) for r in interpret.code_queries(rows).collect()] == [(0, "A1 用户资料；A1-1 用户身份资料信息全", "A1-1")]
    want = spark.createDataFrame([(1, "Z7"), (2, "C1-2"), (3, "W1"), (4, "Q1")], "row_no int, last_code string")
    found = [(1, 0, "Z W9 网络", "L2"), (1, 1, "W1 x", "L1"), (2, 0, "C1-2 服务（甲）", "L3"), (2, 1, "C1-2 y", "L1"), (2, 2, "C9 z", "L9"), (3, 0, "Z W9 网络", "L2"), (4, 0, "A1 n", "L1")]
    got = {r.row_no: (r.grade, r.condition, r.tier) for r in interpret.resolve_grades(want, spark.createDataFrame(found, "row_no int, pos int, text string, grade string")).collect()}
    assert got == {1: ("L2", "", 2), 2: ("L3/L1", "甲", 1), 3: ("L2", "", 3), 4: ("", "", None)}
    texts = spark.createDataFrame([("客户信息包括：姓名、电话号码，住址和其他",), ("甲（乙、丙）、丁等",), (None,)], "f string").select(interpret.feature_elements(F.col("f")).alias("e"))
    assert [r.e for r in texts.collect()] == [["姓名", "电话号码", "住址"], ["甲（乙、丙）", "丁"], []]
    finer = interpret.finer_categories(spark.createDataFrame([(["a"], "G6-5 网络;G6-6 主机：x"), (["b"], "plain L2")], "path array<string>, feature string"))
    assert {tuple(r.path) for r in finer.collect()} == {("a", "G6-5 网络"), ("a", "G6-6 主机"), ("b",)}
    good, rejects = interpret.recover_errors(spark.createDataFrame([("ERROR x 原始内容: abc",), ("ERROR y",), ("fine",)], "value string"))
    assert {r.value for r in good.collect()} == {"abc", "fine"} and rejects.count() == 1
    sheet = spark.createDataFrame([(0, ["甲", "子"], "姓名、电话"), (1, ["乙", "丑"], "x")], "row_no int, cells array<string>, feature string")
    candidates = spark.createDataFrame([(0, 0, "A1 y", "第2级")], "row_no int, pos int, text string, grade string")
    tables = {"sheet1": sheet, "candidates": candidates}
    final = interpret.interpret(spark, tables, str(tmp_path))["final"]
    assert {tuple(r.path): (r.grade, r.elements) for r in final.collect()} == {("A 甲", "A1 子"): ("第2级", ["姓名", "电话"]), ("B 乙", "B1 丑"): ("", ["x"])}
    again = interpret.interpret(spark, {}, str(tmp_path), from_step="final")["final"]
    assert again.count() == 2


def test_bm25_among_shared_lists(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) for _ in range(n))
    requests = spark.createDataFrame([(i, i % 3, text(rng.randrange(0, 9))) for i in range(40)], "request_id int, list_id int, query string")
    items = spark.createDataFrame([(k, c, text(rng.randrange(0, 9)) if k < 2 else "") for k in range(3) for c in range(7)], "list_id int, candidate_no int, candidate string")
    shared = matching.bm25_among_lists(requests, items)
    own = matching.bm25_among(requests.join(items, "list_id"))
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, own.collect())) and shared.count() == 280
    # requests stay where they lie
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ResolvedHint") == 0 and plan.count("strategy=broadcast") == 2
