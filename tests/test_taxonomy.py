import json
import random

from pyspark.sql import functions as F

from gradeflow.operators import changes, kb, taxonomy, tree
from gradeflow.plans import knowledge_base
from gradeflow.sources import tables

TAX = "spec_uid string, row_no long, path array<string>, feature string, grade string, condition string, elements array<string>"
ROWS = [
    ("s", 1, ["A 客户", "A1 身份"], "f1", "第2级/第3级", "", ["姓名", "电话"]),
    ("s", 2, ["A 客户", "A2 账户"], "f2", "核心数据", "c", ["电话", "余额"]),
    ("s", 3, ["B 网络"], "", "", "", []),
]


def tax(spark, rows=ROWS):
    return spark.createDataFrame(rows, TAX)


def test_names_and_lookup(spark):
    got = {r.name: tuple(r.ord) for r in taxonomy.category_names(tax(spark)).collect()}
    assert got["A 客户"] == (1, 0, 0) and got["客户"] == (1, 0, 1) and got["账户"] == (2, 1, 1)
    assert {r.name for r in taxonomy.second_level_names(tax(spark)).collect()} == {"身份", "账户"}
    asked = spark.createDataFrame([("客户",), ("B 网络",), ("A2 账户",), ("none",)], "name string")
    assert {r.name: (r.row_no, r.exact) for r in taxonomy.lookup_rows(asked, tax(spark)).collect()} == {"客户": (1, False), "B 网络": (3, True), "A2 账户": (2, True)}
    more = tax(spark, [("s", 1, ["x客户"], "", "", "", []), ("s", 2, ["客户"], "", "", "", [])])
    look = lambda **k: taxonomy.lookup_rows(asked.where("name = '客户'"), more, **k).first().row_no
    assert look() == 2 and look(strict_order=True) == 1


def test_lookup_broadcasts_no_suffixes(spark):
    asked = spark.createDataFrame([("客户",), ("户",), ("户",), (None,)], "name string")
    found = taxonomy.lookup_rows(asked, tax(spark))
    assert {tuple(r) for r in found.collect()} == {("客户", 1, False), ("户", 1, False)}
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_matches(spark):
    asked = spark.createDataFrame([("客户",), ("C 网络",), ("账户表",)], "text string")
    best = {r.text: (r.name, r.score) for r in taxonomy.best_match(asked, taxonomy.category_names(tax(spark)), least=0.5).collect()}
    assert best == {"客户": ("客户", 1.0), "C 网络": ("B 网络", 0.95), "账户表": ("账户", round(2 / 3, 6))}
    rows = {(r.text, r.row_no): (r.score, r.rk) for r in taxonomy.matching_rows(asked, tax(spark)).collect()}
    assert rows["客户", 1] == (0.95, 1) and rows["客户", 2] == (0.95, 2)
    # rows of equal paths are ranked over blocks, and only paths meet the names
    many = spark.range(0, 200_000, 1000).select(F.lit("s").alias("spec_uid"), F.col("id").alias("row_no"), F.array(F.when(F.col("id") % 3000 == 0, "客户").otherwise("客户x")).alias("path"))
    found = [tuple(r) for r in taxonomy.matching_rows(asked.where("text = '客户'"), many).orderBy("rk").collect()]
    order = sorted((-1.0 if i % 3000 == 0 else -0.666667, i) for i in range(0, 200_000, 1000))
    assert found == [("客户", i, -s, k + 1) for k, (s, i) in enumerate(order)]
    assert taxonomy._matching_paths(asked.where("text = '客户'"), many, 0.5, "text").count() == 2
    assert [tuple(r) for r in taxonomy.match_directories(asked.where("text = '客户'"), many, name="text").collect()] == [("客户", 0, 1.0)]
    # all pairs give the same as blocked ones
    names = taxonomy.category_names(tax(spark))
    every = {tuple(r) for r in taxonomy.scored_names(asked, names).where("score >= 0.3").collect()}
    assert {tuple(r) for r in taxonomy.scored_names(asked, names, 0.3).collect()} == every


def test_paths(spark):
    paths = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), (["d"],), (["e", "", "f"],)], "path array<string>")
    assert {r.p: r.is_leaf for r in taxonomy.with_leaf(paths).select(taxonomy.path_text(F.col("path")).alias("p"), "is_leaf").collect()} == {"a": False, "a->b": False, "a->b->c": True, "d": True, "e": True}
    once = taxonomy.prune_non_leaf(paths)
    assert once.count() == 3 and taxonomy.prune_non_leaf(once).count() == 3
    chunks = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "c"],), (["general_knowledge"],)], "path array<string>")
    assert {tuple(r.path): r.kept for r in taxonomy.prefix_prune(chunks, paths.where("size(path) = 2")).collect()} == {("a",): True, ("a", "b"): True, ("a", "c"): False, ("general_knowledge",): True}


def test_grades_and_elements(spark):
    grades = taxonomy.distinct_grades(tax(spark))
    ranked = taxonomy.grade_priorities(grades)
    assert {r.grade: r.priority for r in ranked.collect()} == {"核心数据": 1, "第3级": 2, "第2级": 3}
    assert taxonomy.valid_priorities(ranked, grades).first().valid and not taxonomy.valid_priorities(ranked.where("priority > 1"), grades).first().valid
    assert [tuple(r) for r in taxonomy.duplicate_elements(tax(spark)).collect()] == [("电话", 2, "A1 身份")]
    scores = spark.createDataFrame([("电话", "A2 账户", 0.9)], "element string, category string, score double")
    assert taxonomy.duplicate_elements(tax(spark), scores).first().chosen == "A2 账户"
    scenes = tree.element_scenes(spark.createDataFrame([("电话", "A2 账户"), ("x", "B 网络")], "element string, category string"), tax(spark))
    assert {r.element: r.scenes for r in scenes.collect()} == {"电话": [3], "x": []}


def test_tree(spark):
    rows = [("s", 2, ["a", "b"], "n", "第2级", "", []), ("s", 1, ["a"], "m", "L1/L2", "", []), ("s", 3, ["c\"q"], "", "", "", [])]
    for order in (rows, rows[::-1]):
        out = {r.name: json.loads(r.json) for r in tree.tree_json(tree.tree_edges(tax(spark, order))).collect()}
        leaf = {"DataClassification": "b", "DataGrading": "第2级", "Annotate": "n", "SubDataClassifications": []}
        assert out["a"] == {"DataClassification": "a", "DataGrading": "L2", "Annotate": "m", "SubDataClassifications": [leaf]}
        assert out['c"q']["SubDataClassifications"] == []
    mapping = spark.createDataFrame([("A x", "x")], "coded string, original string")
    named = tree.original_names(spark.createDataFrame([("A x",), ("y",)], "name string"), mapping, "name")
    assert {r.name for r in named.collect()} == {"x", "y"}


CHANGE = "item_no long, action string, path array<string>, feature string, grade string"


def test_ordered_changes(spark):
    new = ["N"]
    batch = [(1, "create", new, "f", "g"), (2, "create", new, "x", "y"), (3, "update", new, "", "h"), (4, "delete", new, None, None), (5, "update", new, "z", "z"), (6, "update", ["B 网络"], "b", ""), (7, "delete", ["none"], "", ""), (8, "create", ["C"], "c", None)]
    replayed = changes.replay_changes(tax(spark), spark.createDataFrame(batch, CHANGE))
    assert {r.item_no: r.ok for r in changes.outcomes(replayed).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True}
    after = changes.apply_changes(tax(spark), spark.createDataFrame(batch, CHANGE))
    got = {tuple(r.path): (r.row_no, r.feature, r.grade, r.elements) for r in after.collect()}
    assert len(got) == 4 and got["B 网络",] == (3, "b", "", []) and got["C",] == (4, "c", "", []) and got["A 客户", "A1 身份"][3] == ["姓名", "电话"]
    assert [tuple(r.path) for r in changes.replace_all(tax(spark), spark.createDataFrame(batch[-1:], CHANGE)).collect()] == [("C",)]


def test_many_changes_of_one_path(spark):
    rng = random.Random(4)
    batch = [(i, rng.choice(["create", "update", "delete", "other"]), ["A 客户", "A1 身份"] if i % 2 else ["N"], rng.choice(["", None, f"f{i}"]), rng.choice(["", f"g{i}"])) for i in range(400)]
    want, states = {}, {("A 客户", "A1 身份"): [True, "f1", "第2级/第3级"], ("N",): [False, None, None]}
    for i, action, path, feature, grade in batch:
        s = states[tuple(path)]
        want[i] = not s[0] if action == "create" else s[0] if action in ("update", "delete") else False
        if want[i] and action == "delete":
            s[0] = False
        elif want[i]:
            s[:] = [True, feature or ("" if action == "create" else s[1]), grade or ("" if action == "create" else s[2])]
    replayed = changes.replay_changes(tax(spark), spark.createDataFrame(batch, CHANGE))
    assert {r.item_no: r.ok for r in changes.outcomes(replayed).collect()} == want
    assert {tuple(r.path): [r.present, r.feature, r.grade] for r in replayed.collect()} == states
    # no array of a path's items is folded, which copied the log for each of them
    assert "aggregate(" not in replayed._jdf.queryExecution().optimizedPlan().toString()


def test_element_changes(spark):
    ops = spark.createDataFrame([(1, "add", "A 客户", ["电话", "邮箱"]), (2, "delete", "A1 身份", ["姓名", "无"]), (3, "update", "B 网络", ["p", "p", "q"]), (4, "delete", "B 网络", ["p"])], "item_no long, action string, name string, elements array<string>")
    got = {r.row_no: r.elements for r in changes.apply_element_changes(tax(spark), ops).collect()}
    assert got == {1: ["电话", "邮箱"], 2: ["电话", "余额", "邮箱"], 3: ["p", "q"]}
    renamed, count = changes.rename_element(tax(spark), "电话", "手机")
    assert count.first().replaced == 2 and {r.row_no: r.elements for r in renamed.collect()}[2] == ["手机", "余额"]


def test_rows_take_no_changes_before_a_replacement(spark, monkeypatch):
    ops = [(i, "delete" if i % 2 else "add", "A 客户", [f"e{i}"]) for i in range(100)] + [(100, "update", "A 客户", ["x"]), (101, "add", "A 客户", ["y"]), (3, "add", "A1 身份", ["z"]), (102, "delete", "A1 身份", ["x"])]
    batch = spark.createDataFrame(ops, "item_no long, action string, name string, elements array<string>")
    assert {r.row_no: r.elements for r in changes.apply_element_changes(tax(spark), batch).collect()} == {1: ["y"], 2: ["x", "y"], 3: []}
    monkeypatch.setattr(changes, "element_change", lambda own, ops: F.transform(F.array_sort(ops), lambda o: o["item_no"].cast("string")))
    assert {r.row_no: r.elements for r in changes.apply_element_changes(tax(spark), batch).collect()} == {1: ["3", "100", "101", "102"], 2: ["100", "101"], 3: []}


def test_standard_lines_round_trip(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"header":{"0":"一级分类","1":"对应特征","2":"等级","3":"条件","4":"真实数据"},"data":{"0":"客户","1":"f","2":"第2级","3":"","4":["姓名","电话"]}}\nnot json\n{"header":{"0":"一级分类","1":"真实数据"},"data":{"0":"网络","1":"[]"}}\n')
    own, bad = tables.read_taxonomy(spark, str(tmp_path / "t.jsonl"), "s")
    assert [(r.row_no, r.path, r.grade, r.elements) for r in own.orderBy("row_no").collect()] == [(1, ["客户"], "第2级", ["姓名", "电话"]), (3, ["网络"], "", [])]
    assert [tuple(r) for r in bad.collect()] == [(2, "not json")]
    out = [r.value for r in tables.standard_lines(own, bad).orderBy("row_no").collect()]
    assert out[1] == "not json" and json.loads(out[0])["data"]["0"] == "客户"


def test_expand_lines(spark):
    line = '{"header":{"0":"一级分类","1":"等级","2":"真实数据"},"data":{"0":"客户","1":"第2级","2":["姓名","电话"]}}'
    got = [r.vectorizing_text for r in kb.expand_lines(spark.createDataFrame([(line,), ("plain",)], "line string")).collect()]
    assert got == [line, "客户", "姓名", "电话", "客户、姓名、电话", "plain"]


def test_build_and_rebuild(spark, tmp_path):
    chunks = [("s", ["客户", "身份"], "d1", 0, "line one"), ("s", ["客户", "身份"], "d1", 1, " "), ("s", ["账户"], "d2", 0, "line two"), ("s", ["general_knowledge"], "g", 0, "known fact"), ("s", ["general_knowledge"], "g", 1, "known fact")]
    where, out = str(tmp_path / "chunks"), str(tmp_path / "kb")
    tables.write_chunks(spark.createDataFrame(chunks, "spec_uid string, category_path array<string>, doc_name string, chunk_no int, chunk string"), where)
    classes = spark.createDataFrame([("d1", "1"), ("d2", "2")], "doc_id string, doc_class string")
    want = {"narrative_classification": 1, "classification": 1, "general_knowledge": 1, None: 3}
    for _ in range(2):
        assert {r.kind: r.n for r in knowledge_base.rebuild(spark, where, out, tax(spark), classes, ["s"]).collect()} == want
    records = {r.kind: r for r in tables.current_collections(spark, out).collect()}
    assert records["general_knowledge"].id == 200_000_001 and records["classification"].id == 1 and len(records["classification"].vector) == 64
    gone = spark.createDataFrame([("s", ["账户"], "d2"), ("s", ["账户"], "d9")], "spec_uid string, path array<string>, doc_name string")
    missing = knowledge_base.change_classification(spark, where, str(tmp_path / "chunks2"), out, tax(spark), classes, gone, ["s"])
    assert [r.doc_name for r in missing.collect()] == ["d9"]
    assert {r.kind for r in tables.current_collections(spark, out).collect()} == {"narrative_classification", "general_knowledge"}
