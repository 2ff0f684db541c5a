import pytest
from pyspark.sql import functions as F

from gradeflow.functions import grades, parsing, text
from gradeflow.functions.similarity import common_substring, name_similarity, ratio


def column(spark, values, f, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_name(spark):
    cases = {"A1-2 客户资料": "客户资料", "(Ⅰ)基础地理": "基础地理", "一、测试内容": "测试内容", "A1客户": "客户", "客户A1": "客户A1", "(abc)": "(abc)", " ": "", None: "", "a b c": "b c", "【x】y": "y", "3.1 ": "3.1", "客、": "客、"}
    assert column(spark, list(cases), text.clean_name) == list(cases.values())


def test_annotations(spark):
    cases = {"a (b) c（d）e": "a ce", "x[1]<y>{z}【q】《r》w": "xw", "name—note": "name", "k: v": "k", "键：值": "键", "a　 b": "a b", "": ""}
    assert column(spark, list(cases), text.remove_annotations) == list(cases.values())


def test_tokens_and_items(spark):
    assert column(spark, ["Hello, a World 42 客户资料表 客户 x"], text.tokens) == [["hello", "world", "42", "客户", "户资", "资料", "料表", "客户"]]
    assert column(spark, ['{"ab", "#cd", "12", "x", []}', ""], text.clean_items) == [["ab", "cd"], []]


def test_enumeration(spark):
    assert column(spark, ["甲、乙（丙、丁）、戊等", "己（庚", "、a、、b、", ""], text.split_enumeration) == [["甲", "乙（丙、丁）", "戊等"], ["己（庚"], ["a", "b"], []]
    assert column(spark, ["戊等", "己（庚", "(x", "y"], text.close_brackets) == ["戊", "己（庚）", "(x)", "y"]


def test_grades(spark):
    high = {"第2级/第3级": "第3级", "L2/L3": "L2/L3", "第2级": "第2级", "第1级/x": "第1级"}
    assert column(spark, list(high), grades.choose_grade) == list(high.values())
    assert column(spark, ["第2级/第3级"], lambda g: grades.choose_grade(g, highest=False)) == ["第2级"]
    low = {"L2/L3": "L3", "核心数据/第2级": "核心数据", "第4级/第2级/第3级": "第4级", "A/B": "A", "L3": "L3", "重要数据/核心数据": "核心数据", "": ""}
    assert column(spark, list(low), grades.lowest_grade) == list(low.values())
    assert column(spark, ["核心数据", "重要数据", "第3级"], grades.scene_type) == [3, 2, 1]


def test_parsing(spark):
    lists = {'["a","b"]': ["a", "b"], "['a', 'b']": ["a", "b"], "[]": [], "a, b、c": ["a", "b", "c"], "": [], None: [], "[broken": []}
    assert column(spark, list(lists), parsing.parse_elements) == list(lists.values())
    replies = {'["a"]': ["a"], 'so:\n```json\n["a","b"]\n```': ["a", "b"], 'text ["a", "b"] more': ["a", "b"], "none": [], 'x\n["q"]\ny [': ["q"]}
    assert column(spark, list(replies), parsing.array_from_reply) == list(replies.values())
    choices = {"3,T": (3, "T"), "候选2, T": (2, "T"), "-1,T": (-1, "T"), "<think>\nx\n</think>\n\n2,T": (2, "T"), "no": (None, "")}
    assert [tuple(r) for r in column(spark, list(choices), parsing.parse_choice)] == list(choices.values())
    parsed = column(spark, ['x {"class":"1"} y', "no"], lambda c: parsing.parse_reply_json(c, "class string"))
    assert parsed[0].value["class"] == "1" and parsed[0].error is None and parsed[1].value is None and "no" in parsed[1].error


@pytest.mark.parametrize("a, b, n", [("", "x", 0), ("abcd", "xbcy", 2), ("客户资料", "客户信息", 2), ("aaa", "aa", 2)])
def test_common_substring(a, b, n):
    assert common_substring(a, b) == common_substring(b, a) == n


def test_similarity(spark):
    rows = spark.createDataFrame([("x", "x"), ("A 客户", "B 客户"), ("客户资料", "客户信息"), ("", "")], "a string, b string")
    assert [r.s for r in rows.select(name_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.95, 0.5, 1.0]
    assert [r.s for r in rows.select(ratio("a", "b").alias("s")).collect()][2] == 0.5
