"""Automata against their definitions, and the operators that use them."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeflow.functions.automata import NameFinder, SuffixAutomaton
from gradeflow.functions.similarity import common_substring_length
from gradeflow.operators import cells, recognition
from gradeflow.plans import interpret

short = st.text("abc", max_size=9)


def lcs(a, b):
    return max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)


@settings(max_examples=300, deadline=None)
@given(st.lists(short, max_size=8, unique=True), short, st.sampled_from([0.0, 0.3, 0.7]))
def test_suffix_automaton(names, text, least):
    wanted = [k for k in range(len(names)) if k % 3 < 2]
    got = list(SuffixAutomaton(names).common(text, sum(1 << k for k in wanted), least))
    assert dict(got) == {k: n for k in wanted if (n := lcs(text, names[k])) and n >= least * len(text)}
    assert [n for _, n in got] == sorted((n for _, n in got), reverse=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(short, max_size=8), st.text("abc", max_size=30))
def test_name_finder(names, text):
    held = sorted((x for x in names if x and x in text), key=lambda x: (-len(x), x))
    assert NameFinder(names).find(text) == (held[0] if held else None)


def test_common_substring_column(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(rng.randrange(n)))
    rows = [(word(12), word(12)) for _ in range(5000)] + [(None, "a"), ("", ""), ("x" * 50_000 + "yz", "zyz"), ("ab" * 20_000, "ba" * 15_000)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", common_substring_length("a", "b").alias("n")).collect()
    assert all(r.n == lcs(r.a or "", r.b or "") for r in got if len(r.a or "") < 100)
    assert {r.n for r in got if len(r.a or "") > 100} == {2, 30_000}


def test_field_mapping_against_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))
    elements = {k: [word() if rng.random() < 0.8 else f"A{rng.randrange(5)} {word()}" for _ in range(30)] for k in range(4)}
    requests = [(i, [("f" + word(), word() if rng.random() < 0.8 else rng.choice(["", None])) for _ in range(6)]) for i in range(60)]
    asked = spark.createDataFrame(requests, "request_id long, fields array<struct<fieldName: string, fieldComment: string>>")
    resolved = spark.createDataFrame([(i, i % 4, elements[i % 4]) for i in range(50)], "request_id long, row_no int, elements array<string>")
    got = {(r.request_id, r.field_no): (r.element, r.score) for r in recognition.map_fields(asked, resolved, 0.3).collect()}
    pairs = spark.createDataFrame([(i, n, c or f, k, e) for i, fields in requests[:50] for n, (f, c) in enumerate(fields) for k, e in enumerate(elements[i % 4])], "i long, n int, text string, k int, name string")
    scored = recognition.scored_names_of(pairs).where("score >= 0.3")
    want = {(r.i, r.n): (r.b.name, r.b.score) for r in scored.groupBy("i", "n").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("k"))).alias("b")).collect()}
    assert got == want and len(got) > 100


def test_replaced_names(spark, monkeypatch):
    monkeypatch.setattr(interpret, "NAMES", 7)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, n)))
    names = {word(5): f"A{i} x" for i in range(30)}
    texts = ["、".join(f" {word(8)} " for _ in range(rng.randrange(1, 4))) for _ in range(40)] + [None, "", "丁", "丁" * 50_000 + max(names, key=len) + "丁" * 50_000]

    def part(p):
        p = p.strip()
        held = sorted((x for x in names if x in p), key=lambda x: (-len(x), x))
        return p.replace(held[0], names[held[0]]) if held else p

    got = interpret.replace_names(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), spark.createDataFrame(list(names.items()), "original string, coded string")).collect()
    assert {r.i: r.text for r in got} == {i: None if t is None else "、".join(map(part, t.split("、"))) for i, t in enumerate(texts)}
    none = interpret.replace_names(spark.createDataFrame([(1, " 甲 、乙")], "i int, text string"), spark.createDataFrame([], "original string, coded string"))
    assert [r.text for r in none.collect()] == ["甲、乙"]


def test_cells_hold_and_stream(spark):
    held = spark.createDataFrame([(k, i) for k in ("a", None, "c") for i in range(3)], "k string, v int")
    streamed = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(200)], "k string, x int")
    got = cells.meet(held, streamed, "k", F.col("x"), lambda rows: sum(v for v, in rows), lambda total, row: iter([(row[0] + total,)]), "y int").collect()
    assert sorted((r.k or "", r.y) for r in got) == sorted((k, i + 3) for k in ("", "a") for i in range(200))


@pytest.mark.parametrize("rows", [[], [("a", 1)]])
def test_empty_sides(spark, rows):
    held, streamed = spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame([], "k string, x int")
    assert cells.meet(held, streamed, "k", F.col("x"), len, lambda n, row: iter([(n,)]), "y int").collect() == []
