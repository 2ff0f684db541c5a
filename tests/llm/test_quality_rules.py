import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gradeflow.llm.quality_rules import FEATURES, Condition, Rule, apply_rules, cover, learn, least_share, statistics

TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g h", "w " * 500, "x\ny\nx\n \nx\n\t\n", "# * $ %% &|<>", "é　word 😀 x\x0by\x0cz\r\nq",
    "the same line here\n" * 40, "long " * 20_000, "AB CD",
]


def brute(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


@pytest.mark.parametrize("extra", [False, True])
def test_statistics_against_brute_force(docs_of, extra):
    rng = random.Random(4)
    texts = [*TEXTS, *[" ".join(rng.choice("ab") for _ in range(rng.randint(9, 60))) for _ in range(30)]]
    got = apply_rules(statistics(docs_of(texts, extra)), []).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: brute(t) for i, t in enumerate(texts)}
    assert all(r.kept is (not r.base_failed) for r in got)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = apply_rules(statistics(docs), []).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {r.doc_id: brute(r.text) for r in docs.collect()}


def cells_of(spark, rows):
    return spark.createDataFrame([(*cell, grow, low, high) for cell, grow, low, high in rows], ", ".join(f"{f} int" for f in FEATURES) + ", grow boolean, low long, high long")


def test_covering_finds_a_conjunction(spark):
    cells = [((a, b, 0, 0, 0, 0, 0), grow, 10 if a > 1 and b <= 0 else 0, 0 if a > 1 and b <= 0 else 10) for a in range(4) for b in range(3) for grow in (True, False)]
    rules = cover(cells_of(spark, cells), [[0.1, 0.2, 0.3], [5.0, 6.0], [], [], [], [], []])
    assert [set(r.conditions) for r in rules] == [{Condition("word_length", True, 0.2), Condition("symbol_share", False, 5.0)}]
    assert cover(cells_of(spark, [((0,) * 7, True, 5, 5), ((0,) * 7, False, 5, 5)]), [[1.0]] * 7) == []


def brute_cover(rows, borders):
    """Sequential covering over single rows (bins, grow, low), by the definition."""
    rules, test = [], lambda r, t: (r[0][t[0]] > t[2]) == t[1]
    while True:
        tests, live = [], [r for r in rows if r[1]]
        while True:
            p0 = sum(r[2] for r in live)
            best, found = 1e-9, None
            for t in [(f, above, k) for f, b in enumerate(borders) for k in range(len(b)) for above in (False, True)]:
                own = [r for r in live if test(r, t)]
                a = sum(r[2] for r in own)
                if 0 < p0 < len(live) and a and (gain := a * (math.log2(a / len(own)) - math.log2(p0 / len(live)))) > best:
                    best, found = gain, t
            if not found:
                break
            tests.append(found)
            live = [r for r in live if test(r, found)]
        worth, parts = [], []
        for i in range(1, len(tests) + 1):
            own = [r for r in rows if all(test(r, t) for t in tests[:i])]
            prune = [r[2] for r in own if not r[1]]
            worth.append((2 * sum(prune) - len(prune)) / len(prune) if prune else -1.0)
            parts.append((own, prune))
        if not tests:
            return rules
        i = worth.index(max(worth))
        own, prune = parts[i]
        if sum(r[2] for r in own) < 0.9 * len(own) or sum(prune) < 0.9 * len(prune) or least_share(sum(prune), len(prune) - sum(prune)) < 0.6:
            return rules
        rules.append(Rule(tuple(Condition(FEATURES[f], above, borders[f][k]) for f, above, k in tests[: i + 1])))
        rows = [r for r in rows if not all(test(r, t) for t in tests[: i + 1])]


def test_covering_against_brute_force(spark):
    rng = random.Random(5)
    borders = [[float(k) for k in range(3)], [0.5, 1.5], [1.0], [], [], [], []]
    for _ in range(2):
        rows = []
        for _ in range(600):
            bins = (rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 1), 0, 0, 0, 0)
            low = rng.random() < (0.98 if bins[0] == 3 or bins[1] == 0 and bins[2] == 1 else 0.05)
            rows.append((bins, rng.random() < 0.66, int(low)))
        want = brute_cover(rows, borders)
        assert want and cover(cells_of(spark, [(b, g, n, 1 - n) for b, g, n in rows]), borders) == want


def test_first_rule_decides(docs_of):
    stats = statistics(docs_of(["$ word " * 30 + "tail", "plain words only in this text " * 1 + " ".join(map(str, range(40)))]))
    keep, drop = Rule((Condition("symbol_share", True, 0.1),), keep=True), Rule((Condition("word_length", True, 0.0),))
    kept = {r.doc_id: r.kept for r in apply_rules(stats.withColumn("n_repeat_words", F.lit(0).cast("long")), [keep, drop]).collect()}
    assert kept == {0: True, 1: False}


def test_learns_from_labels(spark, docs_of):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = statistics(docs)
    rules = learn(stats, labels)
    got = apply_rules(stats, rules).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0))
    # an id with both labels has the low one, in whatever order they come
    twice = labels.where("doc_id % 9 = 0").withColumn("quality", F.lit(0))
    low = labels.withColumn("quality", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("quality")))
    assert learn(stats, labels.unionByName(twice)) == learn(stats, twice.unionByName(labels)) == learn(stats, low)
    assert learn(stats, labels.where("quality = 1")) == [] and learn(stats.limit(0), labels) == []
    assert apply_rules(statistics(docs_of([])), rules).collect() == []
