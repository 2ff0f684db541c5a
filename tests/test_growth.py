"""Steps whose work follows what differs or what is asked, not the rows of a table."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gradeflow.operators import kb, lines, scoring, vectors
from gradeflow.plans import knowledge_base


def _lines(spark, copies):
    rows = spark.range(copies).select(
        F.lit("s").alias("spec_uid"), F.array(F.lit("alpha")).alias("category_path"), F.lit("d").alias("doc_name"), F.col("id").alias("chunk_no"), F.concat(F.lit("line "), F.col("id") % 3).alias("line")
    )
    return rows.union(rows.withColumn("category_path", F.array(F.lit("general_knowledge"))))


def _tax(spark):
    one = spark.range(20).select(F.lit("s").alias("spec_uid"), "id", F.array(F.lit("alpha")).alias("path"), F.lit("f").alias("feature"), F.lit("L1").alias("grade"), F.lit("").alias("condition"), F.array(F.lit("e")).alias("elements"))
    return one.withColumnRenamed("id", "row_no")


def test_records_of_equal_lines_are_made_once(spark, monkeypatch):
    seen = []
    expand = kb.expand_lines
    monkeypatch.setattr(kb, "expand_lines", lambda chunks: seen.append(chunks) or expand(chunks))
    classes = spark.createDataFrame([("d", "2")], "doc_id string, doc_class string")
    records = knowledge_base.build_records(_lines(spark, 30), _tax(spark), classes, F.array(F.lit(0.0)))
    assert sorted((r.kind, r.vectorizing_text) for r in records.collect()) == sorted((k, f"line {i}") for k in ("classification", "general_knowledge") for i in range(3))
    assert seen[0].count() == 3


def test_category_texts_are_not_broadcast(spark, tmp_path, monkeypatch):
    _tax(spark).write.parquet(str(tmp_path / "tax"))
    seen = []
    expand = kb.expand_lines
    monkeypatch.setattr(kb, "expand_lines", lambda chunks: seen.append(chunks) or expand(chunks))
    classes = spark.createDataFrame([("d", "2")], "doc_id string, doc_class string")
    knowledge_base.build_records(_lines(spark, 3), spark.read.parquet(str(tmp_path / "tax")), classes, F.array(F.lit(0.0)))
    assert not re.search(r"BroadcastHashJoin \[row_no", seen[0]._jdf.queryExecution().sparkPlan().toString())


def test_scores_of_a_cell_are_bounded(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    sizes, partition = [], np.partition
    monkeypatch.setattr(vectors.np, "partition", lambda a, *more, **named: sizes.append(a.shape) or partition(a, *more, **named))
    rng, best = np.random.default_rng(3), vectors._Best(3)
    asked, known = rng.integers(-2, 3, (50, 4)).astype(float), rng.integers(-2, 3, (24, 4)).astype(float)
    best.ask(None, pa.array(range(50)), asked)
    for at in range(0, 24, 8):
        assert not list(best.meet(None, pa.array(range(at, at + 8)), known[at : at + 8]))
    got = {(q, i, s) for ids, _, own, score in best.kept() for q, i, s in zip(ids.to_pylist(), own.to_pylist(), score.to_pylist(), strict=True)}
    assert got == {(q, i, s) for q in range(50) for s, i in sorted(((float(asked[q] @ known[i]), i) for i in range(24)), key=lambda x: (-x[0], x[1]))[:3]}
    assert max(a * b for a, b in sizes) <= 64


def test_documents_become_objects_some_at_a_time(spark):
    rows = spark.range(20_000).select((F.col("id") % 2000).alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("doc_id", (F.col("i") + F.col("doc_id") % 3).alias("pos"))
    told = lambda own: [(len(own), sum(r["pos"] for r in own), __import__("sys").getallocatedblocks())]
    few = lines.by_document(rows.where("doc_id < 8"), ("pos",), told, "n long, total long, blocks long").collect()
    got = lines.by_document(rows, ("pos",), told, "n long, total long, blocks long").collect()
    assert {(r.doc_id, r.n, r.total) for r in got} == {(d, 100, 450 + 100 * (d % 3)) for d in range(2000)}
    assert max(r.blocks for r in got) - min(r.blocks for r in few) < 60_000


def test_texts_of_prompts_are_stored_once(spark, tmp_path, monkeypatch):
    kept, store = [], scoring.stored
    monkeypatch.setattr(scoring, "stored", lambda df: kept.append(df.columns) or store(df))
    docs = spark.createDataFrame([(i, None if i == 5 else f"text {i % 4}") for i in range(9)], "doc_id int, text string")
    path = str(tmp_path / "replies")
    scoring.score_resumably(docs.where("doc_id < 2"), lambda prompts: [p.upper() for p in prompts], path, "text")
    kept.clear()
    got = scoring.score_resumably(docs, lambda prompts: [p.upper() for p in prompts], path, "text").collect()
    assert {(r.doc_id, r.reply, r.error) for r in got} == {(i, None if i == 5 else f"TEXT {i % 4}", None) for i in range(9)}
    assert spark.read.parquet(path).count() == 4
    # what is asked, the replies without texts, and what is left, which is nothing
    assert kept == [["digest", "prompt"], ["digest", "reply", "error"], ["digest", "prompt"]]
