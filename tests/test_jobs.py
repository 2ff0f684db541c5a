"""Versions of collections, debounced builds, headers by counts, fuzzy removal, resumable scoring, ordinals."""

import datetime as dt
import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import grids, headings, ordinals, scoring
from gradeflow.sources import tables
from gradeflow.streaming import debounce, ingest

RECORD = "spec_uid string, kind string, text string"


def held(spark, path, version=None):
    df = tables.current_collections(spark, path, version)
    return set() if df is None else {(r.spec_uid, r.kind, r.text) for r in df.collect()}


def test_versions_link_what_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    a, b = [("a", "x", "1"), ("a", "y", "2")], [("b", "x", "3")]
    assert tables.rebuild_collections(spark.createDataFrame(a + b, RECORD), path, ["a", "b"]) == 1
    first = tables.manifest(spark, path)
    assert tables.rebuild_collections(spark.createDataFrame([("a", "x", "new"), ("c", "x", "not asked for")], RECORD), path, ["a"]) == 2
    assert held(spark, path) == {("a", "x", "new"), *b} and held(spark, path, 1) == {*a, *b}
    assert tables.manifest(spark, path)["b"] == first["b"] != tables.manifest(spark, path)["a"]

    # a rebuild that fails between its write and its switch leaves the version as it is
    monkeypatch.setattr(tables, "_created", lambda *x: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        tables.rebuild_collections(spark.createDataFrame([("a", "x", "half")], RECORD), path, ["a"])
    monkeypatch.undo()
    assert held(spark, path) == {("a", "x", "new"), *b}

    # another one takes the number meanwhile: its list is kept, not overwritten
    made, calls = tables._created, []

    def late(spark, file, text):
        if not calls:
            calls.append(1)
            tables.rebuild_collections(spark.createDataFrame([("b", "x", "other")], RECORD), path, ["b"])
        return made(spark, file, text)

    monkeypatch.setattr(tables, "_created", late)
    assert tables.rebuild_collections(spark.createDataFrame([("a", "z", "4")], RECORD), path, ["a"]) == 4
    monkeypatch.undo()
    assert held(spark, path) == {("a", "z", "4"), ("b", "x", "other")}

    # a list that was never finished is not read, and its number is not used again
    (tmp_path / "c" / "versions" / "00000005").write_text('{"a": ')
    assert tables.latest_version(spark, path) == 4 and tables.rebuild_collections(spark.createDataFrame([], RECORD), path, ["a"]) == 6
    assert held(spark, path) == {("b", "x", "other")}
    assert tables.rebuild_collections(spark.createDataFrame([], RECORD), path, ["b"]) == 7 and held(spark, path) == set()


T0 = dt.datetime(2024, 1, 1)
REQUEST = "spec_uid string, ts timestamp, n long"


def requests(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), n) for s, t, n in rows], REQUEST)


def brute_due(rows, quiet):
    out = set()
    for s in {r[0] for r in rows}:
        own = sorted((t, n) for k, t, n in rows if k == s)
        out |= {(s, n, t + quiet) for i, (t, n) in enumerate(own) if i + 1 == len(own) or own[i + 1][0] > t + quiet}
    return out


def due(df):
    return {(r.spec_uid, r.n, (r.due_at - T0).total_seconds()) for r in df.collect()}


def test_due_builds(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(5)}", rng.randrange(3000), n) for n in range(200)] + [("t", 0, 900), ("t", 60, 901), ("t", 121, 902), ("u", 5, 903), ("u", 5, 904)]
    assert due(debounce.due_builds(requests(spark, rows), 60)) == brute_due(rows, 60)
    assert debounce.due_builds(requests(spark, []), 60).collect() == []


def test_debounced_over_micro_batches(spark, tmp_path):
    # each file is a micro-batch; a request replaces one that is pending from an earlier batch
    batches = [[("a", 0, 1), ("b", 0, 2)], [("a", 50, 3)], [("a", 100, 4), ("b", 300, 5)], [("c", 2000, 6)], [("end", 9000, 7)]]
    for i, rows in enumerate(batches):
        requests(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    built = []
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    debounce.debounced(stream, lambda df: built.extend((r.spec_uid, r.n) for r in df.collect()), str(tmp_path / "cp"), quiet=60, lateness="0 seconds").awaitTermination(300)
    assert sorted(built) == [("a", 4), ("b", 2), ("b", 5), ("c", 6)]  # the last one is still pending


def test_header_by_counts(spark):
    rng = random.Random(2)
    tables_of, want = [], {}
    for t in range(12):
        rows = [["name", "size", "note"][: 3 - t % 2]] + [[rng.choice("abc") * rng.randrange(0, 3) for _ in range(3)] for _ in range(rng.randrange(2, 9))]
        tables_of += [(t, i, j, x) for i, row in enumerate(rows) for j, x in enumerate(row)]
        sim = {}
        for i, j in combinations(range(len(rows)), 2):
            both = [(x, y) for x, y in zip(rows[i], rows[j], strict=False) if x and y]
            if both:
                sim[i, j] = sum(SequenceMatcher(None, min(p), max(p)).ratio() for p in both) / len(both)
        mean = lambda keys: sum(sim[k] for k in keys) / len(keys) if keys else 0.0
        data = mean([k for k in sim if k[0] > 0])
        score = [round(data - mean([k for k in sim if k[0] == i]) + (0.5 if sum(x.isalpha() for x in rows[i]) >= 3 else 0), 9) for i in range(min(3, len(rows) - 1))]
        if max(score) > 0.3:
            want[t] = score.index(max(score))
    cells = spark.createDataFrame(tables_of, "table_id int, row int, col int, text string")
    assert {r.table_id: r.header_row for r in grids.detect_header(cells).collect()} == want and want


def test_small_tables_are_scored_without_joins(spark):
    rng = random.Random(12)
    text = lambda: rng.choice(["", " ", "a", "ab", "abc", "1", "12", "客户", None])
    rows = [(t, r, c, text()) for t in range(150) for r in range(rng.randrange(1, 9)) for c in range(rng.randrange(1, 5)) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "table_id int, row int, col int, text string")
    found = grids.detect_header(cells)
    assert "Join" not in found._jdf.queryExecution().toString()
    stripped = cells.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, grids._large_headers(stripped).collect())) and len(got) > 20
    # a large table beside them
    large = spark.range(200).select(F.lit(-1).alias("table_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.when(F.col("id") == 0, "name").otherwise("x").alias("text"))
    assert sorted(map(tuple, grids.detect_header(cells.union(large)).collect())) == [(-1, 0), *got]


def test_header_of_a_long_table(spark):
    n = 300_000
    cells = spark.range(n).select(F.lit(1).alias("table_id"), F.col("id").cast("int").alias("row"), F.posexplode(F.when(F.col("id") == 0, F.array(F.lit("city"), F.lit("kind"), F.lit("open"))).otherwise(F.array(F.concat(F.lit("c"), F.col("id") % 50), F.lit("x"), F.lit("yes")))).alias("col", "text"))
    assert [tuple(r) for r in grids.detect_header(cells).collect()] == [(1, 0)]


def test_fuzzy_removal_against_all_ratios(spark):
    rng = random.Random(3)
    line = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 14)))
    docs, tocs, want = [], [], {}
    for d in range(30):
        lines = [line() for _ in range(25)]
        toc = [x[: rng.randrange(1, 15)] + rng.choice(["", "a"]) for x in rng.choices(lines, k=8)]
        left = dict(enumerate(lines))
        for text in toc:
            scored = [(SequenceMatcher(None, text, x).ratio(), -i) for i, x in left.items()]
            if scored and (best := max(scored))[0] > 0.8:
                del left[-best[1]]
        want[d] = sorted(left)
        docs += [(d, i, x) for i, x in enumerate(lines)]
        tocs += [(d, i, x) for i, x in enumerate(toc)]
    shape = "doc_id int, pos int, line string"
    docs, tocs, want[40] = [*docs, (40, 0, "no contents")], [*tocs, (41, 0, "no lines")], [0]
    got = {}
    for r in headings.remove_similar(spark.createDataFrame(docs, shape), spark.createDataFrame(tocs, shape)).collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    assert {d: sorted(x) for d, x in got.items()} == want


def test_scoring_goes_on_behind_what_is_done(spark, tmp_path):
    calls, store, stop = str(tmp_path / "calls"), str(tmp_path / "replies"), tmp_path / "stop"
    (tmp_path / "calls").mkdir()
    flag = str(stop)

    def scorer(prompts):
        import os
        import uuid

        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        if os.path.exists(flag) and any(p == "p33" for p in prompts):
            os._exit(1)  # the worker dies, and with it the job
        if any(p == "never" for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    asked = lambda: [p for f in (tmp_path / "calls").iterdir() for p in f.read_text().split("\n")]
    rows = spark.createDataFrame([(i, f"p{i % 60}") for i in range(120)] + [(900, None)], "i int, prompt string")
    stop.write_text("")
    with pytest.raises(Exception):  # noqa: B017
        scoring.score_resumably(rows, scorer, store, batch=6).collect()
    done = {r.reply.lower() for r in spark.read.parquet(store).collect()}
    assert 0 < len(done) < 60
    before = len(asked())
    stop.unlink()
    got = scoring.score_resumably(rows, scorer, store, batch=6).collect()
    assert all(r.reply == (r.prompt and r.prompt.upper()) and r.error is None for r in got) and len(got) == 121
    again = asked()[before:]
    assert len(again) == 60 - len(done)  # none that was kept is asked again
    bad = scoring.score_resumably(spark.createDataFrame([("never",), ("p1",)], "prompt string"), scorer, store, tries=2).collect()
    assert {r.prompt: (r.reply, r.error) for r in bad} == {"never": (None, "ValueError: no"), "p1": ("P1", None)}


def test_ordinals(spark):
    rows = spark.createDataFrame([(i // 7, i, f"x{i}") for i in range(50)], "b int, i int, t string").repartition(5)
    assert [(r.i, r.no) for r in ordinals.with_ordinal(rows, ["b"], ["i"], "no").orderBy("i").collect()] == [(i, i) for i in range(50)]
    assert ordinals.with_ordinal(rows.limit(0), ["b"], ["i"], "no").collect() == []
    assert "SinglePartition" not in ordinals.with_ordinal(rows, ["b"], ["i"], "no")._jdf.queryExecution().executedPlan().toString()


def test_a_batch_that_is_logged_stays(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("chunks", "status", "cp")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# T\nfoo")
    ingest.ingest(ingest.new_texts(spark, str(tmp_path / "docs")), *where).awaitTermination(120)
    made = sorted(spark.read.parquet(where[0]).inputFiles())
    # the checkpoint is lost: the same batch comes again, and its files stay as they are
    ingest.ingest(ingest.new_texts(spark, str(tmp_path / "docs")), where[0], where[1], str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(spark.read.parquet(where[0]).inputFiles()) == made
    assert [tuple(r) for r in spark.read.parquet(f"{where[1]}-log").select("batch", "n_docs").collect()] == [(0, 1)]


def test_equal_lines_are_removed_by_look_up(spark, monkeypatch):
    shape = "doc_id int, pos int, line string"
    texts = ["a b", "a b", "", "c", "a b"]
    docs = spark.createDataFrame([(d, i, x) for d in range(3) for i, x in enumerate(texts)], shape)
    toc = spark.createDataFrame([(d, i, x) for d in range(2) for i, x in enumerate(["a b", "", "a b"])], shape)
    got = headings.remove_similar(docs, toc)
    assert sorted((r.doc_id, r.pos) for r in got.collect()) == [(0, 3), (0, 4), (1, 3), (1, 4), *((2, i) for i in range(5))]
    assert "InPandas" not in got._jdf.queryExecution().toString()
