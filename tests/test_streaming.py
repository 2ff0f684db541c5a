import datetime as dt

from pyspark.sql import functions as F

from gradeflow.sources import tables
from gradeflow.streaming import ingest, triggers

T0 = dt.datetime(2024, 1, 1)
CALLS = [("both", "classification", 0), ("both", "data_element", 5), ("lone", "classification", 0), ("lone", "classification", 200), ("lone", "data_element", 210), ("never", "data_element", 0), ("end", "classification", 9000)]


def calls(spark):
    rows = [(s, k, T0 + dt.timedelta(seconds=t), i) for i, (s, k, t) in enumerate(CALLS)] + [("never", "data_element", T0 + dt.timedelta(hours=9), 99)]
    return spark.createDataFrame(rows, "spec_uid string, kind string, ts timestamp, n long")


def fired(df):
    return {(r.spec_uid, (r.fired_at - T0).total_seconds(), r.reason) for r in df.collect()}


WANT = {("both", 5.0, "both"), ("lone", 120.0, "timeout"), ("lone", 210.0, "both"), ("end", 9120.0, "timeout")}


def test_trigger_batch(spark):
    assert fired(triggers.trigger_batch(calls(spark))) == WANT


def test_trigger_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    calls(spark).drop("n").coalesce(1).write.parquet(src)
    spark.createDataFrame([("late", "data_element", T0 + dt.timedelta(days=3))], "spec_uid string, kind string, ts timestamp").write.mode("append").parquet(src)
    stream = triggers.trigger_stream(spark.readStream.schema("spec_uid string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert fired(spark.read.parquet(str(tmp_path / "out"))) == WANT


def test_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# T\nfoo")
    where = [str(tmp_path / x) for x in ("chunks", "status", "cp")]
    for k in range(2):
        ingest.ingest(ingest.new_texts(spark, str(tmp_path / "docs")), *where).awaitTermination(120)
        assert spark.read.parquet(where[0]).count() == 1 + k and {r.n_chunks for r in spark.read.parquet(where[1]).collect()} == {1}
        (tmp_path / "docs" / "b.md").write_text("# U\nbar")


def test_status_health_orphans(spark):
    rows = [("a", 1, T0, 0), ("a", 3, T0, 1), ("b", 7, T0, 2), ("c", None, T0, 3)]
    latest, bad = triggers.task_status(spark.createDataFrame(rows, "task_id string, state int, ts timestamp, n long"))
    assert [(r.task_id, r.state, r.meaning) for r in latest.collect()] == [("a", 3, "done")] and {r.task_id for r in bad.collect()} == {"b", "c"}
    at = lambda m: T0 + dt.timedelta(minutes=m)
    checks = [(1, "x", True, at(0)), (1, "y", False, at(0)), (2, "x", True, at(1)), (3, "x", False, at(4)), (4, "x", True, at(7))]
    got = triggers.health_rounds(spark.createDataFrame(checks, "check_id int, service string, ok boolean, ts timestamp")).orderBy("round_start").collect()
    assert [(r.healthy, r.recovered) for r in got] == [(True, True), (False, False), (True, True)]
    log = [("t", "step", at(50), 0), ("u", "completed", at(50), 1), ("v", "step", at(0), 2)]
    assert [r.task_id for r in triggers.orphan_tasks(spark.createDataFrame(log, "task_id string, line string, ts timestamp, n long"), at(60)).collect()] == ["t"]


def test_messages(spark):
    rows = spark.createDataFrame([(i, f"e{i}") for i in range(25)], "o int, e string")
    assert {r.batch_no: r.n for r in tables.batched(rows, "o").collect()} == {0: 10, 1: 10, 2: 5}
    text = spark.createDataFrame([("t", T0)], "task string, at timestamp").select(tables.envelope(F.struct(F.lit(3).alias("State")), tables.STATUS, F.col("task"), F.col("at")).alias("m")).first().m
    assert text == '{"PushContentType":0,"PushDate":"2024-01-01T00:00:00","TaskUId":"t","Value":{"State":3}}'
