"""Two-signal trigger, task status, debounced rebuilds, health rounds, orphan tasks.

Batch forms are windows and folds over event tables; stream forms keep state per key behind a watermark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.lines import by_document
from ..session import stored

#: Seconds that a lone classification call waits.
TIMEOUT = 120


#: Kinds seen since a specification last fired: none, classification, data_element.
_NONE, _CLASS, _ELEMENT = 0, 1, 2
#: Minutes of calls that are folded as one.
SPAN = 60


def _folded(ordered: Column, start: int, timeout: int) -> Column:
    """(seen, out): what a span of calls leaves if it begins with ``start`` seen, and its firings."""
    state = "struct<seen:int,last:timestamp,out:array<struct<fired_at:timestamp,reason:string>>>"
    wait = F.expr(f"interval {timeout} seconds")
    fired = lambda at, reason: F.array(F.struct(at.alias("fired_at"), F.lit(reason).alias("reason")))

    def step(s: Column, x: Column) -> Column:
        expired = F.coalesce((s["seen"] == _CLASS) & (x["ts"] > s["last"] + wait), F.lit(False))
        before = F.when(expired, F.lit(_NONE)).otherwise(s["seen"])
        own = F.when(x["kind"] == "classification", _CLASS).when(x["kind"] == "data_element", _ELEMENT).otherwise(_NONE)
        both = before + own == _CLASS + _ELEMENT
        out = F.when(expired, F.concat(s["out"], fired(s["last"] + wait, "timeout"))).otherwise(s["out"])
        return F.struct(F.when(both, _NONE).when(own == _NONE, before).otherwise(own).alias("seen"), x["ts"].alias("last"), F.when(both, F.concat(out, fired(x["ts"], "both"))).otherwise(out).alias("out")).cast(state)

    zero = F.struct(F.lit(start).alias("seen"), F.lit(None).cast("timestamp").alias("last"), F.array().cast("array<struct<fired_at:timestamp,reason:string>>").alias("out")).cast(state)
    return F.aggregate(ordered, zero, step, lambda s: F.struct(s["seen"].alias("seen"), s["out"].alias("out")))


def trigger_batch(calls: DataFrame, timeout: int = TIMEOUT, span: int = SPAN) -> DataFrame:
    """(spec_uid, fired_at, reason) of calls (spec_uid, kind, ts, n), kind being classification or data_element, n a unique
    number that orders calls of one time.

    A spec fires when both kinds have been called since it last fired, at the later call; or when only classification has and
    ``timeout`` seconds pass after the last call before another comes. Lone data_element calls never fire.

    Calls are folded by spans of some minutes in parallel, from each of the three states in which a span may begin; then the
    few numbers of each span tell in which it did. So a spec with a large share of all calls is many tasks.
    """
    opened = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * span)).alias("span")
    ordered = calls.groupBy("spec_uid", opened).agg(F.array_sort(F.collect_list(F.struct("ts", "n", "kind"))).alias("_x"))
    spans = stored(ordered.select("spec_uid", "span", F.col("_x")[0]["ts"].alias("first"), F.element_at("_x", -1)["ts"].alias("last"), *[_folded(F.col("_x"), k, timeout).alias(f"f{k}") for k in (_NONE, _CLASS, _ELEMENT)]))
    end = spans.agg(F.max("last").alias("_end"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    numbers = spans.select("spec_uid", "span", "first", "last", *[F.col(f"f{k}.seen").alias(f"s{k}") for k in (0, 1, 2)]).crossJoin(F.broadcast(end)).select("spec_uid", "span", micros("first"), micros("last"), micros("_end"), "s0", "s1", "s2")
    wait = timeout * 1_000_000

    def stitch(rows: list[dict]) -> list[tuple[int | None, int | None, int | None]]:
        seen, before, out = _NONE, 0, []
        for r in rows:
            late = None
            if seen == _CLASS and r["first"] > before + wait:
                seen, late = _NONE, before + wait
            out.append((r["span"], seen, late))
            seen, before = r[f"s{seen}"], r["last"]
        if seen == _CLASS and rows[-1]["_end"] > before + wait:
            out.append((None, None, before + wait))
        return out

    told = by_document(numbers.withColumnRenamed("spec_uid", "doc_id"), ("span", "first", "last", "_end", "s0", "s1", "s2"), stitch, "span long, seen long, late long")
    begun = stored(told.withColumnRenamed("doc_id", "spec_uid"))
    own = spans.join(begun.where("span IS NOT NULL"), ["spec_uid", "span"]).select("spec_uid", F.explode(F.get(F.array("f0.out", "f1.out", "f2.out"), F.col("seen").cast("int"))).alias("f")).select("spec_uid", "f.fired_at", "f.reason")
    return own.union(begun.where("late IS NOT NULL").select("spec_uid", F.timestamp_micros("late").alias("fired_at"), F.lit("timeout").alias("reason")))


def trigger_stream(calls: DataFrame, timeout: int = TIMEOUT, lateness: str = "1 hour") -> DataFrame:
    """The same on a stream of (spec_uid, kind, ts): (spec_uid, fired_at, reason), in event time behind a watermark.

    Calls of one micro-batch are taken in time order; a timeout fires once the watermark has passed it. Events later than
    the watermark are dropped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen_c, seen_d, last = state.get if state.exists else (False, False, 0)
        out: list[tuple[str, pd.Timestamp, str]] = []
        at = lambda us: pd.Timestamp(us, unit="us")
        if state.hasTimedOut:
            if seen_c and not seen_d:
                out.append((key[0], at(last + timeout * 1_000_000), "timeout"))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "kind"])
            for kind, ts in zip(rows.kind, rows.ts):
                now = int(ts.value // 1000)
                if seen_c and not seen_d and now > last + timeout * 1_000_000:
                    out.append((key[0], at(last + timeout * 1_000_000), "timeout"))
                    seen_c = False
                seen_c, seen_d, last = seen_c or kind == "classification", seen_d or kind == "data_element", now
                if seen_c and seen_d:
                    out.append((key[0], at(now), "both"))
                    seen_c = seen_d = False
            state.update((seen_c, seen_d, last))
            if seen_c and not seen_d:
                due = last // 1000 + timeout * 1000
                if due > state.getCurrentWatermarkMs():
                    state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["spec_uid", "fired_at", "reason"])

    return calls.withWatermark("ts", lateness).groupBy("spec_uid").applyInPandasWithState(run, "spec_uid string, fired_at timestamp, reason string", "c boolean, d boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)


#: Legal states of a task by protocol, with what they mean.
STATES = {"knowledge": {1: "accepted", 2: "running", 3: "done", 4: "failed"}, "interpretation": {1: "accepted", 2: "running", 4: "done", 6: "failed"}}


def task_status(messages: DataFrame, protocol: str = "knowledge") -> tuple[DataFrame, DataFrame]:
    """The latest state of each task (task_id, state, meaning, ts), and messages with an illegal state.

    messages are (task_id, state, ts, n); works on streams in update mode too.
    """
    legal = STATES[protocol]
    meaning = F.create_map(*[F.lit(x) for kv in legal.items() for x in kv])
    ok = F.coalesce(F.col("state").isin(*legal), F.lit(False))
    last = messages.where(ok).groupBy("task_id").agg(F.max_by(F.struct("state", "ts"), F.struct("ts", "n")).alias("s"))
    return last.select("task_id", "s.state", meaning[F.col("s.state")].alias("meaning"), "s.ts"), messages.where(~ok)


def latest_requests(requests: DataFrame, key: str = "spec_uid") -> DataFrame:
    """The last request (by ts, then n) of each key; earlier ones are superseded."""
    return requests.withColumn("_rk", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("n")))).where("_rk = 1").drop("_rk")


def health_rounds(checks: DataFrame, minutes: int = 3) -> DataFrame:
    """(round_start, healthy, recovered) of checks (check_id, service, ok, ts): a check is healthy if all its services are, a
    round of some minutes if any of its checks is; recovered marks a healthy round after an unhealthy one, or the first."""
    each = checks.groupBy(F.window("ts", f"{minutes} minutes").start.alias("round_start"), "check_id").agg(F.bool_and("ok").alias("ok"))
    rounds = each.groupBy("round_start").agg(F.bool_or("ok").alias("healthy"))
    # rounds are as many as minutes of monitoring, not as checks
    before = F.lag("healthy").over(Window.orderBy("round_start"))
    return rounds.withColumn("recovered", F.col("healthy") & ~F.coalesce(before, F.lit(False)))


def orphan_tasks(log: DataFrame, now: dt.datetime, completion: str = "completed", active_minutes: int = 30) -> DataFrame:
    """(task_id, last_line, ts, state 6) of tasks seen within some minutes whose last line does not hold the completion text."""
    last = log.groupBy("task_id").agg(F.max_by(F.struct("line", "ts"), F.struct("ts", "n")).alias("l"))
    live = last.where(F.col("l.ts") >= F.lit(now) - F.expr(f"interval {active_minutes} minutes"))
    return live.where(~F.contains(F.col("l.line"), F.lit(completion))).select("task_id", F.col("l.line").alias("last_line"), F.col("l.ts").alias("ts"), F.lit(6).alias("state"))
