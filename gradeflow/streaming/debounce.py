"""Builds that wait until requests pause: a later request of a specification replaces the one that is pending."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def due_builds(requests: DataFrame, quiet: int, key: str = "spec_uid") -> DataFrame:
    """(key, n, due_at) of requests (key, ts, n) that no other one of the key follows within ``quiet`` seconds; n, a unique
    number, orders requests of one time.

    Of requests within one span of ``quiet`` seconds only the last can stay, and the first tells whether it ends the wait of one
    before; so those of a span are combined, and a busy key is a row for each span.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.floor(micros / (quiet * 1_000_000)).alias("span")
    last = requests.groupBy(key, span).agg(F.max(F.struct("ts", "n")).alias("x"), F.min(micros).alias("first")).select(key, "x.ts", "x.n", "first")
    following = F.lead("first").over(Window.partitionBy(key).orderBy("ts", "n"))
    wait = F.expr(f"interval {quiet} seconds")
    return last.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") > micros + quiet * 1_000_000)).select(key, "n", (F.col("ts") + wait).alias("due_at"))


class _Pending(StatefulProcessor):
    """The pending request of a key, and a timer for when it is due."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "us long, n long")

    def _due(self, key: tuple, us: int, n: int) -> tuple:
        return key[0], n, pd.Timestamp(us + self.quiet * 1_000_000, unit="us")

    def _timer(self, us: int) -> int:
        return (us + self.quiet * 1_000_000) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        old = self.pending.get() if self.pending.exists() else None
        now, out = old, []
        every = pd.concat(list(rows))
        for us, n in sorted((int(ts.value) // 1000, int(n)) for ts, n in zip(every.ts, every.n, strict=True)):
            if now is not None and (us, n) <= (now[0], now[1]):
                continue
            if now is not None and us > now[0] + self.quiet * 1_000_000:
                out.append(self._due(key, now[0], now[1]))
            now = us, n
        if now is not None and now != old:
            if old is not None:
                self.handle.deleteTimer(self._timer(old[0]))
            self.pending.update(tuple(now))
            self.handle.registerTimer(self._timer(now[0]))
        yield pd.DataFrame(out, columns=["key", "n", "due_at"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        us, n = self.pending.get()
        self.pending.clear()
        yield pd.DataFrame([self._due(key, us, n)], columns=["key", "n", "due_at"])

    def close(self) -> None:
        pass


def due_stream(requests: DataFrame, quiet: int, key: str = "spec_uid", lateness: str = "10 minutes") -> DataFrame:
    """The same on a stream: a build is due once the watermark has passed its quiet time, across micro-batches. Needs the state
    store that ``debounced`` sets."""
    kind = requests.schema[key].dataType.simpleString()
    marked = requests.select(F.col(key).alias("key"), "ts", F.col("n").cast("long").alias("n")).withWatermark("ts", lateness)
    built = marked.groupBy("key").transformWithStateInPandas(_Pending(quiet), f"key {kind}, n long, due_at timestamp", "Append", "EventTime")
    return built.withColumnRenamed("key", key)


def debounced(requests: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str, quiet: int = 60, key: str = "spec_uid", lateness: str = "10 minutes") -> StreamingQuery:
    """Starts a stream that calls rebuild with the builds (key, n, due_at) that are due, one batch at a time."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rebuild(batch)

    spark = requests.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # timers need it; a query keeps what it starts with
    try:
        return due_stream(requests, quiet, key, lateness).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
