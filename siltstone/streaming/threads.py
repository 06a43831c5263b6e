"""Structured Streaming: keyed conversation memory with a time to live, and tool steps as sessions.

State is bounded per key (the last turns, cut to length) and forgotten after the idle limit, in processing time. The
batch twins are in siltstone.operators.memory and siltstone.operators.tools; a global limit on threads has only a batch form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siltstone.operators.memory import MAX_TURNS, TTL_SECONDS
from siltstone.operators.tools import SLACK_MS
from siltstone.session import on_workers, shared_dir

MAX_CHARS = 400
HISTORY = "conv_id long, turn long, remembered long, history string"
STATE = "turns array<string>"


def remember(turns: list[str], new: list[str], limit: int = MAX_TURNS, chars: int = MAX_CHARS) -> list[str]:
    """The last ``limit`` turns after ``new`` ones, each cut to ``chars``."""
    return [*turns, *(t if len(t) <= chars else t[:chars].rstrip() + "…" for t in new if t.strip())][-limit:]


def _step(ttl_ms: int) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(batches)).sort_values("turn", kind="stable").itertuples():  # a thread's new turns, however they are batched
            out.append((key[0], row.turn, len(turns), "\n".join(turns)))
            if row.admitted:
                turns = remember(turns, [f"{row.role}: {row.text}"])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "remembered", "history"])
        state.update((turns,))
        state.setTimeoutDuration(ttl_ms)

    return step


def thread_memory(turns: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """For each turn of a stream (conv_id, turn, role, text[, admitted]) what its thread remembers when it comes; only admitted turns are stored."""
    if "admitted" not in turns.columns:
        turns = turns.withColumn("admitted", F.lit(True))
    return turns.groupBy("conv_id").applyInPandasWithState(_step(ttl_seconds * 1000), HISTORY, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def tool_sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, stop, n_calls) of an event stream: sessions closed by the watermark."""
    window = F.session_window("ts", gap)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("n_calls")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n_calls")


def call_steps(calls: DataFrame, late: str = "1 day", slack_ms: float = SLACK_MS) -> DataFrame:
    """(item_id, start, stop, n_calls) of a stream of calls (item_id, start timestamp, ms): steps as sessions that the watermark has closed.

    A call's session lasts while it runs and the slack after it, so each has a gap of its own, and calls that begin in another's
    session join it: what siltstone.operators.tools.steps says by windows.
    """
    # sessions end before their end, steps with it: a microsecond more
    lasts = F.floor((F.coalesce("ms", F.lit(0.0)) + slack_ms) * 1000) + 1
    window = F.session_window("start", F.concat(lasts.cast("string"), F.lit(" microseconds")))
    found = calls.withWatermark("start", late).groupBy("item_id", window.alias("w")).agg(F.count("*").alias("n_calls"))
    return found.select("item_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n_calls")


class Memory(StatefulProcessor):
    """What a thread remembers, in a list, and when it was last used; the clock is event time, so a test sets it with its rows.

    A thread that has been idle for longer than the limit is forgotten when its next turn comes; a timer gives its state back once the watermark has passed the limit.
    """

    def __init__(self, ttl_ms: int, limit: int) -> None:
        self.ttl_ms, self.limit = ttl_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn string")
        self.used = handle.getValueState("used", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N803, N802
        held = [t[0] for t in self.turns.get()] if self.turns.exists() else []
        used = self.used.get()[0] if self.used.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(["at_ms", "turn"], kind="stable").itertuples():
            if used is not None and row.at_ms - used > self.ttl_ms:
                held = []
            out.append((key[0], row.turn, "turn", len(held)))
            if row.admitted:
                held = [*held, row.text][-self.limit :]
            used = max(row.at_ms, used or row.at_ms)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(used + self.ttl_ms)
        self.used.update((used,))
        self.turns.put([(t,) for t in held]) if held else self.turns.clear()
        yield pd.DataFrame(out, columns=["thread", "turn", "kind", "remembered"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803, N802
        held = len(list(self.turns.get())) if self.turns.exists() else 0
        self.turns.clear()
        self.used.clear()
        yield pd.DataFrame([(key[0], None, "expired", held)], columns=["thread", "turn", "kind", "remembered"]).astype({"turn": "Int64"})

    def close(self) -> None:
        pass


def timed_memory(turns: DataFrame, ttl_seconds: int = TTL_SECONDS, limit: int = MAX_TURNS, late: str = "1 day") -> DataFrame:
    """(thread, turn, kind, remembered) of a stream (thread long, turn long, at timestamp, text, admitted).

    A row of kind ``turn`` for each turn, with how many admitted ones its thread remembers as it comes, and one of kind ``expired`` for each
    thread that the watermark finds idle. Needs the state store that keeps lists and timers: see run_once(timers=True).
    """
    on_workers(turns.sparkSession)
    rows = turns.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("thread").transformWithStateInPandas(Memory(ttl_seconds * 1000, limit), "thread long, turn long, kind string, remembered long", "Append", "EventTime")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir`` as a file stream: a file, or a folder of files of any names."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return rows.parquet(path)
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream takes folders only


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, name: str, checkpoint: str | None = None, event_time: bool = False, timers: bool = False) -> DataFrame:
    """What a stream appends over the files that are there now, written to the shared folder as it comes and read from there.

    ``timers`` uses the state store that list states and timers need. With ``event_time`` a last batch without data lets the watermark close what it has passed. Idle limits in processing time would ask
    for such batches without end, so there are none for them.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streams/{name}"
    options = {"spark.sql.streaming.noDataMicroBatches.enabled": str(event_time).lower()}
    if timers:
        options["spark.sql.streaming.stateStore.providerClass"] = STORE
    held = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", checkpoint or f"{path}/checkpoint").outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
