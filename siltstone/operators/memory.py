"""Bounded conversation memory, as batch queries; siltstone.streaming has the keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_TURNS, TTL_SECONDS, MAX_THREADS = 6, 1800, 500
REMEMBERED = ("verified", "skipped")


def admitted(thread: Column, answer: Column, status: Column) -> Column:
    """Whether a served turn is remembered: it has a thread and says something, and it passed verification or that was skipped."""
    return (F.coalesce(thread.cast("string"), F.lit("")) != "") & (F.trim(F.coalesce(answer, F.lit(""))) != "") & F.coalesce(status.isin(*REMEMBERED), F.lit(False))


def remembered(turns: DataFrame, thread: str, time: str, admits: Column, limit: int = MAX_TURNS, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """For each turn what its thread holds when it comes: the admitted ones of the last ``limit`` turns since the thread was last idle for too long.

    A turn reads before it is stored, and reading renews a thread as storing does.
    """
    own = W.partitionBy(thread).orderBy(time, "event_id")
    idle = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(own))
    rows = turns.withColumn("_alive", F.sum(F.coalesce((idle > ttl_seconds).cast("int"), F.lit(1))).over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("_in", admits.cast("int"))
    since = W.partitionBy(thread, "_alive").orderBy(time, "event_id").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("remembered", F.least(F.coalesce(F.sum("_in").over(since), F.lit(0)), F.lit(limit)).cast("long")).drop("_alive", "_in")


def history(turns: DataFrame, thread: str, order: str, limit: int = MAX_TURNS) -> DataFrame:
    """The last ``limit`` turns of each thread."""
    back = F.row_number().over(W.partitionBy(thread).orderBy(F.desc(order)))
    return turns.withColumn("back", back.cast("long")).where(F.col("back") <= limit)


def composed(turns: DataFrame, thread: str, order: str, line: Column, limit: int = MAX_TURNS) -> DataFrame:
    """(thread, history): a thread's last turns, one line each, oldest first; ``limit`` lines at most."""
    kept = history(turns.withColumn("_line", line), thread, order, limit)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_line").alias("l"))))
    return kept.groupBy(thread).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("history"))


def sessions(events: DataFrame, thread: str, time: str, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Events with the number of their session: a thread idle for longer than the limit is forgotten and starts anew."""
    own = W.partitionBy(thread).orderBy(time, "event_id")
    idle = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(own))
    return events.withColumn("_new", F.coalesce((idle > ttl_seconds).cast("int"), F.lit(1))).withColumn("session", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def live_threads(events: DataFrame, thread: str, time: str, limit: int = MAX_THREADS) -> DataFrame:
    """The ``limit`` threads used last; top-k per task first, so one task never sees all threads."""
    used = events.groupBy(thread).agg(F.max(time).alias("last_used"))
    return used.orderBy(F.desc("last_used"), F.asc(thread)).limit(limit)
