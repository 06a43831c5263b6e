"""Tool-call quality: steps, batching, redundancy, validity, label conformity.

A call is a row (item_id, pos, tool, start_ms, ms, error, args).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import messages as S
from siltstone.functions import numbers as N

SLACK_MS = 50.0


def steps(calls: DataFrame, slack_ms: float = SLACK_MS) -> DataFrame:
    """``calls`` and their step, from 1: a call joins the step that it starts in, or within the slack after its latest end."""
    own = W.partitionBy("item_id").orderBy("start_ms", "pos")
    latest = F.max(F.col("start_ms") + F.col("ms")).over(own.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(latest.isNull() | (F.col("start_ms") > latest + slack_ms), 1).otherwise(0)
    return calls.withColumn("_new", new).withColumn("step", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def batching(stepped: DataFrame) -> DataFrame:
    """Per item: calls, steps, steps with several calls, calls in such steps."""
    sizes = stepped.groupBy("item_id", "step").agg(F.count("*").alias("n"))
    several = F.col("n") > 1
    return sizes.groupBy("item_id").agg(
        F.sum("n").alias("n_calls"), F.count("*").alias("steps"), F.count_if(several).alias("batched_steps"),
        F.sum(F.when(several, F.col("n")).otherwise(0)).alias("calls_in_batched_steps"), F.max(several).alias("batched"),
    )


def first_calls(calls: DataFrame) -> DataFrame:
    """(item_id, first_tool): the earliest start if all calls have one, else the first recorded."""
    timed = F.bool_and(F.col("start_ms").isNotNull())
    tool = F.when(timed, F.min_by("tool", F.struct("start_ms", "pos"))).otherwise(F.min_by("tool", F.col("pos")))
    return calls.groupBy("item_id").agg(tool.alias("first_tool"))


def redundant(calls: DataFrame) -> DataFrame:
    """(item_id, redundant_calls): repetitions of a tool with the same arguments, whatever the order of their keys."""
    same = calls.where("args is not null").groupBy("item_id", "tool", S.canonical_args(F.col("args")).alias("args")).agg((F.count("*") - 1).alias("again"))
    return same.groupBy("item_id").agg(F.sum("again").alias("redundant_calls"))


def batches(calls: DataFrame) -> DataFrame:
    """batching() of the items whose calls all have a start; the others have no row."""
    timed = calls.groupBy("item_id").agg(F.bool_and(F.col("start_ms").isNotNull()).alias("timed")).where("timed").select("item_id")
    return batching(steps(calls.join(timed, "item_id", "left_semi"))).drop("n_calls")


def validity(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failed calls and the share that worked."""
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.count_if("error").alias("failed"), N.ratio(F.count_if(~F.col("error")), F.count("*")).alias("valid"))


def conformity(calls: DataFrame, labels: DataFrame) -> DataFrame:
    """Per labelled item: disallowed and missing tools, and whether the set and the first tool are right.

    An item without calls has used no tool: what it had to use is missing, and its first tool is not applicable.
    """
    used = calls.groupBy("item_id").agg(F.array_sort(F.collect_set("tool")).alias("used"))
    rows = labels.join(used, "item_id", "left").join(first_calls(calls), "item_id", "left")
    rows = rows.withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    rows = rows.withColumn("disallowed", F.array_except("used", "allowed")).withColumn("missing", F.array_except("required", "used"))
    return rows.select(
        "item_id", "first_tool", "disallowed", F.array_sort("missing").alias("missing"),
        ((F.size("disallowed") == 0) & (F.size("missing") == 0)).alias("tool_set_ok"),
        F.array_contains("first_ok", F.col("first_tool")).alias("first_tool_ok"),
    )
