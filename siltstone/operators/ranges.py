"""Running totals over a whole table in order, without one task that sees it all.

Rows go to ranges of the order, and are stored there: a range's total is added up where it lies, the totals of the ranges
before it (a number each, as many as there are ranges) are handed to it, and rows are summed inside their range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.session import stored


def running_total(rows: DataFrame, order: list[str], value: str, out: str = "total", parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to each one, by ``order``, which has to tell rows apart; null counts as 0."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = stored(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = F.coalesce(F.col(value), F.lit(0))
    totals = sorted(held.groupBy("_range").agg(F.sum(own).alias("t")).collect())  # a row a range
    before = spark.createDataFrame(list(zip([r["_range"] for r in totals], accumulate([r["t"] for r in totals[:-1]], initial=type(totals[0]["t"])(0)), strict=True)), f"_range int, _before {_wide(held, own)}") if totals else None
    if before is None:
        return held.withColumn(out, own).drop("_range")
    inside = F.sum(own).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return held.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + inside).drop("_range", "_before")


def _wide(rows: DataFrame, value: object) -> str:
    return rows.select(F.sum(value).alias("t")).schema["t"].dataType.simpleString()


def until_cap(plan: DataFrame, order: list[str], cost: str, cap: float, stops: str | None = None, parts: int | None = None) -> DataFrame:
    """The steps of a plan that are taken, in order, with what is ``spent`` by then: as long as the next one's cost fits under the cap.

    With ``stops`` the first step of which it is true is the last one taken, as a quota error stops a run. The plan is one
    sequence: a step that doesn't fit ends it, so that nothing cheaper after it is taken.
    """
    rows = running_total(plan, order, cost, "spent", parts)
    rows = rows.withColumn("_fits", F.round("spent", 6) <= cap)
    if stops is None:
        return rows.where("_fits").withColumn("spent", F.round("spent", 6)).drop("_fits")
    first = rows.where(F.col(stops)).agg(F.min(F.struct(*order)).alias("first")).first()["first"]  # one row
    within = F.lit(True) if first is None else F.struct(*order) <= F.struct(*[F.lit(first[c]).cast(rows.schema[c].dataType).alias(c) for c in order])
    return rows.where(F.col("_fits") & within).withColumn("spent", F.round("spent", 6)).drop("_fits")


def resumed(plan: DataFrame, cache: DataFrame, key: list[str], order: list[str], cost: str, cap: float, stops: str | None = None, parts: int | None = None) -> DataFrame:
    """What a run that goes on takes: steps that the cache has are answered by it and cost nothing, the others as long as the cap lasts."""
    return until_cap(plan.join(cache.select(*key).distinct(), key, "left_anti"), order, cost, cap, stops, parts)
