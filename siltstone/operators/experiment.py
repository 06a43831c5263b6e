"""Identity of runs: hashes of configurations and files, reuse of results, caches and plans of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def config_hash(settings: Column, length: int = 12) -> Column:
    """The first characters of a digest of a map's entries in key order."""
    entries = F.array_sort(F.transform(F.map_entries(settings), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.to_json(F.struct(e["value"].alias("v"))))))
    return F.left(F.sha2(F.array_join(entries, ","), 256), F.lit(length))


def text_sha256(text: Column) -> Column:
    """A digest that doesn't depend on the kind of line ends."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def benchmark_version(files: DataFrame, within: str, order: str, name: str, text: str, length: int = 12) -> DataFrame:
    """(within, version): one version over the files of a benchmark, in order: any edit of one of them, or of its name, is another version."""
    end = F.decode(F.unhex(F.lit("00")), "UTF-8")
    part = F.struct(F.col(order).alias("o"), F.concat(F.col(name), end, text_sha256(F.col(text)), end).alias("p"))
    rows = files.groupBy(within).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"]), "").alias("_all"))  # digests only
    return rows.select(within, F.concat(F.lit("sha256:"), F.left(F.sha2("_all", 256), F.lit(length))).alias("version"))


def index_problem(live: Column, labelled: Column) -> Column:
    """Why an index of ``live`` chunks can't be scored by labels made on ``labelled`` ones; null if it can."""
    return (
        F.when(F.coalesce(live, F.lit(0)) == 0, "there is no index")
        .when(~live.eqNullSafe(labelled), F.concat(F.lit("the index has "), live.cast("string"), F.lit(" chunks, the labels were made on "), F.coalesce(labelled.cast("string"), F.lit("an unknown number"))))
    )


def cache_key(parts: list[Column]) -> Column:
    """Parts joined by bars; null parts leave no trace."""
    return F.concat_ws("|", *parts)


def reusable(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted hash the first complete result by path."""
    done = results.where("status = 'complete'").groupBy("config_hash").agg(F.min("path").alias("path"))
    return wanted.join(done, "config_hash", "left")


def pending(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Items that no cached output answers."""
    return items.join(cache, key, "left_anti")


def within_budget(plan: DataFrame, order: str, cost: str, cap: float, group: str) -> DataFrame:
    """Steps of a plan that fit under a spending cap, in order, group by group."""
    spent = F.sum(cost).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return plan.withColumn("spent", F.round(spent, 6)).where(F.col("spent") <= cap)
