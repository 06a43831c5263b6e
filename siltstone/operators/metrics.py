"""Rank metrics, stratified means, percentiles, coverage, costs, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import numbers as N

KS = (5, 10, 25)


def group_ranks(ranked: DataFrame, groups: DataFrame) -> DataFrame:
    """(item_id, group_id, hit): the best rank at which a retrieved list has any member of a label group; null if none.

    ranked: (item_id, doc_id, rank); groups: (item_id, group_id, doc_id).
    """
    return groups.join(ranked, ["item_id", "doc_id"], "left").groupBy("item_id", "group_id").agg(F.min("rank").alias("hit"))


def label_items(items: DataFrame, references: DataFrame, located: DataFrame, overrides: DataFrame) -> DataFrame:
    """(item_id, groups, method, n_references, note): the label groups of each item.

    references: (item_id, ref_pos); located: (item_id, ref_pos, doc_id, method exact or prefix); overrides: (item_id, groups, unlocatable, note), which win.
    An item whose references are all found whole is exact, with some by their beginning prefix, with some not at all partial, with none of them none.
    """
    per = located.groupBy("item_id", "ref_pos").agg(F.array_sort(F.collect_set("doc_id")).alias("group"), F.min("method").alias("how"))
    rows = references.select("item_id", "ref_pos").distinct().join(per, ["item_id", "ref_pos"], "left")
    groups = F.transform(F.array_sort(F.collect_list(F.when(F.col("group").isNotNull(), F.struct("ref_pos", "group")))), lambda x: x["group"])
    found, exact = F.count("group"), F.count_if(F.col("how") == "exact")
    how = F.when(exact == F.count("*"), "exact").when(found == F.count("*"), "prefix").when(found > 0, "partial").otherwise("none")
    made = rows.groupBy("item_id").agg(groups.alias("made"), how.alias("how"), F.count("*").alias("n"))
    all_ = items.select("item_id").join(made, "item_id", "left").join(overrides.withColumnRenamed("groups", "given").withColumn("_o", F.lit(True)), "item_id", "left")
    override, lost = F.coalesce("_o", F.lit(False)), F.coalesce("unlocatable", F.lit(False))
    none = F.array().cast(located.schema["doc_id"].dataType.simpleString().join(("array<array<", ">>")))
    final = F.when(override & lost, none).when(override, F.coalesce("given", none)).otherwise(F.coalesce("made", none))
    return all_.select(
        "item_id", final.alias("groups"), F.when(override & lost, "unlocatable").when(override, "manual").otherwise(F.coalesce("how", F.lit("none"))).alias("method"),
        F.when(override & lost, 0).when(override, F.coalesce(F.size("given"), F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_references"), F.coalesce(F.when(override, F.col("note")), F.lit("")).alias("note"),
    )


def item_metrics(hits: DataFrame, ks: tuple[int, ...] = KS, ndcg_k: int = 5) -> DataFrame:
    """Per item: n_groups, first_hit_rank, mrr, ndcg@5, hit and recall at each k, rounded to 4 places."""
    gain = F.sum(F.when(F.col("hit") <= ndcg_k, 1 / F.log2(F.col("hit") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count("*"), F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = [F.count("*").alias("n_groups"), F.min("hit").cast("long").alias("first_hit_rank"), F.round(F.coalesce(1 / F.min("hit"), F.lit(0.0)), 4).alias("mrr"), F.round(gain / ideal, 4).alias("ndcg_5")]
    for k in ks:
        within = F.when(F.col("hit") <= k, 1.0).otherwise(0.0)
        out += [F.max(within).alias(f"hit_{k}"), F.round(F.avg(within), 4).alias(f"recall_{k}")]
    return hits.groupBy("item_id").agg(*out)


METRICS = ("mrr", "ndcg_5", *[f"{m}_{k}" for k in KS for m in ("hit", "recall")])


def mean_metrics(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over items that have a value, rounded to 4 places, and the number of items."""
    return items.groupBy(*(by or [])).agg(F.count("*").alias("n_items"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def retrieval_blocks(items: DataFrame, strata: list[str]) -> DataFrame:
    """(block, stratum, n_items, means): a run's items overall and by each of ``strata``, in one pass of grouping sets."""
    sets = [[], *[[c] for c in strata]]
    rows = items.groupingSets(sets, *strata).agg(F.grouping_id(*strata).alias("_set"), F.count("*").alias("n_items"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])
    n = len(strata)
    which = lambda i: F.col("_set") == F.lit((1 << n) - 1 - (1 << (n - 1 - i)))  # noqa: E731  the bit of what is grouped by is off
    block, stratum = F.lit("overall"), F.lit("all")
    for i, c in enumerate(strata):
        block, stratum = F.when(which(i), c).otherwise(block), F.when(which(i), F.col(c).cast("string")).otherwise(stratum)
    return rows.select(block.alias("block"), stratum.alias("stratum"), "n_items", *METRICS)


def retrieval_latency(items: DataFrame, value: str = "latency_ms") -> DataFrame:
    """(p50, p95, mean) of a run's questions, in milliseconds."""
    rows = items.select(F.lit("all").alias("_all"), value)
    mean = rows.groupBy("_all").agg(F.round(F.avg(value), 1).alias("mean"))
    return N.percentiles(rows, ["_all"], value, {"p50": ("nearest", 50), "p95": ("nearest", 95)}).join(mean, "_all").drop("_all")


def coverage(rows: DataFrame, score: str, terminal: str) -> DataFrame:
    """Scored, missing, missing for a failed run, missing without a reason; and both means."""
    value = F.when(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    failed = F.col(terminal) & value.isNull()
    return rows.agg(
        F.count("*").alias("n_items"),
        F.count(value).alias("n_scored"),
        F.count_if(value.isNull()).alias("n_nan"),
        F.count_if(failed).alias("n_nan_terminal"),
        F.count_if(value.isNull() & ~F.col(terminal)).alias("n_nan_unexplained"),
        N.ratio(F.count(value), F.count("*")).alias("coverage"),
        F.round(F.avg(value), 4).alias("mean"),
        N.ratio(F.sum(value), F.count(value) + F.count_if(failed)).alias("mean_failures_as_zero"),
    )


def gate(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, threshold, passed): a metric without a value fails; counts pass at or under their threshold."""
    higher = F.col("higher_is_better")
    passed = F.when(higher, F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return thresholds.join(values, "metric", "left").select("metric", "value", "threshold", F.coalesce(passed, F.lit(False)).alias("passed"))
