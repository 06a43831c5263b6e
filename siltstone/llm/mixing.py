"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight; a source is clamped at ``max_epochs`` times its size, and what it can't take
is shared by the others by weight until none is above its cap. With caps c and weights w that fixed point is
min(c, level * w): sources in order of c / w saturate first, so the level follows from two running sums over the
sources (one row each). A source's target is met by whole repetitions of all its documents, and for the rest by a
seeded sample: documents in hash order until the fraction is filled. The order is cut by a histogram of BUCKETS hash
ranges for each source, and the range where the sample ends by BUCKETS finer ones, so only a millionth of a source is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 1024
SEED = 17


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size); sources by code point, null last."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows, before = W.partitionBy(), fill.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weights_left)
    first_free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)
    level = first_free["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return by.withColumn("target", target).select("source", "source_size", "weight", "target")


def draw(ident: Column, text: Column, seed: int) -> Column:
    """The place of a row in its source's sample: by its id, or by its text where it has none."""
    return F.when(ident.isNull(), F.xxhash64(F.lit(seed), text)).otherwise(F.xxhash64(F.lit(seed), ident))


def _cut(rows: DataFrame, bucket: Column, need: DataFrame, level: str) -> DataFrame:
    """``rows`` with _at_<level>, the hash range of its source that the sample ends in, and _left: what is still needed there.

    ``need`` has a row for each source: (_s, _left). Only BUCKETS sums of each source are put in order.
    """
    sums = common.stored(rows.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("size")), "mix-ranges")
    run = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    to = sums.withColumn("_to", F.sum("size").over(run)).join(need, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("_to") > F.col("_left"))
    ends = to.groupBy(F.col("source").alias("_e")).agg(F.min(F.struct("_bucket", (F.col("_to") - F.col("size")).alias("below"))).alias("_end"))
    by = need.join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left")
    by = by.select("_s", F.coalesce(F.col("_end")["_bucket"], F.lit(BUCKETS)).alias(f"_at_{level}"), (F.col("_left") - F.coalesce(F.col("_end")["below"], F.lit(0))).alias("_left"))
    return rows.drop("_left").join(common.stored(by, "mix-ends"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def plan(rows: DataFrame, **shares) -> DataFrame:
    """``rows`` (with source, size and _draw) and the columns source_size, target and copies: how often each is taken.

    Rows without words are taken as often as their whole source is. Null sources are a source.
    """
    sizes = common.stored(rows.groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    by = targets(sizes, **shares)
    by = by.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    by = common.stored(by.select(F.col("source").alias("_s"), "source_size", "target", "_whole", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_left")), "mix-sources")
    rows = rows.join(by.drop("_left"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    coarse, fine = F.pmod("_draw", F.lit(BUCKETS)).cast("int"), F.pmod(F.shiftright("_draw", 10), F.lit(BUCKETS)).cast("int")
    rows = _cut(rows, coarse, by.select("_s", "_left"), "coarse")
    need = rows.select(F.col("source").alias("_s"), "_left").distinct()  # a row for each source
    clear = rows.where(coarse != F.col("_at_coarse")).withColumn("copies", F.col("_whole") + (coarse < F.col("_at_coarse")).cast("int"))
    edge = _cut(rows.where(coarse == F.col("_at_coarse")), fine, need, "fine")
    inner = edge.where(fine != F.col("_at_fine")).withColumn("copies", F.col("_whole") + (fine < F.col("_at_fine")).cast("int"))
    order = W.partitionBy("source").orderBy("_draw", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = edge.where(fine == F.col("_at_fine")).withColumn("_end", F.sum("size").over(order))
    last = last.withColumn("copies", F.col("_whole") + (F.col("_end") - F.col("size") / 2 < F.col("_left")).cast("int"))
    kept = [c for c in clear.columns if c not in ("_draw", "_whole", "_at_coarse", "_left")]
    return clear.select(kept).unionByName(inner.select(kept)).unionByName(last.select(kept))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **shares) -> DataFrame:
    """Columns id, size, source_size, target, taken for each row of ``docs``.

    Null texts have size 0 and null sources are a source, the last. An empty table gives an empty result; if no text has
    words, targets and taken are 0. Rows that repeat an id are taken one by one; rows without an id are drawn by their text. Texts of any length
    are counted whole. Other columns are ignored.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    sizes = docs.select(ident.alias("doc_id"), F.col(f"`{source_col}`").alias("source"), common.n_words(text).alias("size"), draw(ident, text, seed).alias("_draw"))
    out = plan(common.stored(sizes, "mix-sizes"), **shares)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **shares) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, rows without words once. Columns stay as they are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    ident, text = F.col(names[id_col]), F.col(names[text_col])
    rows = rows.withColumn("source", F.col(names[source_col])).withColumn("size", common.n_words(text)).withColumn("_draw", draw(ident, text, seed))
    out = plan(rows, **shares)
    copies: Column = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
