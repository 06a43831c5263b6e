"""Exact deduplication over an extendible-hash index on shared files.

1. Every row enters the index as (hash, digest, id): written to the shared folder, without its text.
2. The directory grows by doubling: a histogram over the finest hash prefixes (2 ** MAX_DEPTH counts at most) is all
   that the driver sees; a bucket over ``capacity`` splits on its next hash bit, and the directory doubles when that
   bucket was already as deep as the directory. A bucket that no split can shrink (one hash holds a third of all rows, say) chains
   overflow pages instead.
3. An owner has one bucket, a range of hashes, or one page of a chain. The index is stored by owner, so that owner tasks read their range and
   count and number its groups there, without moving a row again; only of chains, page counts are added up and looked up by their pages.
4. Only hashes that occur twice have their texts compared, byte by byte: a group holds one text; texts that collide form a chain, told apart by
   the text itself.
5. A second batch goes into the index as it is: buckets that it overfills split, and only these are dealt again.

Only DataFrame operations run here.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CAPACITY, MAX_DEPTH = 1 << 15, 20
Bucket = tuple[int, int]  # (local depth, prefix of that many bits)


def split(buckets: list[Bucket], counts: dict[int, int], finest: int, capacity: int) -> dict[Bucket, int]:
    """The buckets after all splits, each with its rows; ``counts``: rows by hash prefix of ``finest`` bits."""
    upto = [0]
    for slot in range(1 << finest):
        upto.append(upto[-1] + counts.get(slot, 0))
    todo, done = list(buckets), {}
    while todo:
        local, prefix = todo.pop()
        rows = upto[(prefix + 1) << (finest - local)] - upto[prefix << (finest - local)]
        if rows <= capacity or local == finest:
            done[local, prefix] = rows
        else:
            todo += [(local + 1, prefix * 2), (local + 1, prefix * 2 + 1)]
    return dict(sorted(done.items(), key=lambda b: b[0][1] / (1 << b[0][0])))


@dataclass
class Index:
    """Stored entries (id, hash, sha256), the buckets that they are in, and rows by the finest prefix."""

    entries: DataFrame
    counts: dict[int, int]
    finest: int
    capacity: int
    buckets: dict[Bucket, int]

    @property
    def depth(self) -> int:
        """Global depth: the directory has 2 ** depth slots."""
        return max(local for local, _ in self.buckets)

    def directory(self) -> list[tuple[int, int, int, int]]:
        """(slot, bucket, first owner, pages) of each slot; buckets are numbered in the order of their ranges."""
        out, owner = [], 0
        for bucket, ((local, prefix), rows) in enumerate(self.buckets.items()):
            pages = max(1, -(-rows // self.capacity))
            wide = 1 << (self.depth - local)
            out += [(slot, bucket, owner, pages) for slot in range(prefix * wide, (prefix + 1) * wide)]
            owner += pages
        return out

    def owned(self) -> DataFrame:
        """Entries with bucket, pages and owner: the range of their hash, or the page that their id is dealt to."""
        spark = self.entries.sparkSession
        rows = self.entries.withColumn("slot", F.shiftrightunsigned("hash", 64 - self.depth).cast("int") if self.depth else F.lit(0))
        # 2 ** MAX_DEPTH slots at most
        slots = F.broadcast(spark.createDataFrame(self.directory(), "slot int, bucket int, first int, pages int"))
        page = F.when(F.col("pages") == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("pages"))).cast("int")
        return rows.join(slots, "slot").withColumn("owner", F.col("first") + page).drop("slot")


def _entries(docs: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """Stored (id, hash, sha256) of the rows, and the texts that hash to them (lazy)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("body")).withColumn("hash", F.xxhash64("body"))
    return common.stored(texts.select("id", "hash", F.sha2("body", 256).alias("sha256")), "entries"), texts


def _counts(entries: DataFrame, finest: int) -> dict[int, int]:
    """Rows by hash prefix: 2 ** ``finest`` numbers at most."""
    slot = F.shiftrightunsigned("hash", 64 - finest).cast("int") if finest else F.lit(0)
    return {r["slot"]: r["n"] for r in entries.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}


def build(entries: DataFrame, capacity: int = CAPACITY) -> Index:
    """An index of stored entries. Where the directory would outgrow MAX_DEPTH, buckets hold more."""
    rows = entries.count()
    capacity = max(capacity, rows >> (MAX_DEPTH - 2))
    finest = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows / capacity)))) + 3)
    counts = _counts(entries, finest)
    return Index(entries, counts, finest, capacity, split([(0, 0)], counts, finest, capacity))


def insert(index: Index, entries: DataFrame) -> Index:
    """The index with more stored entries: its buckets split where they are overfull, down to what the finest prefixes tell."""
    rows = sum(index.counts.values()) + entries.count()
    finest = max(index.finest, min(MAX_DEPTH, math.ceil(math.log2(max(1, rows / index.capacity))) + 3))
    both = index.entries.unionByName(entries)
    if finest == index.finest:
        counts = dict(index.counts)
        for slot, n in _counts(entries, finest).items():
            counts[slot] = counts.get(slot, 0) + n
    else:
        counts = _counts(both, finest)
    return Index(both, counts, finest, index.capacity, split(list(index.buckets), counts, finest, index.capacity))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Nulls count as empty texts; the largest id of equal texts stays (of rows that repeat an id too, all stay); an empty
    table gives an empty result; other columns are ignored, whatever their names. Null ids take part and are never kept
    where their group has an id.
    """
    entries, texts = _entries(docs, id_col, F.col(f"`{text_col}`"))
    return answers(build(entries, capacity), texts)


def answers(index: Index, texts: DataFrame) -> DataFrame:
    """The rows of exact_dedup() for an index, whose texts (id, body, hash) are ``texts``."""
    spark = index.entries.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"siltstone_index_{uuid.uuid4().hex}"
    owned = index.owned().repartition(tasks, "owner")
    owned.write.bucketBy(tasks, "owner").sortBy("owner", "hash").option("path", common.scratch(spark, "index")).saveAsTable(name)
    stored = spark.table(name)
    # owner tasks: groups of a range, counted where they lie
    group = W.partitionBy("owner", "hash", "sha256")
    plain = stored.where("pages = 1").select("id", "hash", "sha256", F.max("id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"))
    counted = stored.groupBy("owner", "hash", "sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.first("bucket").alias("bucket"), F.first("first").alias("first"), F.first("pages").alias("pages"))
    counted = common.stored(counted, "counted")
    chained = counted.where("pages > 1").groupBy("bucket", "hash", "sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.first("first").alias("first"), F.first("pages").alias("pages"))
    pages = chained.withColumn("owner", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pages") - 1))).select("owner", "hash", "sha256", "keep_id", "group_size")
    rows = plain
    if any(n > index.capacity for n in index.buckets.values()):
        rows = plain.unionByName(stored.where("pages > 1").select("owner", "id", "hash", "sha256").join(pages, ["owner", "hash", "sha256"]).select(plain.columns))
    with common.runtime_filters(spark):
        repeated = common.pruning(counted.groupBy("hash").agg(F.sum("group_size").alias("n")).where("n > 1").select("hash"), "repeated")
        # the digest is the first key, so copies are counted where they lie before they move again
        compared = texts.join(repeated, "hash", "left_semi").select("id", F.sha2("body", 256).alias("sha256"), "body").groupBy("sha256", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        chains = common.stored(compared.groupBy("sha256").agg(F.count("*").alias("texts")).where("texts > 1").select("sha256"), "collided")
    if not chains.isEmpty():  # equal digests of different texts: told apart by the texts themselves
        body = W.partitionBy("sha256", "body")
        told = texts.withColumn("sha256", F.sha2("body", 256)).join(chains, "sha256", "left_semi")
        told = told.select("id", "hash", "sha256", F.max("id").over(body).alias("keep_id"), F.count("*").over(body).alias("group_size"))
        rows = rows.join(chains, "sha256", "left_anti").select(plain.columns).unionByName(told)
    out = rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))
    spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
