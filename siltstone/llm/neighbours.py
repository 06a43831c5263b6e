"""Approximate nearest neighbours by a permutation index.

PIVOTS vectors, a seeded sample of that fixed size, order space: a vector is represented by its PREFIX nearest pivots,
nearest first, and posted under each of them in the pivot's inverted file with its position there. A query reads the files of its own
pivots and adds 2 * (PREFIX - max(position, position')) for each posting, which is, up to a constant, minus Spearman's
footrule distance of the two prefixes with missing pivots put last. The best SHARE of a shard by footrule, and k + 1 at least (a
query can't ask for less), are ranked again by their exact inner product in double precision.

The index is cut into shards by a hash of the vector, and stored with their inverted files; queries come in blocks, so a task holds one shard and
one block, of bounded sizes, whatever the table's size. Every row is indexed. Equal vectors share an entry and tie for every query, smaller ids first, so the entry
carries its k + 1 smallest ids: no answer can hold more of them. README gives the measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

PIVOTS, PREFIX, SHARE = 512, 128, 0.12
SHARD_ROWS, BLOCK_ROWS = 16_384, 2048
PACKED = "part int, ids binary, vectors binary"
SHARDED = PACKED + ", members binary, begins binary, rows binary, places binary"


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def padded(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    """One matrix; shorter vectors have zeros at their end."""
    out = np.zeros((len(vectors), dim), dtype="<f8")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first; by Euclidean distance, ties to the first pivot."""
    out = []
    for a in range(0, len(vectors), 4096):
        far = (pivots**2).sum(axis=1) - 2 * vectors[a : a + 4096] @ pivots.T
        out.append(np.argsort(far, axis=1, kind="stable")[:, :prefix])
    return np.concatenate(out)


def shard_of(ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> dict[str, np.ndarray]:
    """A shard's entries (distinct vectors), the ids of each, and the pivots' inverted files: (begins, rows, places)."""
    entries, entry_of = np.unique(vectors, axis=0, return_inverse=True)
    prefix = min(prefix, len(pivots))
    posted = prefixes(entries, pivots, prefix)
    order = np.argsort(posted, axis=None, kind="stable")
    by_entry = np.lexsort((ids, entry_of.ravel()))  # ids of an entry, ascending
    return {
        "ids": ids[by_entry].astype("<i8"), "vectors": entries.astype("<f8"), "members": np.searchsorted(entry_of.ravel()[by_entry], np.arange(len(entries) + 1)).astype("<i4"),
        "begins": np.searchsorted(posted.ravel()[order], np.arange(len(pivots) + 1)).astype("<i4"), "rows": (order // prefix).astype("<i4"), "places": (order % prefix).astype("<i2"),
    }


def search_shard(shard: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, prefix: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best that each query finds in a shard."""
    ids, entries, members, begins, rows, places = (shard[c] for c in ("ids", "vectors", "members", "begins", "rows", "places"))
    prefix = min(prefix, len(pivots))
    depth = min(len(entries), max(k + 1, int(np.ceil(share * len(entries)))))
    own = prefixes(queries, pivots, prefix)
    out: tuple[list, list, list] = ([], [], [])
    for i, q in enumerate(queries):
        files = [slice(begins[p], begins[p + 1]) for p in own[i]]
        at = np.concatenate([rows[f] for f in files])
        gain = np.concatenate([prefix - np.maximum(places[f], r) for r, f in enumerate(files)])
        near = np.bincount(at, gain, len(entries))
        found = np.argpartition(-near, depth - 1)[:depth] if depth < len(entries) else np.arange(len(entries))
        rough = entries[found] @ q
        if len(found) > k + 1:  # with the query's own entry
            edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            found = found[rough >= edge - 1e-9 * (1 + abs(edge))]
        exact = (entries[found] * q).sum(axis=1)
        flat = [np.arange(members[e], members[e + 1]) for e in found]
        at = ids[np.concatenate(flat)]
        score = np.repeat(exact, [len(f) for f in flat])
        other = at != query_ids[i]
        at, score = at[other], score[other]
        best = np.lexsort((at, -score))[:k]
        out[0].append(np.full(len(best), query_ids[i]))
        out[1].append(at[best])
        out[2].append(score[best])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def _packed(rows: DataFrame, dim: int, pivots: np.ndarray | None = None, prefix: int = PREFIX) -> DataFrame:
    """(part, id, vector) as one row of packed arrays for each part, with ``pivots`` its inverted files too; parts are bounded by construction."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        ids, vectors = part["id"].to_numpy(dtype="<i8"), padded(part["vector"].to_list(), dim)
        made = {"ids": ids, "vectors": vectors} if pivots is None else shard_of(ids, vectors, pivots, prefix)
        return pd.DataFrame({"part": [key[0]]} | {c: [x.tobytes()] for c, x in made.items()})

    return common.stored(rows.groupBy("part").applyInPandas(pack, PACKED if pivots is None else SHARDED), "vectors")


TYPES = {"ids": "<i8", "vectors": "<f8", "members": "<i4", "begins": "<i4", "rows": "<i4", "places": "<i2"}


def _search(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, **how) -> Iterator[pa.RecordBatch]:
    dim = pivots.shape[1]
    for batch in batches:
        for row in batch.to_pylist():
            shard = {c: np.frombuffer(row[c], t) for c, t in TYPES.items()}
            shard["vectors"] = shard["vectors"].reshape(-1, dim)
            q, x, s = search_shard(shard, np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["queries"], "<f8").reshape(-1, dim), pivots, **how)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(
    table: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest that each query finds among all rows but its own id's.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do null ids. Of vectors of unlike lengths the
    shorter ones count as having zeros at their end. Fewer than ``k`` candidates: all of them. Rows that repeat id and vector count once; an id with several vectors
    asks with each of them, and its answers are ranked together. Ids are numbers. Empty tables: no rows.
    """
    spark = table.sparkSession
    common.python_ready(spark, 16)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    known = rows.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("dim"), F.count_if("is_query").alias("queries")).collect()[0]
    if not known["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = known["dim"], known["rows"]
    drawn = rows.where(common.share_below(4 * pivots / total, "pivot", F.col("id"))).select("vector").collect()  # about 4 * pivots rows
    marks = np.unique(padded([np.array(r["vector"]) for r in drawn], dim), axis=0)
    if not len(marks):  # a few rows, of which chance took none
        marks = padded([np.array(r["vector"]) for r in rows.select("vector").limit(pivots).collect()], dim)
    marks = marks[np.random.default_rng(3).permutation(len(marks))[:pivots]]
    shards, blocks = -(-total // shard_rows), -(-known["queries"] // block_rows)
    same = W.partitionBy("vector").orderBy("id")
    index = rows.select("id", "vector").dropDuplicates().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    index = _packed(index.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("part"), "id", "vector"), dim, marks, prefix)
    queries = rows.where("is_query").dropDuplicates(["id", "vector"])
    queries = _packed(queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part"), "id", "vector"), dim)
    queries = queries.select(F.col("part").alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    pairs = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, "part").repartition(int(shards * blocks), "part", "block")
    how = {"k": k, "prefix": prefix, "share": share}
    found = pairs.mapInArrow(common.in_arrow(lambda b: _search(b, marks, **how)), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
