"""Exact nearest vectors by inner product, under a filter, for any number of questions.

Questions are dealt to blocks of QUERY_BLOCK by the value that they filter on, vectors to shards of SHARD rows. A block
meets each shard of the vectors that it may find: one matrix product for each Arrow batch of vectors, and the block's best so far are merged
with those of the batch. A task holds one block of questions, their best and a batch of vectors, whatever the sizes of both
tables or of a filter's value; the best of all shards are then merged by question.

Up to HELD questions go to all tasks as they are, so that vectors don't move; beyond, both sides are shuffled by (block, shard).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.session import on_workers, stored

HELD, QUERY_BLOCK, SHARD = 4096, 4096, 1 << 18
PLACES = 12  # of a score when it ranks: sums in another order differ beyond them


def _matrix(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors of ``width`` that are whole: not null, without null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(sizes.max()) if len(sizes) else 0
    at = np.flatnonzero(sizes == width)
    if not len(at) or width <= 0:
        return np.zeros(0, np.int64), np.zeros((0, max(width, 0)))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    rows = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = np.isfinite(rows).all(axis=1)
    return at[good], rows[good]


class Best:
    """The ``k`` best of each question so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, others: bool) -> None:
        self.ids, self.matrix, self.k, self.others = ids, matrix, k, others
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(ids)
        self.docs: list[np.ndarray] = [np.zeros(0, object)] * len(ids)

    def add(self, docs: np.ndarray, rows: np.ndarray, questions: np.ndarray | None = None) -> None:
        """Meets a batch of vectors; ``questions`` are the places of those that may find them, all by default."""
        which = np.arange(len(self.ids)) if questions is None else questions
        if not len(which) or not len(docs):
            return
        scores = np.round(self.matrix[which] @ rows.T, PLACES)
        for i, own in zip(which.tolist(), scores, strict=True):
            if self.others:
                own = np.where(docs == self.ids[i], -np.inf, own)
            floor = self.scores[i][-1] if len(self.scores[i]) == self.k else -np.inf
            if len(own) > self.k:
                floor = max(floor, np.partition(own, -self.k)[-self.k])
            near = np.flatnonzero((own >= floor) & (own > -np.inf))
            if not len(near):
                continue
            both, names = np.concatenate([self.scores[i], own[near]]), np.concatenate([self.docs[i], docs[near].astype(object)])
            order = np.argsort(names, kind="stable")
            order = order[np.argsort(-both[order], kind="stable")][: self.k]
            self.scores[i], self.docs[i] = both[order], names[order]

    def rows(self, id_type: pa.DataType, doc_type: pa.DataType) -> pa.RecordBatch:
        many = [len(s) for s in self.scores]
        ids = np.repeat(np.array(self.ids, dtype=object), many)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, object)
        scores = np.concatenate(self.scores) if self.scores else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(ids.tolist(), id_type), pa.array(scores, pa.float64()), pa.array(docs.tolist(), doc_type)], names=["query_id", "score", "doc_id"])


def _names(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _beside(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, wanted: list, k: int, others: bool, types: tuple) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, value, v) against all questions, which every task has."""
    best = Best(ids, matrix, k, others)
    free = np.array([i for i, w in enumerate(wanted) if w is None], dtype=np.int64)
    bound: dict = {}
    for i, w in enumerate(wanted):
        if w is not None:
            bound.setdefault(w, []).append(i)
    for batch in batches:
        at, rows = _matrix(batch.column(2), matrix.shape[1])
        docs = _names(batch.column(0).take(pa.array(at)))
        best.add(docs, rows, free)
        if bound:
            values = _names(batch.column(1).take(pa.array(at)))
            for value, questions in bound.items():
                own = np.flatnonzero(values == value)
                best.add(docs[own], rows[own], np.array(questions))
    yield best.rows(*types)


def _unit(batches: Iterator[pa.RecordBatch], k: int, others: bool, types: tuple) -> Iterator[pa.RecordBatch]:
    """Rows (unit, is_doc, query_id, doc_id, v), sorted by the first two: a block's questions, then the vectors of a shard."""
    unit, best, asked = None, None, []
    for batch in batches:
        units, is_doc = batch.column(0).to_pylist(), np.asarray(batch.column(1))
        edges = [i for i in range(len(units)) if i == 0 or units[i] != units[i - 1] or is_doc[i] != is_doc[i - 1]]
        for p, q in zip(edges, [*edges[1:], len(units)], strict=True):
            if units[p] != unit:
                if best is not None:
                    yield best.rows(*types)
                unit, best, asked = units[p], None, []
            part = batch.slice(p, q - p)
            if not is_doc[p]:
                asked.append(part)
                continue
            if best is None:
                table = pa.Table.from_batches(asked) if asked else part.slice(0, 0)
                at, matrix = _matrix(table.column(4), None)
                best = Best(_names(table.column(2).take(pa.array(at))), matrix, k, others)
                asked = []
            at, rows = _matrix(part.column(4), best.matrix.shape[1])
            best.add(_names(part.column(3).take(pa.array(at))), rows)
    if best is not None:
        yield best.rows(*types)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "vector", wanted: str | None = None, id_col: str = "doc_id", vector_col: str = "vector",
    value_col: str | None = None, others: bool = False, held: int = HELD, block: int = QUERY_BLOCK, shard: int = SHARD,
) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` largest inner products of each question in double precision, ties to the smaller id.

    With ``wanted`` a question finds only vectors whose ``value_col`` is what its ``wanted`` says; null finds all. With ``others`` it
    doesn't find the vector of its own id. Vectors that are null, of another width than the questions' widest or not finite, and rows without an id, take no part. Questions
    that repeat an id count one by one in what a task keeps and meet in the rank.
    """
    on_workers(vectors.sparkSession)
    none = F.lit(None).cast("string")
    q = queries.select(F.col(f"`{query_id}`").alias("query_id"), (F.col(f"`{wanted}`").cast("string") if wanted else none).alias("wanted"), F.col(f"`{query_vector}`").alias("v")).where("query_id is not null and v is not null and size(v) > 0")
    d = vectors.select(F.col(f"`{id_col}`").alias("doc_id"), (F.col(f"`{value_col}`").cast("string") if value_col else none).alias("value"), F.col(f"`{vector_col}`").alias("v")).where("doc_id is not null and v is not null")
    q_type, d_type = q.schema["query_id"].dataType, d.schema["doc_id"].dataType
    types = (to_arrow_type(q_type), to_arrow_type(d_type))
    schema = f"query_id {q_type.simpleString()}, score double, doc_id {d_type.simpleString()}"
    few = q.limit(held + 1).collect() if held else []
    if few and len(few) <= held:  # a checked bound: these go with the task's code
        width = max(len(r["v"]) for r in few)
        whole = [r for r in few if len(r["v"]) == width and all(x is not None and np.isfinite(x) for x in r["v"])]
        ids, matrix = np.array([r["query_id"] for r in whole], dtype=object), np.array([r["v"] for r in whole], dtype=np.float64).reshape(len(whole), width)
        filters = [r["wanted"] for r in whole]
        scored = d.mapInArrow(lambda batches: _beside(batches, ids, matrix, filters, k, others, types), schema)
    else:
        width = q.agg(F.max(F.size("v"))).first()[0] or 0
        q = q.where(F.size("v") == width)
        shards = max(1, -(-d.count() // shard))
        blocks = stored(q.groupBy("wanted").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).withColumnRenamed("wanted", "filter"), "blocks")
        free = (blocks.where("filter is null").first() or {"parts": 0})["parts"]
        units = lambda value, part, at: F.struct(value.alias("value"), part.cast("long").alias("part"), at.cast("long").alias("shard"))
        place, at = F.pmod(F.xxhash64("query_id"), F.col("parts")), F.pmod(F.xxhash64("doc_id"), F.lit(shards))
        asked = q.join(blocks.where("filter is not null"), F.col("wanted") == F.col("filter")).select("wanted", "parts", "query_id", "v") if wanted else None
        if free:
            every = q.where("wanted is null").select("wanted", F.lit(free).alias("parts"), "query_id", "v")
            asked = every if asked is None else asked.unionByName(every)
        if asked is None:
            asked = q.limit(0).select("wanted", F.lit(1).alias("parts"), "query_id", "v")
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(units(F.col("wanted"), place, F.col("shard")).alias("unit"), F.lit(False).alias("is_doc"), "query_id", F.lit(None).cast(d_type).alias("doc_id"), "v")
        own = None
        if wanted and value_col:
            own = d.join(blocks.where("filter is not null"), F.col("value") == F.col("filter")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(units(F.col("value"), F.col("part"), at).alias("unit"), "doc_id", "v")
        if free:
            every = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(free - 1)))).select(units(none, F.col("part"), at).alias("unit"), "doc_id", "v")
            own = every if own is None else own.unionByName(every)
        if own is None:
            own = d.limit(0).select(units(none, F.lit(0), at).alias("unit"), "doc_id", "v")
        own = own.select("unit", F.lit(True).alias("is_doc"), F.lit(None).cast(q_type).alias("query_id"), "doc_id", "v")
        met = asked.unionByName(own).withColumn("unit", F.to_json("unit")).repartition("unit").sortWithinPartitions("unit", "is_doc")
        scored = met.mapInArrow(lambda batches: _unit(batches, k, others, types), schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
