"""Ingestion as a stream: files that arrive become chunks, a quarantine and an index to search, each batch once.

Every batch writes its chunks and what it couldn't read into folders of its own and then a version that names them; a batch
that a version names already, because a run stopped between writing and saying so, changes nothing. The index takes a
batch's chunks under the batch's number, so that it takes them once too.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from siltstone.operators.inverted import TermIndex
from siltstone.session import on_workers
from siltstone.sources.versions import Versions

Make = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Ingested:
    """What has been ingested into ``path``: chunks, quarantine, and an index over the chunks' ``chunk_id`` and ``text``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)

    def _state(self) -> dict:
        return self.versions.read() or {"batches": {}, "schemas": {}}

    def take(self, rows: DataFrame, batch: int, make: Make, index: bool = True) -> bool:
        """Ingests the rows of a batch; false if it had been ingested before. ``make`` gives chunks and what couldn't be read."""
        after, state = self.versions.last(), self._state()
        fresh = str(batch) not in state["batches"]
        if fresh:
            held = {}
            for what, df in zip(("chunks", "quarantine"), make(rows), strict=True):
                folder = self.versions.folder(f"{what}-{batch}")
                df.write.parquet(folder)
                held[what] = folder.rsplit("/", 1)[1]
                state["schemas"][what] = df.schema.json()
            state["batches"][str(batch)] = held
            self.versions.commit(state, after)
        if index:  # of a batch that stopped before it came here, too
            self.index().put(self.spark.read.parquet(f"{self.path}/{state['batches'][str(batch)]['chunks']}"), "chunk_id", "text", batch=batch)
        return fresh

    def read(self, what: str = "chunks") -> DataFrame:
        """The chunks, or the ``quarantine``, of all batches."""
        state = self._state()
        if not state["batches"]:
            raise FileNotFoundError(f"nothing has been ingested into {self.path}")
        return reduce(DataFrame.unionByName, [self.spark.read.schema(StructType.fromJson(json.loads(state["schemas"][what]))).parquet(f"{self.path}/{b[what]}") for b in state["batches"].values()])

    def index(self) -> TermIndex:
        return TermIndex.open(self.spark, f"{self.path}/index")


def run(files: DataFrame, path: str, make: Make, index: bool = True) -> Ingested:
    """Ingests what a file stream has now, batch by batch, and returns what is there; started again it goes on where it stopped."""
    spark = files.sparkSession
    on_workers(spark)
    held = Ingested(spark, path)
    writer = files.writeStream.foreachBatch(lambda rows, batch: held.take(rows, batch, make, index)).option("checkpointLocation", f"{held.path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return held


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
