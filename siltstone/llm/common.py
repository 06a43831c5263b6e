"""What the operators of this package share: tables, shared storage, batch sizes."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import shared_dir

#: ASCII white space that ends a word, as a character class for Java and RE2 patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under this application's part of the shared folder."""
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has stored; for when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` texts and BATCH_BYTES at most, which bound a Python worker's memory, and this package on the workers' path.

    The options stay: plans are lazy, and run after an operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def _give_back() -> None:
    """Returns the memory that a worker no longer uses: workers are used again, and what they keep adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow(): its worker gives memory back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def n_words(text: Column) -> Column:
    """Number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_below(share: float, seed: str, *columns: Column) -> Column:
    """Whether a hash of ``columns`` falls in the first ``share`` of all hashes: a sample without an order, so nothing is gathered."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) < F.lit(int(min(1.0, share) * (1 << 53)))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (stored, so that counting is cheap) to broadcast where it has ``rows`` rows at most; any more and it is joined as usual."""
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark prunes the large side of a join that runs there, before it shuffles, by a Bloom filter of the other side's keys.

    The filter is what is broadcast, and Spark bounds it (maxNumBits, 8 MB), whatever the number of keys; with more keys it
    prunes less and the join stays right.
    """
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "100g"}
    held = {k: spark.conf.get(f"spark.sql.optimizer.runtime.bloomFilter.{k}") for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{k}", v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{k}", v)


def pruning(keys: DataFrame, what: str) -> DataFrame:
    """``keys`` stored, as the side of a join that runtime_filters() builds a filter from (Spark asks for a selective predicate)."""
    return stored(keys.withColumn("_side", F.lit(1)), what).where("_side = 1").drop("_side")
