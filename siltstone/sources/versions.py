"""Tables and indexes whose state is one small file: writers put new folders beside what is there and then a file that names
them; readers take the last such file. What fails half-way leaves folders that no file names, and what was there stays."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


class Versions:
    """The versions of what lies under ``path``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.root = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def folder(self, what: str) -> str:
        """A new folder for data that the next version may name."""
        return f"{self.root}/{what}-{uuid.uuid4().hex}"

    def last(self) -> int:
        """Number of the last version, 0 if there is none."""
        at = self._path(f"{self.root}/versions")
        if not self.fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(at)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> dict | None:
        """What a version says, the last one by default; None if there is none."""
        version = self.last() if version is None else version
        if not version:
            return None
        rows = self.spark.read.text(f"{self.root}/versions/v{version:012d}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0]["value"])

    def commit(self, state: dict, after: int) -> int:
        """Makes ``state`` the version that follows ``after``; raises Conflict if another writer has made it."""
        version = after + 1
        final, draft = self._path(f"{self.root}/versions/v{version:012d}.json"), self._path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"{self.root} has a version {version} already")
        return version

    def vacuum(self) -> int:
        """Deletes folders that the last version doesn't name, and says how many; for when nobody reads older versions or writes."""
        state = json.dumps(self.read() or {})
        names = [f.getPath() for f in self.fs.listStatus(self._path(self.root)) if f.isDirectory()]
        gone = [p for p in names if p.getName() != "versions" and p.getName() not in state]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)


def write_table(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """``df`` as the table at ``path``: whoever reads sees the old rows until all new ones are there. Returns the table read again."""
    versions = Versions(df.sparkSession, path)
    after, folder = versions.last(), versions.folder("data")
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    versions.commit({"data": folder.rsplit("/", 1)[1], "schema": df.schema.json()}, after)
    return read_table(df.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table that write_table() made; an error where there is none."""
    state = Versions(spark, path).read()
    if state is None:
        raise FileNotFoundError(f"there is no table at {path}")
    schema = StructType.fromJson(json.loads(state["schema"]))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{state['data']}").select(*[f"`{c}`" for c in schema.names])


BUCKETS = 64


class KeyedTable:
    """A table by a key, in buckets of the key's hash: rows that are put replace those of their keys, and only the buckets that they fall in are written again."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.key = spark, key
        self.versions = Versions(spark, path)
        self.buckets = (self.versions.read() or {"n": buckets})["n"]

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int"))

    def put(self, rows: DataFrame) -> DataFrame:
        """The table with ``rows`` in it: of a key that both have the new rows stay. Nothing to put in changes nothing; new columns are null in old rows."""
        after, state = self.versions.last(), self.versions.read()
        fresh = self._bucket(rows)
        folder = self.versions.folder("data")
        name = folder.rsplit("/", 1)[1]
        if state is not None:
            touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())  # a row a bucket
            if not touched:
                return self.read()
            held = self._read(state, [state["at"][str(b)] for b in touched if str(b) in state["at"]])
            if held is not None:
                fresh = self._bucket(held).join(rows.select(self.key).distinct(), self.key, "left_anti").unionByName(fresh, allowMissingColumns=True)
        fresh.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        schema = fresh.drop("_bucket").schema
        written = [p.getPath().getName() for p in self.versions.fs.listStatus(self.versions._path(folder)) if p.isDirectory() and p.getPath().getName().startswith("_bucket=")]
        at = (state or {"at": {}})["at"] | {w.split("=")[1]: f"{name}/{w}" for w in written}
        self.versions.commit({"n": self.buckets, "at": at, "schema": schema.json()}, after)
        return self.read()

    def _read(self, state: dict, places: list[str]) -> DataFrame | None:
        if not places:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(state["schema"]))).parquet(*[f"{self.versions.root}/{p}" for p in places])

    def read(self) -> DataFrame:
        state = self.versions.read()
        if state is None:
            raise FileNotFoundError(f"there is no table at {self.versions.root}")
        held = self._read(state, sorted(set(state["at"].values())))
        return held if held is not None else self.spark.createDataFrame([], StructType.fromJson(json.loads(state["schema"])))
