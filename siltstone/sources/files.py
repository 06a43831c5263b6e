"""Sources and sinks: benchmark CSV, labels and results in JSON, filings as text, chunk and fact tables, manifests."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import corpus as C
from siltstone.sources.versions import KeyedTable, Versions, write_table

BENCHMARK = ("id", "ticker", "question", "ground_truth", "reference_contexts", "question_type", "section", "difficulty", "requires_table", "notes")
RESULT = "schema_version int, result_kind string, run_id string, run_status string, benchmark_version string, config map<string,string>, aggregates map<string,double>, results array<struct<id:string,question_type:string,answer:string,terminal_failure:string,latency_ms:double,input_tokens:long,output_tokens:long,cost_usd:double,retrieved_chunk_ids:array<string>,observations:array<string>>>"


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions, all columns strings; missing columns and repeated ids are errors."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n").csv(path)
    if lost := [c for c in BENCHMARK[:5] if c not in rows.columns]:
        raise ValueError(f"{path} lacks {lost}")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError(f"{path} repeats ids")
    return rows


def write_benchmark(rows: DataFrame, path: str) -> None:
    """Labelled questions as CSV, as read_benchmark() takes them: whole texts, with their line ends and the white space around them."""
    if lost := [c for c in BENCHMARK[:5] if c not in rows.columns]:
        raise ValueError(f"a benchmark lacks {lost}")
    columns = [c for c in BENCHMARK if c in rows.columns]
    rows.select(*columns).write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_labels(labels: DataFrame, path: str, files: int = 16) -> None:
    """(id, label) as JSON files with a map ``items``, as read_labels() takes them: each id in one of ``files`` files by its hash, so that no task holds all. A repeated id is an error."""
    rows = labels.select(F.col("id").cast("string").alias("id"), "label").withColumn("file", F.pmod(F.xxhash64("id"), F.lit(files)))
    rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("items")).write.partitionBy("file").json(path)


def read_labels(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(id, label) from a JSON file with a map ``items``; ``item`` is the label's type."""
    rows = spark.read.schema(f"items map<string,{item}>").option("multiLine", True).json(path)
    return rows.select(F.explode("items").alias("id", "label"))


def read_results(spark: SparkSession, path: str, benchmark_version: str | None = None) -> DataFrame:
    """Retrieval results files, one row each; files that can't be read are skipped, as are those without aggregates."""
    rows = spark.read.schema(RESULT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))
    rows = rows.where("result_kind = 'retrieval' and aggregates is not null")
    return rows.where(F.col("benchmark_version") == benchmark_version) if benchmark_version else rows


def records(results: DataFrame) -> DataFrame:
    """One row per result record, old ones with the defaults of new ones."""
    rows = results.select("path", "run_id", F.explode("results").alias("r")).select("path", "run_id", "r.*")
    empty = F.array().cast("array<string>")
    return rows.withColumns({"retrieved_chunk_ids": F.coalesce("retrieved_chunk_ids", empty), "observations": F.coalesce("observations", empty)})


#: The company in a filing's path: its folder, or the one above a folder for the form and one for the filing.
COMPANY = r"([^/]+)/(?:10-K/[^/]+/)?[^/]+\.txt$"


def newest_filings(spark: SparkSession, root: str, company: str = COMPANY) -> DataFrame:
    """(ticker, path, text): the last filing of each company by path, decoded as Latin-1; names of filings sort by their time.

    ``company`` is a pattern whose group is the company in a path. Which file is the last is told from the listing; only those files are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    named = files.select(F.regexp_extract("path", company, 1).alias("ticker"), "path")
    last = named.groupBy("ticker").agg(F.max("path").alias("path"))
    return files.select("path", "content").join(last, "path").select("ticker", "path", F.decode("content", "ISO-8859-1").alias("text"))


def _listed(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """What ``load`` reads, its folders listed by four tasks a core at most: a task for each of them, up to 10,000, takes longer to start than to list."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    held, most = spark.conf.get(key, None), 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(key, str(min(int(spark.conf.get(key)), most)))
    try:
        return load()
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of text files under a folder, whole: their bytes as they are."""
    rows = _listed(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root))
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("text"))


def write_texts(rows: DataFrame, path: str, folders: list[str], text: str) -> None:
    """A text file for each row, ended by a line end, in the folder of its values as partitions are laid out; as read_texts() takes them.

    Tasks write into a ``file:`` folder by themselves, as Hadoop starts a process there for the mode of each file and folder; other file systems have Spark's sink.
    Values are names that a path can hold.
    """
    if not (out := Stored(rows.sparkSession, path)).local:
        rows.select(*folders, text).write.partitionBy(*folders).text(path)
        return
    root = out.fs.makeQualified(out.path).toUri().getPath()
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in folders])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                os.makedirs(f"{root}/{at}", exist_ok=True)
                name, made = f"part-{task.partitionId():05d}-{n}.txt", f"{root}/{at}/.{task.taskAttemptId()}-{n}"
                with open(made, "wb") as f:
                    f.write((content or b"") + b"\n")
                os.replace(made, f"{root}/{at}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.select(folder.alias("folder"), F.col(text).cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    out.fs.mkdirs(out.path)
    Stored(rows.sparkSession, f"{path}/_SUCCESS").touch()


def chunk_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, chunk_idx, chunk) of every text file under a folder; chunks of a file are counted from 0."""
    return C.chunks(read_texts(spark, root), ["path"], "text")


def write_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks by company, so that a filter on one reads its folder only; readers see the old ones until all new ones are there."""
    return write_table(chunks, path, "ticker")


def write_facts(facts: DataFrame, filings: DataFrame, path: str) -> None:
    """Both tables, built anew and seen together or not at all; facts in ranges of company and concept, so that no company falls to one task and a look-up skips files."""
    versions = Versions(facts.sparkSession, path)
    after, folder = versions.last(), versions.folder("data")
    facts.repartitionByRange("ticker", "concept", "fiscal_year").sortWithinPartitions("ticker", "concept", "fiscal_year").write.partitionBy("ticker").parquet(f"{folder}/facts")
    filings.write.parquet(f"{folder}/filings")
    versions.commit({"data": folder.rsplit("/", 1)[1]}, after)


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The last facts and filings at ``path``; an error where there are none."""
    state = Versions(spark, path).read()
    if state is None:
        raise FileNotFoundError(f"there is no fact table at {path}")
    return spark.read.parquet(f"{path}/{state['data']}/facts"), spark.read.parquet(f"{path}/{state['data']}/filings")


def load_or_build(spark: SparkSession, path: str, expected: int, build) -> DataFrame:
    """A stored index if its manifest has the expected row count, else one built and stored now.

    The manifest says how many rows were written; a build that doesn't give the expected count is an error, and isn't kept.
    """
    manifest = Stored(spark, f"{path}/manifest")
    if manifest.exists() and (held := spark.read.schema("rows long").json(f"{path}/manifest").first()) and held["rows"] == expected:
        return spark.read.parquet(f"{path}/data")
    manifest.delete()  # from here to the end there is no index
    build().write.mode("overwrite").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    if (rows := data.count()) != expected:
        raise ValueError(f"the index at {path} has {rows} rows, {expected} are expected")
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return data


class Stored:
    """A path in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    @property
    def local(self) -> bool:
        return self.fs.getUri().getScheme() == "file"

    def touch(self) -> None:
        self.fs.create(self.path).close()

    def delete(self) -> None:
        self.fs.delete(self.path, True)


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str) -> DataFrame:
    """The table at ``path`` with ``rows`` put in by ``key``: of a key that both have the new row stays. Nothing to put in changes nothing."""
    return KeyedTable(spark, path, key).put(rows)


def index_chunks(chunks: DataFrame, ticker: str = "ticker", source: str = "source") -> DataFrame:
    """Chunks (ticker, source, chunk_idx, text) with their id; a chunk without a source has an empty one."""
    symbol = F.upper(F.col(ticker))
    return chunks.select(T.chunk_id(symbol, F.col("chunk_idx")).alias("chunk_id"), symbol.alias("ticker"), F.coalesce(F.col(source), F.lit("")).alias("source"), "chunk_idx", "text")


def write_results(rows: DataFrame, path: str) -> None:
    """Records as JSON lines; readers see the old ones until all new ones are there, and a write that fails leaves the old ones."""
    versions = Versions(rows.sparkSession, path)
    after, folder = versions.last(), versions.folder("data")
    rows.write.json(folder)
    versions.commit({"data": folder.rsplit("/", 1)[1]}, after)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that write_results() stored; a cache that isn't there, or lines that can't be read, hold nothing."""
    state = Versions(spark, path).read()
    if state is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(f"{path}/{state['data']}")
    return rows.where("_broken is null").drop("_broken")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """(conversation, kind, turn, question, ground_truth, depends_on_history) of a probe's conversations."""
    turn = "struct<question:string,ground_truth:string,depends_on_history:boolean>"
    rows = spark.read.schema(f"conversations array<struct<id:string,kind:string,turns:array<{turn}>>>").option("multiLine", True).json(path)
    rows = rows.select(F.explode("conversations").alias("c")).select(F.col("c.id").alias("conversation"), F.col("c.kind").alias("kind"), F.posexplode("c.turns").alias("turn", "t"))
    return rows.select("conversation", "kind", "turn", "t.*")


def read_gate(spark: SparkSession, path: str, lower_is_better: tuple[str, ...] = ("terminal_failures", "unexplained_nan")) -> DataFrame:
    """(scope, metric, threshold, higher_is_better) of a gate file's retrieval configurations and its judged section."""
    schema = "retrieval struct<configs:array<struct<label:string,thresholds:map<string,double>>>>, judged struct<thresholds:map<string,double>,max_terminal_failures:double>"
    gate = spark.read.schema(schema).option("multiLine", True).json(path)
    configs = gate.select(F.explode("retrieval.configs").alias("c")).select(F.col("c.label").alias("scope"), F.explode("c.thresholds").alias("metric", "threshold"))
    limits = F.map_concat("judged.thresholds", F.create_map(F.lit("terminal_failures"), F.coalesce("judged.max_terminal_failures", F.lit(0.0)), F.lit("unexplained_nan"), F.lit(0.0)))
    judged = gate.where("judged is not null").select(F.lit("judged").alias("scope"), F.explode(limits).alias("metric", "threshold"))
    return configs.unionByName(judged).withColumn("higher_is_better", ~F.col("metric").isin(*lower_is_better))
