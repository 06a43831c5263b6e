"""Queries over files: benchmarks, labels, results, gates and filings that are written from the tables, once for each state of
these, and read by the library's sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import metrics as M
from siltstone.operators import runs as R
from siltstone.operators import verify as V
from siltstone.plans import runs as P
from siltstone.plans.catalog import query
from siltstone.session import place_of, table
from siltstone.sources import files
from siltstone.sources.files import Stored


def _written(spark: SparkSession, sf_dir: str, name: str, what: str, write: Callable[[DataFrame, str], None]) -> str:
    """The folder of files that ``write`` makes of a table; whole ones are read again, others made anew."""
    path = f"{place_of(spark, sf_dir, name, what)}/files"
    if not Stored(spark, f"{path}/_SUCCESS").exists():
        Stored(spark, path).delete()
        write(table(spark, sf_dir, name), path)
    return path


# benchmarks and labels


@query(
    "benchmark_file",
    "SELECT 'Q' || item_id AS id, 'T' || item_id % 5 AS ticker, text || ' \"?\"' AS question, '  ' || text AS ground_truth, text || ' || ' || text || '1' AS reference_contexts, CASE item_id % 2 WHEN 0 THEN 'lookup' ELSE 'trend' END AS question_type FROM benchmark",
)
def benchmark_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled questions written as CSV and read again, with their line ends, quotes and white space."""
    item = F.col("item_id")

    def write(rows: DataFrame, path: str) -> None:
        files.write_benchmark(
            rows.select(
                F.concat(F.lit("Q"), item.cast("string")).alias("id"), F.concat(F.lit("T"), (item % 5).cast("string")).alias("ticker"), F.concat("text", F.lit(' "?"')).alias("question"), F.concat(F.lit("  "), "text").alias("ground_truth"),
                F.concat("text", F.lit(" || "), "text", F.lit("1")).alias("reference_contexts"), F.when(item % 2 == 0, "lookup").otherwise("trend").alias("question_type"),
            ),
            path,
        )

    return files.read_benchmark(spark, _written(spark, sf_dir, "benchmark", "benchmark", write))


@query("label_files", "SELECT doc_id::VARCHAR AS id, quality, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS note FROM labels")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by item, from JSON files with a map."""
    label = F.struct("quality", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("note")).alias("label")
    path = _written(spark, sf_dir, "labels", "labels", lambda rows, to: files.write_labels(rows.select(F.col("doc_id").alias("id"), label), to))
    return files.read_labels(spark, path, "struct<quality:int,note:string>").select("id", "label.*")


# results of retrieval runs

#: A run is a block of a thousand events, so that no results file grows with the table.
RUN, VERSION = "event_id // 1000", "CASE WHEN event_id // 1000 % 3 = 0 THEN 'v1' ELSE 'v2' END"


def _results(spark: SparkSession, sf_dir: str) -> str:
    event, run = F.col("event_id"), F.floor(F.col("event_id") / 1000)

    def write(rows: DataFrame, path: str) -> None:
        record = F.struct(F.concat(F.lit("e"), event.cast("string")).alias("id"), F.col("event_type").alias("question_type"), F.col("value").alias("latency_ms"), F.when(event % 2 == 0, F.array("event_type")).alias("observations"))
        made = rows.groupBy(run.alias("run")).agg(F.collect_list(record).alias("results"), F.round(F.avg("value"), 4).alias("mean"), F.max(F.col("value")).alias("most"))
        kind = F.when(F.col("run") % 5 == 4, "generation").otherwise("retrieval")
        held = F.when(F.col("run") % 7 != 6, F.create_map(F.lit("mean"), "mean", F.lit("most"), "most"))
        version = F.when(F.col("run") % 3 == 0, "v1").otherwise("v2")
        made.select("run", F.lit(3).alias("schema_version"), kind.alias("result_kind"), F.concat(F.lit("r"), F.col("run").cast("string")).alias("run_id"), version.alias("benchmark_version"), held.alias("aggregates"), "results").write.partitionBy("run").json(path)

    return _written(spark, sf_dir, "events", "results", write)


TAKEN = f"SELECT {RUN} AS run, {VERSION} AS version, * FROM events WHERE {RUN} % 5 <> 4 AND {RUN} % 7 <> 6"


@query("result_runs", f"SELECT 'r' || run AS run_id, round(avg(value), 4) AS mean, max(value) AS most, count(*) AS n FROM ({TAKEN}) WHERE version = 'v1' GROUP BY run")
def result_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval runs of one benchmark version; generation runs and runs without aggregates are left out."""
    runs = files.read_results(spark, _results(spark, sf_dir), "v1")
    return runs.select("run_id", F.element_at("aggregates", F.lit("mean")).alias("mean"), F.element_at("aggregates", F.lit("most")).alias("most"), F.size("results").cast("long").alias("n"))


@query("result_records", f"SELECT 'r' || run AS run_id, 'e' || event_id AS id, event_type AS question_type, value AS latency_ms, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_observations, 0 AS n_retrieved FROM ({TAKEN})")
def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all retrieval runs, old ones with the defaults of new ones."""
    rows = files.records(files.read_results(spark, _results(spark, sf_dir)))
    return rows.select("run_id", "id", "question_type", "latency_ms", F.size("observations").alias("n_observations"), F.size("retrieved_chunk_ids").alias("n_retrieved"))


# gates


@query(
    "gate_files",
    """WITH m AS (SELECT source, avg(n_chars) AS chars, count(*) AS docs FROM documents GROUP BY source) SELECT source AS scope, 'chars' AS metric, 5000.0::DOUBLE AS threshold, chars AS value, chars >= 5000 AS passed FROM m
 UNION ALL SELECT source, 'docs', 100, docs::DOUBLE, docs >= 100 FROM m UNION ALL SELECT source, 'absent', 0, NULL, false FROM m""",
)
def gate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of a gate file for each source, against what its documents have; what isn't measured fails."""

    def write(rows: DataFrame, path: str) -> None:
        limits = F.create_map(F.lit("chars"), F.lit(5000.0), F.lit("docs"), F.lit(100.0), F.lit("absent"), F.lit(0.0))
        config = F.struct(F.array(F.struct(F.col("source").alias("label"), limits.alias("thresholds"))).alias("configs"))
        rows.select("source").distinct().select(F.col("source").alias("part"), config.alias("retrieval")).write.partitionBy("part").json(path)

    gate = files.read_gate(spark, _written(spark, sf_dir, "documents", "gate", write))
    per = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("scope")).agg(F.avg("n_chars").alias("chars"), F.count("*").cast("double").alias("docs"))
    measured = per.select("scope", F.inline(F.array(F.struct(F.lit("chars").alias("metric"), F.col("chars").alias("value")), F.struct(F.lit("docs").alias("metric"), F.col("docs").alias("value")))))
    rows = gate.join(measured, ["scope", "metric"], "left")
    return rows.select("scope", "metric", "threshold", "value", F.coalesce(F.when(F.col("higher_is_better"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")), F.lit(False)).alias("passed"))


CALIBRATED = P.BOTH.replace("FROM records)", "FROM records WHERE id IN (SELECT doc_id FROM labels))", 1)


@query("calibration_values", f"WITH {P.RECORDS}, {CALIBRATED}, {P.JUDGED_VALUES} SELECT * FROM jv")
def calibration_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A committed run over a gate's items, here the labelled documents."""
    return R.calibration_values(P.records(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), P.METRICS)


# filings


def _filings(spark: SparkSession, sf_dir: str) -> str:
    """A file for each page, in the folder of its company; five companies."""

    def write(rows: DataFrame, path: str) -> None:
        named = rows.select(F.concat(F.lit("T"), (F.col("page_id") % 5).cast("string")).alias("ticker"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("accession"), F.coalesce("html", F.lit("")).alias("value"))
        files.write_texts(named, path, ["ticker", "accession"], "value")

    return _written(spark, sf_dir, "pages", "filings", write)


@query(
    "newest_filings",
    "SELECT 'T' || page_id % 5 AS ticker, lpad(page_id::VARCHAR, 12, '0') AS accession, strlen(html) + 1 AS n_chars, sha256(html || chr(10)) AS bytes_sha256 FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id DESC) = 1",
)
def newest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last filing of each company: a character for each byte, none of them lost."""
    rows = files.newest_filings(spark, _filings(spark, sf_dir), r"ticker=([^/]+)/")
    return rows.select("ticker", F.regexp_extract("path", "accession=([^/]+)/", 1).alias("accession"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "ISO-8859-1"), 256).alias("bytes_sha256"))


@query("filing_texts", "SELECT lpad(page_id::VARCHAR, 12, '0') AS accession, html || chr(10) AS text FROM pages")
def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text files under a folder, whole, as UTF-8."""
    return files.read_texts(spark, _filings(spark, sf_dir)).select(F.regexp_extract("path", "accession=([^/]+)/", 1).alias("accession"), "text")


@query("directory_chunks")
def directory_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all files under a folder; a plain version is in the tests."""
    rows = files.chunk_directory(spark, _filings(spark, sf_dir))
    return rows.select(F.regexp_extract("path", "accession=([^/]+)/", 1).alias("accession"), "chunk_idx", "chunk")


# stored records


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of four runs, written as results and read again, with the runs and the label groups: a document is an item, asked in the run of its number."""
    n = F.col("doc_id")
    schema = (
        "run string, id long, question_type string, latency_ms double, llm_calls long, input_tokens long, output_tokens long, cost_usd double, terminal_failure string, error string, tools_used map<string,bigint>, retrieved array<string>, status string,"
        " attempts int, repaired boolean, failures array<string>, ground_truth string, answer string, draft_answer string, observations array<string>, labelled boolean, n_groups long, hit boolean, recall double, mrr double, first_rank int, scores map<string,double>"
    )

    def write(rows: DataFrame, path: str) -> None:
        said = lambda x: F.concat(F.lit("It was $"), x.cast("string"), F.lit(" million."))
        answer = said(F.when(n % 3 == 0, n * 10 + 3_000).otherwise(n * 10 + 907_003))
        made = rows.select(
            F.concat(F.lit("run"), (n % 4).cast("string")).alias("run"), n.alias("id"), F.when(n % 5 == 0, "").when(n % 5 < 3, "lookup").otherwise("trend").alias("question_type"), (F.col("n_chars") % 977).cast("double").alias("latency_ms"),
            F.lit(2).cast("long").alias("llm_calls"), (n % 100).alias("input_tokens"), (n % 10).alias("output_tokens"), F.lit(None).cast("double").alias("cost_usd"), F.lit(None).cast("string").alias("terminal_failure"), F.lit(None).cast("string").alias("error"),
            F.create_map(F.lit("search_filings"), F.lit(1).cast("long")).alias("tools_used"), F.when(n % 8 < 4, F.array(F.lit("x"), F.lit("b"))).otherwise(F.array(F.lit("x"))).alias("retrieved"), F.when(n % 7 == 0, "refused").otherwise("verified").alias("status"),
            F.lit(1).alias("attempts"), (n % 2 == 0).alias("repaired"), F.array().cast("array<string>").alias("failures"), said(n * 10 + 3_000).alias("ground_truth"), answer.alias("answer"), answer.alias("draft_answer"), F.when(n % 2 == 0, F.array(answer)).otherwise(F.array(F.lit("none"))).alias("observations"),
            F.lit(True).alias("labelled"), F.lit(9).cast("long").alias("n_groups"), F.lit(True).alias("hit"), F.lit(0.75).alias("recall"), F.lit(0.25).alias("mrr"), F.lit(4).alias("first_rank"), F.create_map(F.lit("faithfulness"), (n % 9) / 8.0).alias("scores"),
        )
        made.write.json(path)

    records = spark.read.schema(schema).json(_written(spark, sf_dir, "documents", "answered", write))
    runs = records.select("run").distinct().select("run", F.when(F.col("run") == "run3", "retrieval").otherwise("generation").alias("result_kind"), F.when(F.col("run") == "run1", "old").otherwise("now").alias("benchmark_version"), (F.col("run") != "run2").alias("has_aggregates"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1")
    groups = docs.select(n.alias("item_id"), F.inline(F.array(F.struct(F.lit(1).alias("group_id"), F.lit("b").alias("doc_id")), F.struct(F.lit(2).alias("group_id"), F.lit("c").alias("doc_id")))))
    return records, runs, groups


RECOMPUTED = """c AS (SELECT 'run' || doc_id % 4 AS run, doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 < 3 THEN 'lookup' ELSE 'trend' END AS question_type, (n_chars % 977)::DOUBLE AS latency_ms, doc_id % 3 = 0 AND doc_id % 7 <> 0 AS right_, doc_id % 2 AS odd,
  doc_id % 4 <> 1 AS same, doc_id % 3 <> 1 AS lab, doc_id % 8 < 4 AS got, (doc_id % 9) / 8.0::DOUBLE AS score FROM documents WHERE doc_id % 4 <> 3),
r AS (SELECT *, CASE WHEN same THEN lab ELSE true END AS labelled, CASE WHEN NOT same THEN true WHEN lab THEN got END AS hit, CASE WHEN NOT same THEN 0.75 WHEN lab THEN CASE WHEN got THEN 0.5 ELSE 0 END END::DOUBLE AS recall,
  CASE WHEN NOT same THEN 0.25 WHEN lab THEN CASE WHEN got THEN 0.5 ELSE 0 END END::DOUBLE AS mrr, CASE WHEN NOT same THEN 9 WHEN lab THEN 2 ELSE 0 END AS n_groups FROM c)"""


def _recomputed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records, runs, groups = _answered(spark, sf_dir)
    return R.recomputed(records, runs, groups, "now"), runs


@query("recomputed_records", f"WITH {RECOMPUTED} SELECT run, id, right_ AS figure_exact, (1 - odd)::INTEGER AS n_grounded, labelled, n_groups, hit, recall, mrr FROM r")
def recomputed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records by the present rules; those of a run on another index keep their agent retrieval."""
    return _recomputed(spark, sf_dir)[0].select("run", "id", "figure_exact", "n_grounded", "labelled", "n_groups", "hit", "recall", "mrr")


@query(
    "recomputed_aggregates",
    f"""WITH {RECOMPUTED}, b AS (SELECT run, 'overall' AS stratum, * EXCLUDE (run) FROM r UNION ALL SELECT run, question_type, * EXCLUDE (run) FROM r WHERE question_type <> '')
SELECT run, stratum, count(*) AS n_items, round(avg(score), 4) AS faithfulness_mean, round(avg(CASE WHEN right_ THEN 1.0 ELSE 0.0 END), 4) AS figure_exact_rate, count(*) FILTER (labelled) AS n_labelled,
 round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (labelled), 4) AS agent_hit_rate, round(avg(recall) FILTER (labelled), 4) AS agent_recall, round(avg(1.0 - odd), 4) AS grounded_rate, round(avg(latency_ms), 1) AS latency_ms_mean,
 {P.NEAR.format(v='latency_ms', p=50)} AS p50 FROM b WHERE run <> 'run2' GROUP BY run, stratum""",
)
def recomputed_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates made anew, for each run that had some."""
    made = R.recomputed_aggregates(*_recomputed(spark, sf_dir), ("faithfulness",))
    return made.select("run", "stratum", "n_items", "faithfulness_mean", "figure_exact_rate", "n_labelled", "agent_hit_rate", "agent_recall", "grounded_rate", "latency_ms_mean", "p50")


@query("recomputed_notes", "SELECT DISTINCT 'run' || doc_id % 4 AS run, doc_id % 4 <> 1 AS same_index, 1 AS figure_rules FROM documents WHERE doc_id % 4 <> 3")
def recomputed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recompute_notes(_answered(spark, sf_dir)[1], "now").select("run", "same_index", "figure_rules")


CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "upgraded_records",
    f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'recursion_limit' WHEN doc_id % 7 = 1 THEN 'empty_answer' WHEN doc_id % 7 = 2 THEN 'quota' END AS terminal_failure, doc_id % 7 = 0 AS recursion_limit_hit, 2::BIGINT AS n_observations,
 CASE WHEN {CLEAN} = '' THEN 1 ELSE 2 END::BIGINT AS n_contexts, list_filter(['AAPL_10K_chunk_' || doc_id, 'AAPL_10K_chunk_x'], lambda i: i <> 'AAPL_10K_chunk_' || doc_id OR {CLEAN} <> '') AS retrieved,
 list_filter(['[AAPL 10-K, chunk ' || doc_id || '] ' || {CLEAN}, '[AAPL 10-K, chunk x] end'], lambda c: c <> '[AAPL 10-K, chunk ' || doc_id || '] ') AS contexts FROM documents""",
)
def upgraded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that kept their observations as contexts, and new ones, in one shape."""
    n, line = F.col("doc_id"), F.trim(F.regexp_replace("text", r"\s+", " "))
    shown = F.array(F.concat(F.lit("[1] ticker=AAPL  chunk_idx="), n.cast("string"), F.lit("\n"), line), F.lit("[1] ticker=AAPL  chunk_idx=x\nend"))
    answer = F.when(n % 7 == 0, "Sorry, need more steps").when(n % 7 == 1, " ").otherwise("It was so.")
    new = n % 2 == 0
    rows = table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"), F.when(n % 7 == 2, "quota").alias("terminal_failure"), F.when(new, shown).alias("observations"), F.when(new, F.array(F.lit("old"))).otherwise(shown).alias("contexts"))
    return V.upgraded(rows, "doc_id", "need more steps").select("doc_id", "terminal_failure", "recursion_limit_hit", "n_observations", "n_contexts", "retrieved", "contexts")
