"""Queries over runs: tool calls, latency, cost, coverage, gates, memory, figures, claims, experiment identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import figures as G
from siltstone.functions import messages as S
from siltstone.functions import numbers as N
from siltstone.operators import experiment as E
from siltstone.operators import memory as H
from siltstone.operators import metrics as M
from siltstone.operators import runs as R
from siltstone.operators import serving
from siltstone.operators import tools as O
from siltstone.operators import verify as V
from siltstone.plans.catalog import query
from siltstone.session import table

#: Events as tool calls: a user is an item, a type a tool, errors are failed calls.
CALLS = "calls AS (SELECT user_id AS item_id, event_id AS pos, event_type AS tool, epoch_ms(ts)::DOUBLE AS start_ms, value * 36000 AS ms, event_type = 'error' AS error, props AS args FROM events)"
STEPS = f"""{CALLS}, e AS (SELECT *, max(start_ms + ms) OVER (PARTITION BY item_id ORDER BY start_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM calls),
stepped AS (SELECT *, sum(CASE WHEN latest IS NULL OR start_ms > latest + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY start_ms, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS step FROM e)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("tool"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("start_ms"),
        (F.col("value") * 36000).alias("ms"), (F.col("event_type") == "error").alias("error"), F.col("props").alias("args"),
    )


@query("tool_steps_window", f"WITH {STEPS} SELECT item_id, pos, step FROM stepped")
def tool_steps_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.steps(calls(spark, sf_dir)).select("item_id", "pos", "step")


@query("tool_batched", f"WITH {STEPS}, z AS (SELECT item_id, step, count(*) AS n FROM stepped GROUP BY ALL) SELECT item_id, sum(n)::BIGINT AS n_calls, count(*) AS steps, count(*) FILTER (n > 1) AS batched_steps, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS calls_in_batched_steps, bool_or(n > 1) AS batched FROM z GROUP BY item_id")
def tool_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.batching(O.steps(calls(spark, sf_dir)))


@query("tool_redundant", f"WITH {CALLS} SELECT item_id, sum(n - 1)::BIGINT AS redundant_calls FROM (SELECT item_id, tool, args, count(*) AS n FROM calls GROUP BY ALL) GROUP BY item_id")
def tool_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.redundant(calls(spark, sf_dir))


@query("tool_validity", f"WITH {CALLS} SELECT tool, count(*) AS n_calls, count(*) FILTER (error) AS failed, round(count(*) FILTER (NOT error)::DOUBLE / count(*), 4) AS valid FROM calls GROUP BY tool")
def tool_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.validity(calls(spark, sf_dir), ["tool"])


@query("tool_first", f"WITH {CALLS} SELECT item_id, arg_min(tool, {{'s': start_ms, 'p': pos}}) AS first_tool FROM calls GROUP BY item_id")
def tool_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_calls(calls(spark, sf_dir))


@query(
    "tool_set_ok",
    f"""WITH {CALLS}, u AS (SELECT item_id, list_sort(list(DISTINCT tool)) AS used, arg_min(tool, {{'s': start_ms, 'p': pos}}) AS first_tool FROM calls GROUP BY item_id)
SELECT item_id, first_tool, list_filter(used, lambda x: NOT list_contains(['click', 'view', 'signup', 'error'], x)) AS disallowed, list_filter(['click', 'view'], lambda x: NOT list_contains(used, x)) AS missing,
 NOT list_contains(used, 'purchase') AND list_contains(used, 'click') AND list_contains(used, 'view') AS tool_set_ok, first_tool IN ('click', 'view') AS first_tool_ok FROM u""",
)
def tool_set_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    array = lambda *names: F.array(*map(F.lit, names))
    labels = rows.select("item_id").distinct().select("item_id", array("click", "view", "signup", "error").alias("allowed"), array("click", "view").alias("required"), array("click", "view").alias("first_ok"))
    return O.conformity(rows, labels)


NEAREST = "round(list_sort(list(value))[round_even(({p} / 100.0::DOUBLE) * (count(*) - 1), 0)::BIGINT + 1], 1)"


@query("latency_nearest_rank", f"SELECT event_type, {NEAREST.format(p=50)} AS p50, {NEAREST.format(p=95)} AS p95 FROM events GROUP BY event_type")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": ("nearest", 50), "p95": ("nearest", 95)})


@query("latency_linear", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 1) AS p50, round(quantile_cont(value, 0.95), 1) AS p95, round(avg(value), 1) AS mean FROM events GROUP BY event_type")
def latency_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    means = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 1).alias("mean"))
    return means.join(N.percentiles(rows, ["event_type"], "value", {"p50": ("linear", 50), "p95": ("linear", 95)}), "event_type")


COST = "round((user_id * 0.75 + event_id * 3.75) / 1e6, 6)"


@query("cost_block", f"SELECT event_type, count(*) AS n_metered, round(avg(user_id))::BIGINT AS input_tokens_mean, round(avg(event_id), 2) AS calls_mean, round(avg({COST}), 6) AS cost_mean, round(sum({COST}), 4) AS cost_total FROM events WHERE event_type <> 'error' GROUP BY event_type")
def cost_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = N.cost_usd(F.lit("gemini-3.6-flash"), F.col("user_id"), F.col("event_id"))
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n_metered"), F.round(F.avg("user_id")).cast("long").alias("input_tokens_mean"), F.round(F.avg("event_id"), 2).alias("calls_mean"), F.round(F.avg(cost), 6).alias("cost_mean"), F.round(F.sum(cost), 4).alias("cost_total")
    )


SCORED = "s AS (SELECT d.doc_id, d.lang, l.quality::DOUBLE AS score, d.doc_id % 3 = 0 AS failed FROM documents d LEFT JOIN labels l USING (doc_id))"
COVERAGE = "count(*) AS n_items, count(score) AS n_scored, count(*) FILTER (score IS NULL) AS n_nan, count(*) FILTER (score IS NULL AND failed) AS n_nan_terminal, count(*) FILTER (score IS NULL AND NOT failed) AS n_nan_unexplained, round(count(score)::DOUBLE / count(*), 4) AS coverage, round(avg(score), 4) AS mean, round(sum(score) / (count(score) + count(*) FILTER (score IS NULL AND failed)), 4) AS mean_failures_as_zero"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 3 == 0).alias("failed"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score")), "doc_id", "left")


@query("coverage_nan_split", f"WITH {SCORED} SELECT {COVERAGE} FROM s")
def coverage_nan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(_scored(spark, sf_dir), "score", "failed")


@query("mean_failures_as_zero", f"WITH {SCORED} SELECT lang, {COVERAGE} FROM s GROUP BY ROLLUP (lang)")
def mean_failures_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(_scored(spark, sf_dir).rollup("lang"), "score", "failed")


THRESHOLDS = [("mean", 0.5, True), ("coverage", 0.99, True), ("n_nan_unexplained", 3.0, False), ("not_measured", 0.0, True)]


@query("gate_checks", f"WITH {SCORED}, c AS (SELECT {COVERAGE} FROM s), v AS (SELECT 'mean' AS metric, mean AS value FROM c UNION ALL SELECT 'coverage', coverage FROM c UNION ALL SELECT 'n_nan_unexplained', n_nan_unexplained FROM c), t(metric, threshold, hib) AS (VALUES ('mean', 0.5::DOUBLE, true), ('coverage', 0.99, true), ('n_nan_unexplained', 3.0, false), ('not_measured', 0.0, true)) SELECT metric, value::DOUBLE AS value, threshold, coalesce(CASE WHEN hib THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM t LEFT JOIN v USING (metric)")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = M.coverage(_scored(spark, sf_dir), "score", "failed")
    values = block.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("mean", "coverage", "n_nan_unexplained")])).alias("v")).select("v.*")
    return M.gate(values, spark.createDataFrame(THRESHOLDS, "metric string, threshold double, higher_is_better boolean"))


@query("ablation_matrix", "SELECT lang || '-' || source AS run_id, metric, row_number() OVER (ORDER BY coalesce(metric, 0) DESC, lang || '-' || source) AS place FROM (SELECT lang, source, round(avg(quality), 4) AS metric FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)")
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations (a handful of rows) by their metric, missing ones as 0."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("-"), "source").alias("run_id")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.rank_runs(rows.groupBy("run_id").agg(F.round(F.avg("quality"), 4).alias("metric")), "metric")


# memory


@query("thread_history_bounded", "SELECT conv_id, turn, back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6")
def thread_history_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "back")


@query("thread_compose", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id")
def thread_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("role", F.lit(": "), "text")
    return H.composed(table(spark, sf_dir, "conversations"), "conv_id", "turn", line)


@query(
    "thread_messages",
    f"""WITH t AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS q, text AS a FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t WHERE turn % 2 = 1),
c AS (SELECT conv_id, trim(q) AS q, trim(a) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM k WHERE back <= 6),
w AS (SELECT conv_id, i, CASE WHEN length(q) <= 500 THEN q ELSE rtrim(left(q, 500)) || '…' END AS q, CASE WHEN length(a) <= 1200 THEN a ELSE rtrim(left(a, 1200)) || '…' END AS a FROM c),
h AS (SELECT conv_id, string_agg('[Earlier turn ' || i || '] Question: ' || q || chr(10) || '[Earlier turn ' || i || '] Answer: ' || a || chr(10), chr(10) ORDER BY i) AS h FROM w GROUP BY conv_id)
SELECT conv_id, CASE WHEN h IS NULL THEN 'And then?' ELSE '{serving.PREFACE}' || chr(10) || chr(10) || h || chr(10) || 'Current question:' || chr(10) || 'And then?' END AS message FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN h USING (conv_id)""",
)
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent is given for a question on each thread: its last turns, clipped, then the question."""
    rows = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    turns = rows.select("conv_id", "turn", before.alias("question"), F.col("text").alias("answer")).where("turn % 2 = 1")
    return serving.composed_messages(turns, rows.select("conv_id", F.lit("And then?").alias("question")).distinct(), "conv_id", "turn")


@query("thread_expire", "SELECT user_id, event_id, sum(CASE WHEN idle IS NULL OR idle > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS idle FROM events)")
def thread_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sessions(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "event_id", "session")


@query(
    "thread_admission",
    """WITH s AS (SELECT *, event_type <> 'error' AND event_id % 4 <> 0 AS admits, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS idle FROM events),
 a AS (SELECT *, sum(CASE WHEN idle IS NULL OR idle > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS alive FROM s)
SELECT user_id, event_id, least(coalesce(sum(admits::INTEGER) OVER (PARTITION BY user_id, alive ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6)::BIGINT AS remembered FROM a""",
)
def thread_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only turns that were verified, or not asked to be, and say something are remembered; idle threads start anew."""
    n, kind = F.col("event_id"), F.col("event_type")
    admits = H.admitted(F.col("user_id"), F.when(n % 4 == 0, " ").otherwise("text"), F.when(kind == "error", "refused").when(kind == "view", "skipped").otherwise("verified"))
    return H.remembered(table(spark, sf_dir, "events"), "user_id", "ts", admits).select("user_id", "event_id", "remembered")


@query("thread_lru", "SELECT user_id, left(max(ts)::VARCHAR, 19) AS last_used FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20")
def thread_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads that a bounded store still holds."""
    return H.live_threads(table(spark, sf_dir, "events"), "user_id", "ts", 20).select("user_id", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@query("spend_cap", "SELECT user_id, event_id, spent FROM (SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events) WHERE spent <= 100")
def spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.within_budget(table(spark, sf_dir, "events"), "event_id", "value", 100.0, "user_id").select("user_id", "event_id", "spent")


@query("pending_items", "SELECT item_id FROM benchmark WHERE item_id % 4 <> 0")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return E.pending(items, items.where("item_id % 4 = 0"), "item_id")


@query("cached_result_lookup", "SELECT lang AS config_hash, min(source) AS path FROM documents WHERE doc_id % 2 = 0 GROUP BY lang UNION ALL SELECT 'xx', NULL")
def cached_result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "documents").select(F.col("lang").alias("config_hash"), F.col("source").alias("path"), F.when(F.col("doc_id") % 2 == 0, "complete").otherwise("partial").alias("status"))
    wanted = results.select("config_hash").distinct().unionByName(spark.createDataFrame([("xx",)], "config_hash string"))
    return E.reusable(results, wanted)


@query("file_versions", "SELECT item_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM benchmark")
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", E.text_sha256(F.col("text")).alias("digest"))


@query("benchmark_version", "SELECT item_id % 5 AS part, 'sha256:' || left(sha256(string_agg('item-' || item_id || '.csv' || chr(0) || sha256(replace(text, chr(13) || chr(10), chr(10))) || chr(0), '' ORDER BY item_id)), 12) AS version FROM benchmark GROUP BY 1")
def benchmark_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmarks of several files, each a version over its files' names and contents in order."""
    files = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("part"), "item_id", F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(".csv")).alias("name"), "text")
    return E.benchmark_version(files, "part", "item_id", "name", "text")


@query("index_problems", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'the index has ' || n_chars || ' chunks, the labels were made on ' || (n_chars + 1) ELSE 'there is no index' END AS problem FROM documents WHERE n_chars > 0")
def index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    live = F.when(F.col("doc_id") % 3 == 2, F.lit(0)).otherwise(n)
    return table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", E.index_problem(live, F.when(F.col("doc_id") % 3 == 1, n + 1).otherwise(n)).alias("problem"))


@query(
    "config_phrases",
    """SELECT doc_id, concat_ws(', ', mode, CASE WHEN mode = 'hybrid' AND doc_id % 4 = 0 THEN 'rrf_k=20' END, CASE WHEN mode = 'hybrid' AND doc_id % 5 = 0 THEN 'w=2.0/0.5' END, CASE WHEN doc_id % 2 = 0 THEN 'rerank fetch=' || depth WHEN mode <> 'dense' AND depth <> 25 THEN 'fetch=' || depth END, CASE WHEN doc_id % 7 = 0 THEN 'ticker=inferred' END) AS phrase
FROM (SELECT doc_id, ['dense', 'bm25', 'hybrid'][doc_id % 3 + 1] AS mode, CASE WHEN doc_id % 11 < 5 THEN 25 ELSE 50 END AS depth FROM documents)""",
)
def config_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    mode = F.get(F.array(F.lit("dense"), F.lit("bm25"), F.lit("hybrid")), (n % 3).cast("int"))
    fifth = n % 5 == 0
    phrase = S.config_phrase(mode, F.when(n % 4 == 0, 20).otherwise(60), (F.when(fifth, 2.0).otherwise(1.0), F.when(fifth, 0.5).otherwise(1.0)), n % 2 == 0, F.when(n % 11 < 5, 25).otherwise(50), F.when(n % 7 == 0, "inferred").otherwise("none"))
    return table(spark, sf_dir, "documents").select("doc_id", phrase.alias("phrase"))


@query("config_hash", """SELECT item_id, left(sha256('{"k":"a"}{"v":"' || item_id || '"},{"k":"b"}{"v":"x"}'), 12) AS hash FROM benchmark""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", E.config_hash(settings).alias("hash"))


@query("cache_keys", "SELECT doc_id, concat_ws('|', source, CASE WHEN lang <> 'en' THEN lang END, doc_id::VARCHAR) AS key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", E.cache_key([F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.col("doc_id").cast("string")]).alias("key"))


# figures and claims


@query("figures_extract", "SELECT doc_id, regexp_extract_all(text, '(?i)" + G.PLAIN + "') AS figures FROM documents")
def figures_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", G.plain(F.col("text")).alias("figures"))


#: Answers to line items: what is true, an amount and a share, and what is said of it, by the line's number.
SAID = """said AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS kind, (l_orderkey * 10 + l_linenumber + 3000)::VARCHAR AS v, (l_linenumber * 7)::VARCHAR || '.5' AS p FROM lineitem)"""
ANSWER_KEYS = ["l_orderkey", "l_linenumber"]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, kind = F.col("l_linenumber"), F.col("l_linenumber") % 4
    v, p = (F.col("l_orderkey") * 10 + line + 3000).cast("string"), F.concat((line * 7).cast("string"), F.lit(".5"))
    truth = F.when(kind == 3, "In 2024.").otherwise(F.concat(F.lit("It was $"), v, F.lit(" million, up "), p, F.lit("%.")))
    answer = F.when(kind == 0, F.concat(p, F.lit(" percent more, $"), v, F.lit(" million"))).when(kind == 2, F.concat(F.lit("About $"), v, F.lit(" million."))).otherwise(F.concat(F.lit("Up "), p, F.lit(" percent.")))
    return table(spark, sf_dir, "lineitem").select(*ANSWER_KEYS, G.extract(truth).alias("t"), G.extract(answer).alias("a"))


@query(
    "figures_match",
    f"WITH {SAID} SELECT l_orderkey, l_linenumber, kind < 3 AS applicable, (CASE WHEN kind < 3 THEN 2 ELSE 0 END)::INTEGER AS n_expected, (CASE kind WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END)::INTEGER AS n_found, (CASE kind WHEN 0 THEN 1.0 WHEN 3 THEN NULL ELSE 0.5 END)::DOUBLE AS recall, CASE WHEN kind < 3 THEN kind = 0 END AS exact, CASE WHEN kind < 3 THEN kind <> 1 END AS primary_found FROM said",
)
def figures_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("m", G.figure_match(F.col("t"), F.col("a")))
    return rows.select(*ANSWER_KEYS, "m.applicable", "m.n_expected", "m.n_found", "m.recall", "m.exact", "m.primary_found")


@query("primary_figure", f"WITH {SAID} SELECT l_orderkey, l_linenumber, CASE WHEN kind < 3 THEN '$' || v || ' million' END AS primary_figure FROM said")
def primary_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select(*ANSWER_KEYS, G.primary(F.col("t"))["raw"].alias("primary_figure"))


@query("figure_grounding", f"WITH {SAID} SELECT l_orderkey, l_linenumber, true AS applicable, (CASE kind WHEN 0 THEN 2 ELSE 1 END)::INTEGER AS n_figures, (CASE kind WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END)::INTEGER AS n_grounded, kind < 3 AS grounded FROM said")
def figure_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's figures in what was seen."""
    rows = _answers(spark, sf_dir).withColumn("g", G.grounding(F.col("a"), F.col("t")))
    return rows.select(*ANSWER_KEYS, "g.applicable", "g.n_figures", "g.n_grounded", "g.grounded")


@query("figures_documents")
def figures_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(G.extract(F.col("text"))).alias("n_figures"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations put together from documents, in the layouts that tools use."""
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    ident = F.col("doc_id").cast("string")
    text = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[1] ticker=aapl  chunk_idx="), ident, F.lit("\n"), line, F.lit("\n\n[2] ticker=MSFT  chunk_idx=7\nrevenue 5 million")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("=== META ===\n  [1] chunk_idx="), ident, F.lit("\n"), line, F.lit("\n  [2] chunk_idx=9\n\nloose text")))
        .otherwise(F.concat(F.lit("[1] ticker=AMZN  fact_id="), ident, F.lit(",\n  us-gaap:Revenues | 12\n[2] calc=ratio\nratio = 0.5")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("run"), text.alias("text"))


CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
PARSED = f"""parsed AS (SELECT doc_id, 1::BIGINT AS pos, CASE doc_id % 3 WHEN 2 THEN 'fact' ELSE 'chunk' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'AAPL_10K_chunk_' || doc_id WHEN 1 THEN 'META_10K_chunk_' || doc_id ELSE 'AMZN_10K_fact_' || doc_id END AS id,
  CASE doc_id % 3 WHEN 2 THEN 'us-gaap:Revenues | 12' ELSE {CLEAN} END AS snippet FROM documents
UNION ALL SELECT doc_id, 2, CASE doc_id % 3 WHEN 0 THEN 'chunk' ELSE 'calc' END, CASE doc_id % 3 WHEN 0 THEN 'MSFT_10K_chunk_7' ELSE 'calc_ratio' END, CASE doc_id % 3 WHEN 0 THEN 'revenue 5 million' ELSE 'ratio = 0.5' END FROM documents WHERE doc_id % 3 <> 1)"""


@query("observation_parse", f"WITH {PARSED} SELECT * FROM parsed")
def observation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.parse(_observations(spark, sf_dir), ["doc_id"], "text").select("doc_id", "pos", "kind", "id", "snippet")


@query("ordered_distinct_ids", f"WITH {PARSED}, f AS (SELECT doc_id % 10 AS run, id, min({{'d': doc_id, 'p': pos}}) AS seen FROM parsed WHERE kind = 'chunk' GROUP BY ALL) SELECT run, list(id ORDER BY seen) AS ids FROM f GROUP BY run")
def ordered_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = V.parse(_observations(spark, sf_dir), ["run", "doc_id"], "text")
    return V.first_seen(parsed, "run", ["doc_id", "pos"])


@query("observation_markers", "SELECT doc_id, doc_id % 3 <> 2 AS has_markers FROM documents")
def observation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("doc_id", V.has_markers(F.col("text")).alias("has_markers"))


#: Records of answers about documents, of seven kinds by doc_id: one right, one of each thing that can be wrong, one that is
#: supported by what its source says the second time, one without figures but a year.
JUDGED = """judged AS (SELECT doc_id AS run, doc_id % 7 AS kind FROM documents),
checked AS (SELECT run, kind, (CASE WHEN kind IN (0, 2, 5) THEN 0 ELSE 1 END)::BIGINT AS n_figures, (CASE WHEN kind IN (1, 6) THEN 1 ELSE 0 END)::BIGINT AS n_supported,
  CASE kind WHEN 2 THEN ['empty_record', 'dropped_figure'] WHEN 3 THEN ['unknown_source', 'unsupported_figure'] WHEN 4 THEN ['uncited_figure', 'dropped_figure'] WHEN 5 THEN ['no_contract'] ELSE [] END AS checks,
  CASE kind WHEN 1 THEN ['c1'] WHEN 3 THEN ['c1'] WHEN 6 THEN ['c1', 'c2'] ELSE [] END AS cited, CASE WHEN kind IN (0, 1, 6) THEN 'verified' ELSE 'unverified' END AS status FROM judged)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kind = table(spark, sf_dir, "documents"), F.col("doc_id") % 7
    number = lambda x: x.cast("string")
    v, p = F.col("n_chars") + 3000, F.concat(number(F.col("doc_id") % 50), F.lit(".25%"))
    wrong, other = number(v * 2 + 1), number(v * 3 + 5)
    amount = F.concat(F.lit("Revenue was $"), number(v), F.lit(" million."))
    first = F.when(kind.isin(1, 2), amount).when(kind == 3, F.concat(F.lit("It was "), wrong, F.lit("."))).when(kind == 4, F.concat(F.lit("It was "), wrong, F.lit(" and "), other, F.lit("."))).when(kind == 6, F.concat(F.lit("Up "), p, F.lit("."))).when(kind == 0, "In 2024.").otherwise("x")
    said = F.when(kind == 4, F.concat(F.lit("It was "), wrong, F.lit("."))).otherwise(first)
    cites = F.when(kind == 1, F.array(F.lit("c1"))).when(kind == 3, F.array(F.lit("c1"), F.lit("zz"))).when(kind == 6, F.array(F.lit("c2"), F.lit("c1"))).otherwise(F.array().cast("array<string>"))
    claims = F.when(kind.isin(2, 5), F.array().cast("array<struct<text:string,sources:array<string>>>")).otherwise(F.array(F.struct(said.alias("text"), cites.alias("sources"))))
    records = docs.select(F.col("doc_id").alias("run"), first.alias("draft"), claims.alias("claims"), (kind != 5).alias("parsed"))
    source = lambda i, t: F.struct(F.lit(i).alias("id"), t.alias("text"))
    seen = F.array(source("c1", F.concat(F.lit("revenue "), number(v), F.lit(" million in 2024"))), source("c2", F.lit("pct_change = 88.68")), source("c1", F.concat(F.lit("margin "), p)))
    return V.check_claims(records, docs.select(F.col("doc_id").alias("run"), F.explode(seen).alias("s")).select("run", "s.*"))


@query("claims_verify", f"WITH {JUDGED} SELECT run, n_figures, n_supported, checks, cited, status FROM checked")
def claims_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("run", F.col("n_figures").cast("long").alias("n_figures"), F.col("n_supported").cast("long").alias("n_supported"), F.transform("failures", lambda f: f["check"]).alias("checks"), "cited", "status")


@query("verdict_counts", f"WITH {JUDGED} SELECT check_name, count(*) AS n FROM (SELECT unnest(checks) AS check_name FROM checked) GROUP BY check_name")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select(F.explode("failures.check").alias("check_name")).groupBy("check_name").agg(F.count("*").alias("n"))


@query("verdict_policy", f"WITH {JUDGED} SELECT run, CASE status WHEN 'verified' THEN status ELSE 'refused' END AS strict, 'skipped' AS off, status AS warn FROM checked")
def verdict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("run", *[V.served(F.col("status"), F.lit(m)).alias(m) for m in ("strict", "off", "warn")])


@query("answer_contexts_parsed", f"WITH {PARSED}, c AS (SELECT doc_id, pos, CASE WHEN kind = 'calc' THEN '[calc_ratio] ' || snippet ELSE '[' || split_part(id, '_10K_', 1) || ' 10-K, ' || replace(split_part(id, '_10K_', 2), '_', ' ') || '] ' || snippet END AS c FROM parsed) SELECT doc_id, list(c ORDER BY pos) AS contexts FROM c GROUP BY doc_id")
def answer_contexts_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages, facts and results with where they come from, as a judge sees them."""
    return V.contexts(V.parse(_observations(spark, sf_dir), ["doc_id"], "text"), "doc_id", ["pos"])


@query("answer_sources", f"WITH {PARSED}, f AS (SELECT doc_id % 10 AS run, split_part(id, '_10K_', 1) AS ticker, id, min({{'d': doc_id, 'p': pos}}) AS seen FROM parsed WHERE kind <> 'calc' GROUP BY ALL) SELECT run, row_number() OVER (PARTITION BY run ORDER BY seen) AS pos, ticker, id FROM f")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer may cite, once each, in the order seen."""
    seen = _observations(spark, sf_dir)
    return V.sources(seen, V.parse(seen, ["run", "doc_id"], "text"), "run", ["doc_id", "pos"], "text").select("run", "pos", "ticker", "id")


@query("observation_texts", f"WITH {PARSED} SELECT doc_id % 10 AS run, id, string_agg(snippet, chr(10) ORDER BY doc_id, pos) AS text FROM parsed GROUP BY ALL")
def observation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one id, joined in the order seen."""
    return V.by_id(V.parse(_observations(spark, sf_dir), ["run", "doc_id"], "text"), "run", ["doc_id", "pos"])


@query(
    "failure_texts",
    f"""WITH {JUDGED}, d AS (SELECT doc_id AS run, n_chars + 3000 AS v FROM documents) SELECT run, CASE kind WHEN 2 THEN ['the record has no sentences, but the draft isn''t empty', '$' || v || ' million is in the draft and in no sentence of the record']
 WHEN 3 THEN ['zz is cited in "a claim" but wasn''t observed in this turn', (v * 2 + 1) || ' in "a claim" stands in nothing that the sentence cites'] WHEN 4 THEN [(v * 2 + 1) || ' in "a claim" cites nothing', (v * 3 + 5) || ' is in the draft and in no sentence of the record']
 WHEN 5 THEN ['no record that can be used: the record could not be parsed'] ELSE [] END AS texts FROM checked JOIN d USING (run)""",
)
def failure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with records, in words."""
    return _verdicts(spark, sf_dir).select("run", F.transform("failures", lambda f: V.described(f, F.lit("a claim"))).alias("texts"))


@query("refusal_texts", "SELECT doc_id, array_to_string(list_transform(range(1, least(doc_id % 7, 4) + 1), lambda i: 'uncited_figure: ' || i), '; ') || CASE WHEN doc_id % 7 > 4 THEN '; and ' || (doc_id % 7 - 4) || ' more' ELSE '' END AS reasons FROM documents")
def refusal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 7).cast("int")
    none = F.array().cast("array<struct<check:string,detail:string>>")
    failures = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.lit("uncited_figure").alias("check"), i.cast("string").alias("detail")))).otherwise(none)
    return table(spark, sf_dir, "documents").select("doc_id", V.refusal(failures).alias("reasons"))
