"""Queries over the records of a run, put together from the events, conversations and documents tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import messages as S
from siltstone.functions import numbers as N
from siltstone.operators import ranges, serving
from siltstone.operators import metrics as M
from siltstone.operators import runs as R
from siltstone.operators import tools as O
from siltstone.plans.catalog import query
from siltstone.plans.evaluation import CALLS, STEPS, calls
from siltstone.session import table

METRICS = ("faithfulness", "relevancy")

#: A user is an item, its events are its tool calls; what a run would have measured follows from ids.
RECORDS = """per AS (SELECT user_id AS id, count(*) AS n, sum(event_id)::BIGINT AS s, round(avg(value) * 1000, 1) AS lat, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id),
records AS (SELECT id, CASE WHEN id % 17 = 0 THEN '' WHEN id % 4 = 0 THEN 'lookup' WHEN id % 4 = 1 THEN 'trend' WHEN id % 4 = 2 THEN 'comparison' ELSE 'other' END AS question_type, CASE WHEN id % 13 > 0 THEN lat END AS latency_ms,
  kinds + 2 AS llm_calls, s % 5000 AS input_tokens, n * 7 AS output_tokens, CASE WHEN id % 11 > 0 THEN round((s % 5000 * 0.75 + n * 7 * 3.75) / 1e6, 6) END AS cost_usd,
  CASE WHEN id % 19 = 0 THEN 'recursion_limit' END AS terminal_failure, CASE WHEN id % 23 = 0 THEN 'timeout' END AS error, n, id % 6 = 5 AS no_tools, id % 2 = 0 AS seen,
  CASE id % 5 WHEN 1 THEN 'verified' WHEN 2 THEN 'refused' WHEN 3 THEN 'skipped' WHEN 4 THEN 'unverified' END AS status, (id % 3)::INTEGER AS attempts, id % 7 = 0 AS repaired,
  id % 2 = 0 AS figure_applicable, (id % 4) / 4.0::DOUBLE AS figure_recall, id % 4 = 0 AS figure_exact, id % 3 = 0 AS figure_primary, CASE WHEN id % 5 = 2 THEN true END AS draft_primary,
  id % 3 <> 1 AS labelled, id % 2 = 0 AS hit, (id % 5) / 5.0::DOUBLE AS recall, 1.0::DOUBLE / (1 + id % 4) AS mrr, id % 4 <> 3 AS grounding_applicable, 1 + id % 5 AS n_figures, least(1 + id % 5, id % 4) AS n_grounded,
  CASE WHEN id % 10 > 0 THEN (id % 9) / 9.0::DOUBLE END AS faithfulness, CASE WHEN id % 6 > 0 THEN (id % 7) / 7.0::DOUBLE END AS relevancy FROM per)"""
#: What searched: users with views searched, those without tools go by what they saw.
SEARCHED = "CASE WHEN no_tools THEN seen ELSE id IN (SELECT user_id FROM events WHERE event_type = 'view') END"
JUDGED = "status IS NOT NULL AND status <> 'skipped'"


def _r(expr: str, where: str, name: str, digits: int = 4) -> str:
    return f"round(avg(CASE WHEN {where} THEN ({expr})::DOUBLE END), {digits}) AS {name}"


def _rate(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


DETERMINISTIC = ", ".join([
    "count(*) FILTER (figure_applicable) AS n_figure_applicable", _r("figure_recall", "figure_applicable", "figure_recall"), _r(_rate("figure_exact"), "figure_applicable", "figure_exact_rate"),
    _r(_rate("figure_primary"), "figure_applicable", "figure_primary_rate"), _r(_rate("coalesce(draft_primary, figure_primary)"), "figure_applicable", "figure_primary_rate_draft"),
    "count(*) FILTER (labelled) AS n_labelled", _r(_rate("hit"), "labelled", "agent_hit_rate"), _r("recall", "labelled", "agent_recall"), _r("mrr", "labelled", "agent_mrr"),
    "count(*) FILTER (labelled AND searched) AS n_searched", _r(_rate("hit"), "labelled AND searched", "agent_hit_rate_searched"), "count(*) FILTER (grounding_applicable) AS n_grounding_applicable",
    _r(_rate("n_grounded = n_figures"), "grounding_applicable", "grounded_rate"), _r("n_grounded::DOUBLE / n_figures", "grounding_applicable", "grounded_figure_rate"), f"count(*) FILTER ({JUDGED}) AS n_verified_applicable",
    _r(_rate("status = 'verified'"), JUDGED, "verified_rate"), _r(_rate("repaired"), JUDGED, "repaired_rate"), _r(_rate("status = 'refused'"), JUDGED, "refused_rate"),
])
COST = ", ".join([
    "count(latency_ms) AS n_metered", "round(avg(latency_ms), 1) AS latency_ms_mean", *[f"round_even(avg({c}) FILTER (latency_ms IS NOT NULL), 0)::BIGINT AS {c}_mean" for c in ("input_tokens", "output_tokens")],
    _r("llm_calls", "latency_ms IS NOT NULL", "llm_calls_mean", 2), _r("cost_usd", "latency_ms IS NOT NULL", "cost_usd_mean", 6), "round(sum(cost_usd) FILTER (latency_ms IS NOT NULL), 4) AS cost_usd_total",
    _r("CASE WHEN no_tools THEN 0 ELSE n END", "latency_ms IS NOT NULL", "tool_calls_mean", 2),
])
SCORES = ", ".join(
    f"round(avg({m}), 4) AS {m}_mean, CASE WHEN count({m}) + count(*) FILTER ({m} IS NULL AND terminal_failure IS NOT NULL) > 0 THEN round(sum({m}) / (count({m}) + count(*) FILTER ({m} IS NULL AND terminal_failure IS NOT NULL)), 4) END AS {m}_failures_as_zero, "
    f"count({m}) AS {m}_n_scored, count(*) FILTER ({m} IS NULL) AS {m}_n_nan, count(*) FILTER ({m} IS NULL AND terminal_failure IS NOT NULL) AS {m}_n_terminal, count(*) FILTER ({m} IS NULL AND terminal_failure IS NULL) AS {m}_n_unexplained"
    for m in METRICS
)
PLACE = "CASE stratum WHEN 'overall' THEN -1 WHEN 'lookup' THEN 1 WHEN 'comparison' THEN 2 WHEN 'trend' THEN 3 ELSE 4 END::BIGINT AS place"
BOTH = f"r AS (SELECT *, {SEARCHED} AS searched FROM records), both_ AS (SELECT 'overall' AS stratum, * FROM r UNION ALL SELECT question_type, * FROM r WHERE question_type <> '')"
_SORTED, _PLACE = "list_sort(list({v}) FILTER ({v} IS NOT NULL))", "({p} / 100.0::DOUBLE * (count({v}) - 1))"
LINEAR = f"round(({_SORTED}[floor({_PLACE})::BIGINT + 1] + ({_SORTED}[least(floor({_PLACE})::BIGINT + 2, count({{v}}))] - {_SORTED}[floor({_PLACE})::BIGINT + 1]) * ({_PLACE} - floor({_PLACE})))::DECIMAL(38, 12), 1)::DOUBLE"
NEAR = "round(list_sort(list({v}) FILTER ({v} IS NOT NULL))[round_even(({p} / 100.0::DOUBLE) * (count({v}) - 1), 0)::BIGINT + 1], 1)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    per = events.groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("s"), F.round(F.avg("value") * 1000, 1).alias("lat"), F.count_distinct("event_type").alias("kinds"),
        *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("click", "view", "purchase", "signup", "error")],
    )
    ident = F.col("id")
    tool = lambda k: F.when(F.col(f"n_{k}") > 0, F.struct(F.lit({"view": "search_filings"}.get(k, k)).alias("key"), F.col(f"n_{k}").alias("value")))
    tools = F.map_from_entries(F.filter(F.array(*map(tool, ("click", "view", "purchase", "signup", "error"))), lambda x: x.isNotNull()))
    score = lambda k, n: F.when(ident % k > 0, (ident % n) / float(n))
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (ident % k + 1).cast("int"))
    failures = F.filter(F.array(F.when(ident % 2 == 0, "uncited_figure"), F.when(ident % 3 == 0, "unknown_source")), lambda x: x.isNotNull())
    return per.select(
        "id", F.when(ident % 17 == 0, "").otherwise(pick(4, "lookup", "trend", "comparison", "other")).alias("question_type"), F.when(ident % 13 > 0, F.col("lat")).alias("latency_ms"), (F.col("kinds") + 2).alias("llm_calls"),
        (F.col("s") % 5000).alias("input_tokens"), (F.col("n") * 7).alias("output_tokens"), F.when(ident % 11 > 0, F.round((F.col("s") % 5000 * 0.75 + F.col("n") * 7 * 3.75) / 1e6, 6)).alias("cost_usd"),
        F.when(ident % 19 == 0, "recursion_limit").alias("terminal_failure"), F.when(ident % 23 == 0, "timeout").alias("error"), F.when(ident % 6 == 5, F.create_map().cast("map<string,bigint>")).otherwise(tools).alias("tools_used"),
        F.when(ident % 2 == 0, F.array(F.lit("c1"))).otherwise(F.array().cast("array<string>")).alias("retrieved"), pick(5, None, "verified", "refused", "skipped", "unverified").alias("status"), (ident % 3).cast("int").alias("attempts"), (ident % 7 == 0).alias("repaired"), failures.alias("failures"),
        (ident % 2 == 0).alias("figure_applicable"), ((ident % 4) / 4.0).alias("figure_recall"), (ident % 4 == 0).alias("figure_exact"), (ident % 3 == 0).alias("figure_primary"), F.when(ident % 5 == 2, True).alias("draft_primary"),
        (ident % 3 != 1).alias("labelled"), (ident % 2 == 0).alias("hit"), ((ident % 5) / 5.0).alias("recall"), (1 / (1 + ident % 4)).alias("mrr"), (ident % 4 != 3).alias("grounding_applicable"), (1 + ident % 5).alias("n_figures"), F.least(1 + ident % 5, ident % 4).alias("n_grounded"),
        F.create_map(F.lit("faithfulness"), score(10, 9), F.lit("relevancy"), score(6, 7)).alias("scores"),
    )


@query("generation_aggregates", f"WITH {RECORDS}, {BOTH}, a AS (SELECT stratum, count(*) AS n_items, {SCORES}, {DETERMINISTIC}, {COST}, {', '.join(NEAR.format(v='latency_ms', p=p) + f' AS p{p}' for p in (50, 95))}, {LINEAR.format(v='latency_ms', p=50)} AS p50_linear, {LINEAR.format(v='latency_ms', p=95)} AS p95_linear FROM both_ GROUP BY stratum) SELECT *, {PLACE} FROM a")
def generation_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.generation_aggregates(records(spark, sf_dir), METRICS)


@query("generation_tool_totals", "WITH " + RECORDS + ", c AS (SELECT r.question_type, CASE event_type WHEN 'view' THEN 'search_filings' ELSE event_type END AS tool FROM events e JOIN records r ON r.id = e.user_id WHERE latency_ms IS NOT NULL AND NOT no_tools) SELECT 'overall' AS stratum, tool, count(*)::BIGINT AS n FROM c GROUP BY tool UNION ALL SELECT question_type, tool, count(*) FROM c WHERE question_type <> '' GROUP BY ALL")
def generation_tool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tool_totals(records(spark, sf_dir))


@query("verification_failures", f'WITH {RECORDS}, f AS (SELECT unnest(list_filter([CASE WHEN id % 2 = 0 THEN \'uncited_figure\' END, CASE WHEN id % 3 = 0 THEN \'unknown_source\' END], lambda x: x IS NOT NULL)) AS "check" FROM records WHERE {JUDGED}) SELECT "check", count(*) AS n FROM f GROUP BY ALL')
def verification_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.failure_counts(records(spark, sf_dir))


LATENCY = "stratum, count(latency_ms) AS n, round(avg(latency_ms), 1) AS mean, " + ", ".join(NEAR.format(v="latency_ms", p=p) + f" AS p{p}" for p in (50, 95)) + f", {LINEAR.format(v='latency_ms', p=50)} AS p50_linear, {LINEAR.format(v='latency_ms', p=95)} AS p95_linear"


@query("latency_block", f"WITH {RECORDS}, {BOTH} SELECT {LATENCY} FROM both_ WHERE latency_ms IS NOT NULL GROUP BY stratum")
def latency_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latency(records(spark, sf_dir), "latency_ms")


@query("latency_block_without_failures", f"WITH {RECORDS}, {BOTH} SELECT {LATENCY} FROM both_ WHERE latency_ms IS NOT NULL AND terminal_failure IS NULL GROUP BY stratum")
def latency_block_without_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latency(records(spark, sf_dir), "latency_ms", exclude_terminal=True)


@query("searched_runs", f"WITH {RECORDS}, {BOTH} SELECT id, searched FROM r")
def searched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", R.searched(F.col("tools_used"), F.col("retrieved")).alias("searched"))


@query("agent_llm_calls", f"WITH {RECORDS} SELECT id, llm_calls - CASE WHEN {JUDGED} THEN attempts ELSE 0 END AS agent_llm_calls FROM records")
def agent_llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", R.agent_llm_calls(F.col("llm_calls"), F.col("status"), F.col("attempts")).alias("agent_llm_calls"))


@query("quota_errors", "SELECT conv_id, turn, regexp_matches(lower(text), 'resource_exhausted|resourceexhausted|429|quota|rate limit|ratelimit|too many requests') AS refused FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN text || ' Error 429: Quota' ELSE text END AS text FROM conversations)")
def quota_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat("text", F.lit(" Error 429: Quota"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.is_quota_error(text).alias("refused"))


@query("subset_run", f"WITH {RECORDS}, w AS (SELECT unnest(range(0, 40)) AS id) SELECT (SELECT count(*) FROM w) AS n_requested, count(*) AS n_generated, (SELECT count(*) FROM w) = count(*) AS complete FROM records WHERE id IN (SELECT id FROM w)")
def subset_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.subset(records(spark, sf_dir), spark.range(40))[1]


JUDGED_VALUES = f"""a AS (SELECT {SCORES}, {DETERMINISTIC}, count(*) FILTER (terminal_failure IS NOT NULL OR error IS NOT NULL) AS terminal_failures FROM r),
jv AS (SELECT 'faithfulness' AS metric, faithfulness_failures_as_zero::DOUBLE AS value FROM a UNION ALL SELECT 'relevancy', relevancy_failures_as_zero FROM a UNION ALL SELECT 'figure_primary_rate', figure_primary_rate FROM a
  UNION ALL SELECT 'terminal_failures', terminal_failures FROM a UNION ALL SELECT 'unexplained_nan', faithfulness_n_unexplained + relevancy_n_unexplained FROM a)"""


@query("judged_values", f"WITH {RECORDS}, {BOTH}, {JUDGED_VALUES} SELECT * FROM jv")
def judged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.judged_values(records(spark, sf_dir), METRICS)


LIMITS = [("faithfulness", 0.3, True), ("relevancy", 0.9, True), ("figure_primary_rate", 0.2, True), ("terminal_failures", 100000.0, False), ("unexplained_nan", 0.0, False), ("not_measured", 0.1, True)]
LIMITS_SQL = "t(metric, threshold, hib) AS (VALUES " + ", ".join(f"('{m}', {t}::DOUBLE, {h})" for m, t, h in LIMITS) + ")"


def _limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "metric string, threshold double, higher_is_better boolean")


@query("judged_gate", f"WITH {RECORDS}, {BOTH}, {JUDGED_VALUES}, {LIMITS_SQL} SELECT metric, value, threshold, coalesce(CASE WHEN hib THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM t LEFT JOIN jv USING (metric)")
def judged_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate(R.judged_values(records(spark, sf_dir), METRICS), _limits(spark))


@query("gate_validation", f"WITH {RECORDS}, {BOTH}, {JUDGED_VALUES}, {LIMITS_SQL} SELECT 'judged' AS scope, metric, CASE WHEN value IS NULL THEN 'no committed value' WHEN hib THEN 'threshold above the committed value' ELSE 'committed value above the limit' END AS problem FROM t LEFT JOIN jv USING (metric) WHERE value IS NULL OR (hib AND threshold > value) OR (NOT hib AND value > threshold)")
def gate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.lit("judged").alias("scope")
    return R.gate_problems(_limits(spark).withColumn("scope", scope), R.judged_values(records(spark, sf_dir), METRICS).withColumn("scope", scope))


@query("config_mismatches", "SELECT lang || ':' || k AS key, expected, got FROM (SELECT lang, 'model' AS k, 'm' || count(*) % 3 AS expected, 'm' || count(*) % 2 AS got FROM documents GROUP BY lang UNION ALL SELECT lang, 'verify_mode', 'strict', 'off' FROM (SELECT DISTINCT lang FROM documents)) WHERE expected <> got")
def config_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    key = lambda k: F.concat("lang", F.lit(":" + k)).alias("key")
    config = n.select(key("model"), F.concat(F.lit("m"), (F.col("n") % 2).cast("string")).alias("value"))
    expected = n.select(key("model"), F.concat(F.lit("m"), (F.col("n") % 3).cast("string")).alias("value")).unionByName(n.select(key("verify_mode"), F.lit("strict").alias("value")))
    return R.mismatches(config, expected, {f"{x}:verify_mode": "off" for x in ("de", "en", "es", "fr")})


@query("unknown_item_ids", f"WITH {RECORDS} SELECT w.id FROM (SELECT unnest(range(0, 40)) AS id) w WHERE id NOT IN (SELECT id FROM records)")
def unknown_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(40).join(records(spark, sf_dir), "id", "left_anti")


#: Answers to figures: one in three is right, one in five refused, half of the drafts' figures were seen; two groups of relevant documents for two items in three.
ANSWERED = """an AS (SELECT doc_id AS id, doc_id % 3 = 0 AS right_, doc_id % 5 = 0 AS refused, doc_id % 2 = 0 AS seen, doc_id % 7 = 0 AS bare FROM documents)"""


@query(
    "deterministic_records",
    f"""WITH {ANSWERED} SELECT id, NOT bare AS figure_applicable, CASE WHEN NOT bare THEN CASE WHEN right_ AND NOT refused THEN 1.0 ELSE 0.0 END END::DOUBLE AS figure_recall, CASE WHEN NOT bare THEN right_ AND NOT refused END AS figure_exact,
 CASE WHEN NOT bare THEN right_ AND NOT refused END AS figure_primary, CASE WHEN NOT bare AND refused THEN true END AS draft_primary, 1 AS n_figures, seen::INTEGER AS n_grounded, id % 3 <> 1 AS labelled,
 CASE WHEN id % 3 <> 1 THEN id % 4 < 2 END AS hit, CASE WHEN id % 3 <> 1 THEN CASE WHEN id % 4 = 0 THEN 1.0 WHEN id % 4 = 1 THEN 0.5 ELSE 0.0 END END::DOUBLE AS recall, CASE WHEN id % 3 <> 1 THEN CASE WHEN id % 4 = 0 THEN 1.0 WHEN id % 4 = 1 THEN 0.3333 ELSE 0.0 END END::DOUBLE AS mrr FROM an""",
)
def deterministic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge-free checks of answers that were made up from ids."""
    n = F.col("doc_id")
    value = lambda x: F.concat(F.lit("It was $"), x.cast("string"), F.lit(" million."))
    truth, wrong = n * 10 + 3_000, n * 10 + 907_003
    answer = F.when((n % 3 == 0) | (n % 5 == 0), value(truth)).otherwise(value(wrong))
    rows = table(spark, sf_dir, "documents").select(
        n.alias("id"), F.when(n % 7 == 0, "In 2024.").otherwise(value(truth)).alias("ground_truth"), F.when(n % 5 == 0, F.concat(F.lit("Not served: "), answer)).otherwise(answer).alias("answer"), answer.alias("draft_answer"),
        F.when(n % 5 == 0, "refused").otherwise("verified").alias("status"), F.when(n % 2 == 0, F.array(F.lit("a"), answer)).otherwise(F.array(F.lit("nothing"))).alias("observations"),
        F.when(n % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(n % 4 == 1, F.array(F.lit("x"), F.lit("y"), F.lit("c"))).otherwise(F.array(F.lit("x"))).alias("retrieved"),
    )
    groups = rows.where("id % 3 <> 1").select(F.col("id").alias("item_id"), F.explode(F.array(F.struct(F.lit(1).alias("group_id"), F.lit("a").alias("doc_id")), F.struct(F.lit(1).alias("group_id"), F.lit("c").alias("doc_id")), F.struct(F.lit(2).alias("group_id"), F.lit("b").alias("doc_id")))).alias("g")).select("item_id", "g.*")
    out = R.attach_deterministic(rows, groups)
    return out.select("id", "figure_applicable", "figure_recall", "figure_exact", "figure_primary", F.when(F.col("status") == "refused", F.col("draft_primary")).alias("draft_primary"), "n_figures", "n_grounded", "labelled", "hit", "recall", "mrr")


# tool blocks

LABELS = "lab AS (SELECT id AS item_id, ['click', 'view', 'signup', 'error'] AS allowed, ['click', 'view'] AS required, ['click', 'view'] AS first_ok FROM records WHERE id % 5 <> 0)"
TOOL_ITEMS = f"""{RECORDS}, {STEPS}, {LABELS}, pc AS (SELECT item_id, count(*) AS n_calls, count(*) FILTER (error) AS failed, count(args) AS with_args, list_sort(list(DISTINCT tool)) AS used, arg_min(tool, {{'s': start_ms, 'p': pos}}) AS first_tool FROM calls GROUP BY item_id),
zz AS (SELECT item_id, step, count(*) AS k FROM stepped GROUP BY ALL), bt AS (SELECT item_id, count(*) AS steps, count(*) FILTER (k > 1) AS batched_steps, bool_or(k > 1) AS batched FROM zz GROUP BY item_id),
rd AS (SELECT item_id, sum(k - 1)::BIGINT AS redundant FROM (SELECT item_id, tool, args, count(*) AS k FROM calls GROUP BY ALL) GROUP BY item_id),
ti AS (SELECT r.*, pc.n_calls, pc.failed, pc.first_tool, bt.steps, bt.batched_steps, bt.batched, rd.redundant, llm_calls - CASE WHEN {JUDGED} THEN attempts ELSE 0 END AS agent,
  pc.n_calls > greatest(llm_calls - CASE WHEN {JUDGED} THEN attempts ELSE 0 END - 1, 0) AS more, lab.item_id IS NOT NULL AS has_label,
  CASE WHEN lab.item_id IS NOT NULL THEN len(list_filter(used, lambda x: NOT list_contains(allowed, x))) = 0 END AS allowed_only, CASE WHEN lab.item_id IS NOT NULL THEN len(list_filter(used, lambda x: NOT list_contains(allowed, x))) = 0 AND len(list_filter(required, lambda x: NOT list_contains(used, x))) = 0 END AS set_ok,
  CASE WHEN lab.item_id IS NOT NULL THEN list_contains(first_ok, first_tool) END AS first_ok_ FROM records r JOIN pc ON pc.item_id = r.id JOIN bt ON bt.item_id = r.id JOIN rd ON rd.item_id = r.id LEFT JOIN lab ON lab.item_id = r.id)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = lambda *names: F.array(*map(F.lit, names))
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id")).distinct().where("item_id % 5 <> 0")
    return ids.select("item_id", array("click", "view", "signup", "error").alias("allowed"), array("click", "view").alias("required"), array("click", "view").alias("first_ok"))


def _tool_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tool_items(records(spark, sf_dir), calls(spark, sf_dir), _labels(spark, sf_dir))


@query("tool_item_blocks", f"WITH {TOOL_ITEMS} SELECT id AS item_id, n_calls, failed AS failed_calls, first_tool, 't0' AS method, steps, batched_steps, batched, redundant AS redundant_calls, agent AS agent_llm_calls, more AS more_calls_than_steps, set_ok AS tool_set_ok, first_ok_ AS first_tool_ok FROM ti")
def tool_item_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tool_items(spark, sf_dir).select("item_id", "n_calls", "failed_calls", "first_tool", "method", "steps", "batched_steps", "batched", "redundant_calls", "agent_llm_calls", "more_calls_than_steps", "tool_set_ok", "first_tool_ok")


def _share(name: str, good: str, of: str) -> str:
    return f"count(*) FILTER (({of}) AND ({good})) AS {name}_n, count(*) FILTER ({of}) AS {name}_of, CASE WHEN count(*) FILTER ({of}) > 0 THEN round(count(*) FILTER (({of}) AND ({good}))::DOUBLE / count(*) FILTER ({of}), 4) END AS {name}"


TOOL_SUMMARY = ", ".join([
    "count(*) AS n_items, sum(n_calls)::BIGINT AS tool_calls, round((sum(n_calls) - sum(failed))::DOUBLE / sum(n_calls), 4) AS call_validity", _share("items_with_a_failed_call", "failed > 0", "true"), _share("first_tool_ok", "first_ok_", "first_ok_ IS NOT NULL"),
    _share("tool_set_ok", "set_ok", "set_ok IS NOT NULL"), _share("allowed_only_ok", "allowed_only", "allowed_only IS NOT NULL"), "sum(steps)::BIGINT AS steps, sum(batched_steps)::BIGINT AS batched_steps", _share("items_with_a_batched_step", "batched", "true"),
    _share("heuristic_batched", "batched", "false"), _share("more_calls_than_steps", "more", "true"), "count(redundant) AS items_measured, sum(redundant)::BIGINT AS redundant_calls, count(*) FILTER (redundant > 0) AS items_with_a_redundant_call",
    "round(avg(agent), 2) AS agent_llm_calls_mean, round(avg(llm_calls), 2) AS llm_calls_mean, count(terminal_failure) AS terminal_failures, round(avg(cost_usd), 6) AS cost_usd_mean, round(sum(cost_usd), 4) AS cost_usd_total", _share("figure_primary", "figure_primary", "figure_applicable"),
])
TOOL_BOTH = "tb AS (SELECT 'overall' AS stratum, * FROM ti UNION ALL SELECT question_type, * FROM ti WHERE question_type <> '')"


@query("tool_summary", f"WITH {TOOL_ITEMS}, {TOOL_BOTH}, a AS (SELECT stratum, {TOOL_SUMMARY} FROM tb GROUP BY stratum) SELECT *, {PLACE} FROM a")
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tool_summary(_tool_items(spark, sf_dir))


@query("tool_compare", f"WITH {TOOL_ITEMS}, {TOOL_BOTH}, a AS (SELECT stratum, {TOOL_SUMMARY} FROM tb GROUP BY stratum), b AS (SELECT stratum, {TOOL_SUMMARY} FROM tb WHERE id % 2 = 0 GROUP BY stratum) SELECT coalesce(a.stratum, b.stratum) AS stratum, a.n_items AS current_n_items, a.tool_calls AS current_tool_calls, a.agent_llm_calls_mean AS current_agent_llm_calls_mean, b.n_items AS baseline_n_items, b.tool_calls AS baseline_tool_calls, b.agent_llm_calls_mean AS baseline_agent_llm_calls_mean FROM a FULL JOIN b ON a.stratum = b.stratum")
def tool_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run beside a baseline; here the baseline is the run's even items."""
    items = _tool_items(spark, sf_dir)
    return R.compare_runs(R.tool_summary(items), R.tool_summary(items.where("item_id % 2 = 0")), ["n_items", "tool_calls", "agent_llm_calls_mean"])


@query("tool_batching_heuristic", f"WITH {RECORDS}, {CALLS}, pc AS (SELECT item_id, count(*) AS n_calls FROM calls GROUP BY item_id), h AS (SELECT id AS item_id, n_calls, greatest(llm_calls - CASE WHEN {JUDGED} THEN attempts ELSE 0 END - 1, 0) AS steps FROM records JOIN pc ON pc.item_id = id) SELECT item_id, 'heuristic' AS method, steps, n_calls > steps AS batched FROM h")
def tool_batching_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no start was recorded: more calls than model steps."""
    untimed = calls(spark, sf_dir).withColumn("start_ms", F.lit(None).cast("double"))
    return R.tool_items(records(spark, sf_dir), untimed, _labels(spark, sf_dir)).select("item_id", "method", "steps", "batched")


@query("tool_arguments_canonical", """SELECT event_id, '{"a":' || CASE WHEN event_id % 3 = 0 THEN '"' || event_id % 7 || '"' ELSE (event_id % 7)::VARCHAR END || ',"b":{"x":"' || event_type || '","y":[1,"1",{"p":true,"q":null}]}}' AS args FROM events""")
def tool_arguments_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments whose keys come in either order at any level are the same text; a number isn't the string of its digits."""
    n = (F.col("event_id") % 7).cast("string")
    n = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n)
    one = F.concat(F.lit('{"b":{"y":[1,"1",{"q":null, "p":true}],"x":"'), "event_type", F.lit('"},"a":'), n, F.lit("}"))
    other = F.concat(F.lit('{"a":'), n, F.lit(', "b":{"x":"'), "event_type", F.lit('","y":[1, "1",{"p":true,"q":null}]}}'))
    return table(spark, sf_dir, "events").select("event_id", S.canonical_args(F.when(F.col("event_id") % 2 == 0, one).otherwise(other)).alias("args"))


@query("lookup_arguments", "WITH e AS (SELECT user_id AS item_id, event_id AS pos, user_id % 3 AS u, event_id % 4 AS k FROM events WHERE event_type = 'view') SELECT item_id, pos, k <> 3 AS ticker_ok, k <> 2 AS concept_present, CASE WHEN u = 0 THEN NULL WHEN k = 0 THEN 'omitted' WHEN k = 1 THEN 'exact' ELSE 'wrong' END AS fiscal_year, CASE WHEN k <> 2 THEN item_id % 2 = 0 END AS concept_resolved, CASE WHEN k <> 2 THEN item_id % 4 = 0 END AS concept_returns_rows FROM e")
def lookup_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("pos"))
    k = F.col("pos") % 4
    args = F.to_json(F.struct(F.when(k == 3, "ZZ").otherwise("aapl").alias("ticker"), F.when(k == 2, " ").otherwise("revenue").alias("concept"), F.when(k == 1, "2024").when(k > 1, "1999").alias("fiscal_year")))
    made = rows.select("item_id", "pos", F.lit("lookup_financial_fact").alias("tool"), args.alias("args"))
    labels = rows.select("item_id").distinct().select("item_id", F.array(F.lit("AAPL")).alias("tickers"), F.when(F.col("item_id") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(2024).cast("bigint"))).alias("years"))
    found = rows.select("item_id", "pos", (F.col("item_id") % 2 == 0).alias("resolved"), F.when(F.col("item_id") % 4 == 0, 1).otherwise(0).alias("n_rows"))
    return R.lookup_checks(made, labels, found)


# metering

METER = """m AS (SELECT conv_id AS run_id, max(turn) * 100.0 AS ms, count(*) FILTER (role = 'assistant') AS e_calls, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS e_in, count(*) FILTER (role <> 'assistant') AS tools, coalesce(sum(turn * 1.5) FILTER (role <> 'assistant'), 0) AS tool_ms,
  CASE WHEN conv_id % 3 > 0 THEN count(*) FILTER (role = 'assistant') ELSE 0 END AS m_calls, CASE WHEN conv_id % 3 > 0 THEN coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) ELSE 0 END::BIGINT AS m_in FROM conversations GROUP BY conv_id)"""


@query("meter_summary", f"WITH {METER}, z AS (SELECT *, m_in + 2 * m_calls > 0 AS said FROM m) SELECT run_id, round(ms, 1)::DOUBLE AS latency_ms, CASE WHEN said THEN m_calls ELSE e_calls END AS llm_calls, CASE WHEN said THEN m_in ELSE e_in END AS input_tokens, CASE WHEN said THEN 2 * m_calls ELSE e_calls END::BIGINT AS output_tokens, tools AS n_tool_calls, round(tool_ms, 1)::DOUBLE AS tool_ms_total, round(((CASE WHEN said THEN m_in ELSE e_in END) * 0.75 + (CASE WHEN said THEN 2 * m_calls ELSE e_calls END) * 3.75) / 1e6, 6) AS cost_usd FROM z")
def meter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of an assistant are model calls, others tool calls; two runs of three have usage in their messages."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "run_id")
    llm = F.col("role") == "assistant"
    runs = turns.groupBy("run_id").agg((F.max("turn") * 100.0).alias("end_ms")).select("run_id", F.lit("gemini-3.6-flash").alias("model"), F.lit(0.0).alias("start_ms"), "end_ms")
    n = F.length("text").cast("long")
    events = turns.select("run_id", F.when(llm, "llm").otherwise("tool").alias("kind"), F.col("role").alias("name"), (F.col("turn") * 1.5).alias("ms"), n.alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    messages = turns.where(llm & (F.col("run_id") % 3 > 0)).select("run_id", n.alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"))
    summary = R.meter(runs, events, messages, N.cost_usd(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))
    return summary.select("run_id", "latency_ms", "llm_calls", "input_tokens", "output_tokens", "n_tool_calls", "tool_ms_total", "cost_usd")


@query("message_tokens", "SELECT conv_id AS run_id, count(*) FILTER (turn % 2 = 0) AS m_calls, sum(length(text)) FILTER (turn % 2 = 0)::BIGINT AS m_input_tokens, sum(turn) FILTER (turn % 4 = 0)::BIGINT AS out FROM conversations GROUP BY conv_id".replace("AS out", "AS m_output_tokens").replace("sum(turn) FILTER (turn % 4 = 0)", "CASE WHEN count(*) FILTER (turn % 2 = 0) > 0 THEN coalesce(sum(turn) FILTER (turn % 4 = 0), 0) END"))
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.when(turn % 2 == 0, F.length("text").cast("long")).alias("input_tokens"), F.when(turn % 4 == 0, turn).alias("output_tokens"))
    return R.tokens_of(rows)


@query("safe_arguments", "SELECT conv_id, turn, json_object('q', left(text, 200), 'role', role)::VARCHAR AS whole FROM conversations")
def safe_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", S.safe_args(F.create_map(F.lit("q"), F.col("text"), F.lit("role"), F.col("role"))).alias("whole"))


# strings


def _blocks() -> Column:
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    return F.array(block("text", F.col("role")), block("image", F.lit(None).cast("string")), block("text", F.lit("")), block("text", F.col("text")), block("note", F.lit("n")))


@query("payload_texts", "SELECT conv_id, turn, concat_ws(chr(10), role, nullif(text, ''), 'n') AS observation, role || text AS answer FROM conversations")
def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.observation_text(_blocks()).alias("observation"), S.content_text(_blocks()).alias("answer"))


@query("thread_ids", "SELECT conv_id, turn, left(regexp_replace('probe-run 1-' || role || '.' || conv_id, '[^\\p{L}\\p{N}_-]', '_', 'g'), 64) AS probe, CASE WHEN length(left(regexp_replace(left(text, 3 + turn * 20), '[^A-Za-z0-9_-]', '_', 'g'), 64)) < 8 THEN rpad(left(regexp_replace(left(text, 3 + turn * 20), '[^A-Za-z0-9_-]', '_', 'g'), 64), 8, '_') ELSE left(regexp_replace(left(text, 3 + turn * 20), '[^A-Za-z0-9_-]', '_', 'g'), 64) END AS client FROM conversations")
def thread_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.left("text", (3 + F.col("turn") * 20).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.thread_id(F.lit("run 1"), F.concat("role", F.lit("."), F.col("conv_id").cast("string"))).alias("probe"), S.sanitized_thread(raw).alias("client"))


@query(
    "answer_stream",
    """WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 4 THEN ' ' WHEN conv_id % 9 = 5 THEN 'I need more steps' ELSE text END AS answer FROM conversations WHERE role = 'assistant'),
u AS (SELECT *, regexp_extract_all(answer, '\\S+\\s*') AS words FROM a WHERE conv_id % 9 NOT IN (4, 5)), w AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS seq FROM u)
SELECT conv_id, turn, seq::BIGINT AS seq, 'token' AS kind, word AS payload FROM w
UNION ALL SELECT conv_id, turn, len(words) + i, ['sources', 'verification', 'meta', 'done'][i + 1], CASE i WHEN 0 THEN '[{"id":"T_10K_chunk_' || turn || '","rank":1}]' WHEN 1 THEN '{"status":"' || CASE WHEN conv_id % 2 = 0 THEN 'verified' ELSE 'refused' END || '","n_figures":' || turn || '}' WHEN 2 THEN '{"words":' || len(words) || '}' ELSE '' END FROM u, range(4) t(i)
UNION ALL SELECT conv_id, turn, 0, 'error', CASE conv_id % 9 WHEN 4 THEN 'empty_answer' ELSE 'recursion_limit' END FROM a WHERE conv_id % 9 IN (4, 5)""",
)
def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that send an answer, in order: its words, then sources, verification, meta and done, or an error."""
    n, turn = F.col("conv_id"), F.col("turn")
    answer = F.when(n % 9 == 4, " ").when(n % 9 == 5, "I need more steps").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", answer.alias("answer"), F.array(F.struct(F.concat(F.lit("T_10K_chunk_"), turn.cast("string")).alias("id"), F.lit(1).alias("rank"))).alias("sources"),
        F.struct(F.when(n % 2 == 0, "verified").otherwise("refused").alias("status"), turn.alias("n_figures")).alias("verification"), F.struct(F.size(S.answer_words(answer)).alias("words")).alias("meta"),
    )
    return serving.answer_events(rows, ["conv_id", "turn"], "need more steps")


@query("display_strings", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) || ' (company: ' || upper(lang) || ')' ELSE left(text, 20) END AS question, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'fact ' || doc_id ELSE '' END AS place, 'sha256:' || left(sha256(text), 12) AS version, concat_ws('-', 'hybrid', CASE WHEN doc_id % 2 = 0 THEN 'rerank50' END, CASE WHEN doc_id % 5 > 0 THEN 'ticker-inferred' END) AS label FROM documents")
def display_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ident = F.col("doc_id"), F.col("doc_id").cast("string")
    source = F.when(n % 3 == 0, F.concat(F.lit("AAPL_10K_chunk_"), ident)).when(n % 3 == 1, F.concat(F.lit("AAPL_10K_fact_"), ident)).otherwise("x.htm")
    return table(spark, sf_dir, "documents").select(
        "doc_id", S.build_question(F.left("text", F.lit(20)), F.when(n % 2 == 0, F.col("lang"))).alias("question"), S.chunk_idx_of(source).alias("place"), S.fingerprint(F.col("text")).alias("version"),
        S.config_label(F.lit("hybrid"), n % 2 == 0, F.lit(50), F.when(n % 5 > 0, "inferred").otherwise("none")).alias("label"),
    )


@query("verification_prompts", "SELECT item_id, 'Question: q' || item_id || chr(10) || chr(10) || 'Draft answer:' || chr(10) || text || chr(10) || chr(10) || 'Observations:' || chr(10) || '[a] ' || item_id || chr(10) || chr(10) || '[b] x' || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || 'The last record failed:' || chr(10) || '- one' || chr(10) || '- two' ELSE '' END AS prompt FROM benchmark")
def verification_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.col("item_id").cast("string")
    seen = F.array(F.struct(F.lit("a").alias("id"), ident.alias("text")), F.struct(F.lit("b").alias("id"), F.lit("x").alias("text")))
    reasons = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("one"), F.lit("two")))
    return table(spark, sf_dir, "benchmark").select("item_id", S.verification_prompt(F.concat(F.lit("q"), ident), F.col("text"), seen, reasons).alias("prompt"))


# probe

TURNS = """tn AS (SELECT conv_id AS conversation, turn, turn > 0 AS depends, conv_id % 7 = 0 AS refused, (conv_id + turn) % 3 > 0 AS primary_ok, length(text) AS n FROM conversations WHERE role = 'user'),
plan AS (SELECT 0 AS part, *, 'memory' AS mode FROM tn UNION ALL SELECT 1, *, 'isolated' FROM tn WHERE depends)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("conversation"), "turn", (F.col("turn") > 0).alias("depends_on_history"), F.length("text").alias("n"))


@query("probe_requests", f"WITH {TURNS} SELECT part, conversation, turn, mode, CASE WHEN mode = 'memory' THEN conversation::VARCHAR END AS thread FROM plan")
def probe_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.probe_plan(_turns(spark, sf_dir))


@query("probe_block", f"WITH {TURNS}, a AS (SELECT *, NOT refused AND primary_ok AND (mode = 'memory' OR turn % 4 = 0) AS correct, CASE WHEN conversation % 9 = 0 THEN 502 ELSE 200 END AS http, round(n / 1e5, 6) AS cost FROM plan) SELECT count(*) FILTER (mode = 'memory' AND depends) AS n_follow_up_turns, count(*) FILTER (mode = 'memory' AND NOT depends) AS n_first_turns, count(*) FILTER (mode = 'memory' AND depends AND correct) AS correct_with_memory, count(*) FILTER (mode = 'isolated' AND depends AND correct) AS correct_in_isolation, count(*) FILTER (mode = 'memory' AND NOT depends AND correct) AS first_turns_correct, count(*) AS n_requests, count(*) FILTER (http <> 200) AS http_errors, count(*) FILTER (refused) AS refused, round(sum(cost), 6) AS cost_usd_actual, round(sum(cost) * 1.25, 6) AS cost_usd_counted, round(avg(n), 1) AS latency_ms_mean FROM a")
def probe_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-ups right with memory against those right on their own."""
    turns = _turns(spark, sf_dir)
    plan = R.probe_plan(turns).join(turns, ["conversation", "turn"])
    status = F.when(F.col("conversation") % 7 == 0, "refused").otherwise("verified")
    primary = ((F.col("conversation") + F.col("turn")) % 3 > 0) & ((F.col("mode") == "memory") | (F.col("turn") % 4 == 0))
    rows = plan.select("mode", "depends_on_history", R.turn_score(F.lit(True), primary, F.lit("an answer"), status).alias("correct"), F.when(F.col("conversation") % 9 == 0, 502).otherwise(200).alias("http_status"), status.alias("status"), F.round(F.col("n") / 1e5, 6).alias("cost_usd"), F.col("n").alias("latency_ms"))
    return R.probe_summary(rows)


@query("probe_cost", f"WITH {TURNS}, p AS (SELECT conversation, count(*) AS queries FROM plan GROUP BY conversation) SELECT conversation, queries, round(queries * 0.0025, 4)::DOUBLE AS expected_usd, round(queries * 0.0025 * 1.25, 4)::DOUBLE AS counted_usd FROM p")
def probe_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, counted = R.expected_cost(F.col("queries"))
    plan = R.probe_plan(_turns(spark, sf_dir)).groupBy("conversation").agg(F.count("*").alias("queries"))
    return plan.select("conversation", "queries", expected.alias("expected_usd"), counted.alias("counted_usd"))


@query("spending_cap", f"WITH {TURNS}, s AS (SELECT part, conversation, turn, sum(n / 1e5::DOUBLE) OVER (ORDER BY part, conversation, turn ROWS UNBOUNDED PRECEDING) AS spent FROM plan) SELECT part, conversation, turn, round(spent, 6) AS spent FROM s WHERE round(spent, 6) <= 0.05")
def spending_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a whole plan that its cap pays for, in the plan's order."""
    turns = _turns(spark, sf_dir)
    plan = R.probe_plan(turns).join(turns.select("conversation", "turn", (F.col("n") / 1e5).alias("cost")), ["conversation", "turn"])
    return ranges.until_cap(plan, ["part", "conversation", "turn"], "cost", 0.05).select("part", "conversation", "turn", "spent")


@query(
    "spending_resumed",
    f"""WITH {TURNS}, p AS (SELECT part, conversation, turn, n / 1e5::DOUBLE AS cost, conversation % 11 = 10 AND turn > 0 AS quota FROM plan WHERE NOT (part = 0 AND conversation % 3 = 0)),
s AS (SELECT *, sum(cost) OVER w AS spent, coalesce(max(quota::INTEGER) OVER (ORDER BY part, conversation, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM p WINDOW w AS (ORDER BY part, conversation, turn ROWS UNBOUNDED PRECEDING))
SELECT part, conversation, turn, round(spent, 6) AS spent, quota FROM s WHERE stopped = 0 AND round(spent, 6) <= 0.08""",
)
def spending_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that goes on from what it has stored, until its first quota error or its cap."""
    turns = _turns(spark, sf_dir)
    quota = (F.col("conversation") % 11 == 10) & (F.col("turn") > 0)
    plan = R.probe_plan(turns).join(turns.select("conversation", "turn", (F.col("n") / 1e5).alias("cost")), ["conversation", "turn"]).withColumn("quota", quota)
    cache = plan.where("part = 0 and conversation % 3 = 0")
    found = ranges.resumed(plan, cache, ["part", "conversation", "turn"], ["part", "conversation", "turn"], "cost", 0.08, "quota")
    return found.select("part", "conversation", "turn", "spent", "quota")


@query("leaderboard", f"WITH {RECORDS}, l AS (SELECT CASE WHEN id % 3 = 0 THEN 'retrieval' WHEN id % 3 = 1 THEN 'generation' ELSE 'legacy' END AS kind, 'run-' || id AS run_id, faithfulness AS metric FROM records) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY coalesce(metric, 0) DESC, run_id) AS place FROM l")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("retrieval"), F.lit("generation"), F.lit("legacy")), (F.col("id") % 3 + 1).cast("int"))
    rows = records(spark, sf_dir).select(kind.alias("kind"), F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), F.element_at("scores", F.lit("faithfulness")).alias("metric"))
    return R.rank_runs(rows, "metric", ["kind"])


assert O.SLACK_MS == 50  # as the SQL of STEPS says
