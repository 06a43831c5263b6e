"""Blocks over the records of a run: generation aggregates, tool-call blocks, side-by-side comparisons, judged gates.

A record is a row with id and question_type and, as far as known, llm_calls, input_tokens, output_tokens, latency_ms, cost_usd,
terminal_failure, error, tools_used (map), retrieved (array), status, attempts, repaired and failures of its verification, the
figure_*, draft_primary, labelled, hit, recall, mrr and grounding columns of its deterministic checks, and scores (map).
A value that is null isn't applicable and never counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import figures as G
from siltstone.functions import numbers as N
from siltstone.operators import metrics as M
from siltstone.operators import tools as O

#: What names a provider's refusal for quota or rate, fixed values.
QUOTA_MARKERS = ("resource_exhausted", "resourceexhausted", "429", "quota", "rate limit", "ratelimit", "too many requests")
SEARCH_TOOLS = ("search_filings", "compare_companies")
QUESTION_TYPES = ("lookup", "comparison", "trend")
OVERALL = "overall"


def is_quota_error(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(QUOTA_MARKERS)), F.lit(False))


def searched(tools: Column, retrieved: Column) -> Column:
    """Whether a run searched: by its tools if it names any, else by the chunks that it saw."""
    used = F.coalesce(F.size(F.map_keys(tools)), F.lit(0)) > 0
    by_tools = F.arrays_overlap(F.map_keys(F.map_filter(tools, lambda _, n: n > 0)), F.array(*map(F.lit, SEARCH_TOOLS)))
    return F.when(used, by_tools).otherwise(F.coalesce(F.size(retrieved), F.lit(0)) > 0)


def agent_llm_calls(llm_calls: Column, status: Column, attempts: Column) -> Column:
    """Model calls of the agent alone: without one for each attempt at verification, where that ran."""
    ran = status.isNotNull() & (status != "skipped")
    return llm_calls - F.when(ran, F.coalesce(attempts, F.lit(0))).otherwise(0)


def strata(rows: DataFrame, blocks: list[Column], by: str = "question_type", order: tuple[str, ...] = QUESTION_TYPES, within: tuple[str, ...] = ()) -> DataFrame:
    """A row for all records and one for each value of ``by`` (blank ones are in the first only): stratum, place and the columns ``blocks``; for each of ``within``, if given.

    Declared strata come first, others by name; both come from one pass over the records.
    """
    sets = rows.groupingSets([[*within], [*within, by]], *within, by).agg(F.grouping(by).alias("_all"), *blocks)
    sets = sets.where((F.col("_all") == 1) | (F.coalesce(F.col(by), F.lit("")) != ""))
    place = F.when(F.col("_all") == 1, -1).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(by)), F.lit(0)), F.lit(len(order) + 1)))
    return sets.select(*within, F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(by)).alias("stratum"), place.cast("long").alias("place"), *[c for c in sets.columns if c not in (by, "_all", *within)])


def _mean(value: Column, where: Column, digits: int = 4) -> Column:
    return F.round(F.avg(F.when(where, value.cast("double"))), digits)


def deterministic_block() -> list[Column]:
    """Means of the judge-free checks, each over the records that it applies to."""
    col, rate = F.col, lambda c: F.when(c, 1.0).otherwise(0.0)
    figure, lab, grounding = col("figure_applicable"), col("labelled"), col("grounding_applicable")
    seen = lab & searched(col("tools_used"), col("retrieved"))
    judged = col("status").isNotNull() & (col("status") != "skipped")
    return [
        F.count_if(figure).alias("n_figure_applicable"), _mean(col("figure_recall"), figure).alias("figure_recall"), _mean(rate(col("figure_exact")), figure).alias("figure_exact_rate"),
        _mean(rate(col("figure_primary")), figure).alias("figure_primary_rate"), _mean(rate(F.coalesce("draft_primary", "figure_primary")), figure).alias("figure_primary_rate_draft"),
        F.count_if(lab).alias("n_labelled"), _mean(rate(col("hit")), lab).alias("agent_hit_rate"), _mean(col("recall"), lab).alias("agent_recall"), _mean(col("mrr"), lab).alias("agent_mrr"),
        F.count_if(seen).alias("n_searched"), _mean(rate(col("hit")), seen).alias("agent_hit_rate_searched"),
        F.count_if(grounding).alias("n_grounding_applicable"), _mean(rate(col("n_grounded") == col("n_figures")), grounding).alias("grounded_rate"), _mean(col("n_grounded") / col("n_figures"), grounding).alias("grounded_figure_rate"),
        F.count_if(judged).alias("n_verified_applicable"), *[_mean(rate(c), judged).alias(n) for n, c in (("verified_rate", col("status") == "verified"), ("repaired_rate", col("repaired")), ("refused_rate", col("status") == "refused"))],
    ]


def cost_block() -> list[Column]:
    """Tokens, calls and cost over the records with a latency."""
    col, metered = F.col, F.col("latency_ms").isNotNull()
    zero = lambda c: F.coalesce(col(c), F.lit(0))
    n_tools = F.aggregate(F.coalesce(F.map_values("tools_used"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return [
        F.count_if(metered).alias("n_metered"), F.round(F.avg("latency_ms"), 1).alias("latency_ms_mean"),
        *[F.bround(F.avg(F.when(metered, zero(c))), 0).cast("long").alias(f"{c}_mean") for c in ("input_tokens", "output_tokens")],
        _mean(zero("llm_calls"), metered, 2).alias("llm_calls_mean"), _mean(col("cost_usd"), metered, 6).alias("cost_usd_mean"), F.round(F.sum(F.when(metered, col("cost_usd"))), 4).alias("cost_usd_total"),
        _mean(n_tools, metered, 2).alias("tool_calls_mean"),
    ]


def score_block(metrics: tuple[str, ...]) -> list[Column]:
    """Of each judged metric both means, with what was scored, what wasn't, and what failed."""
    out = []
    for m in metrics:
        raw = F.element_at("scores", F.lit(m))
        score = F.when(raw.isNotNull() & ~F.isnan(raw), raw)
        failed = F.col("terminal_failure").isNotNull() & score.isNull()
        out += [
            F.round(F.avg(score), 4).alias(f"{m}_mean"), N.ratio(F.sum(score), F.count(score) + F.count_if(failed)).alias(f"{m}_failures_as_zero"), F.count(score).alias(f"{m}_n_scored"),
            F.count_if(score.isNull()).alias(f"{m}_n_nan"), F.count_if(failed).alias(f"{m}_n_terminal"), F.count_if(score.isNull() & F.col("terminal_failure").isNull()).alias(f"{m}_n_unexplained"),
        ]
    return out


def aggregate_blocks(metrics: tuple[str, ...]) -> list[Column]:
    return [F.count("*").alias("n_items"), *score_block(metrics), *deterministic_block(), *cost_block()]


def generation_aggregates(records: DataFrame, metrics: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Judged means, deterministic checks and costs, overall and by question type, with latency percentiles; for each of ``within`` (a run), if given."""
    block = strata(records, aggregate_blocks(metrics), within=within)
    return block.join(latency(records, "latency_ms", within=within).drop("n", "mean"), [*within, "stratum"], "left")


#: What the checks by labels give, and what a record without a label has.
AGENT = ("labelled", "n_groups", "hit", "recall", "mrr", "first_rank")


def agent_retrieval(records: DataFrame, groups: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, labelled, n_groups, hit, recall, mrr, first_rank) of the records (keys, id, retrieved) whose item has label groups (item_id, group_id, doc_id)."""
    asked = records.select(*keys, F.col("id").alias("item_id")).distinct()
    ranked = records.select(*keys, F.posexplode("retrieved").alias("_at", "doc_id")).groupBy(*keys, "doc_id").agg((F.min("_at") + 1).alias("_rank"))
    hits = asked.join(groups, "item_id").join(ranked, [*keys, "doc_id"], "left").groupBy(*keys, "group_id").agg(F.min("_rank").alias("_hit"))
    return hits.groupBy(*keys).agg(
        F.lit(True).alias("labelled"), F.count("*").alias("n_groups"), F.min("_hit").isNotNull().alias("hit"), F.round(F.avg(F.when(F.col("_hit").isNotNull(), 1.0).otherwise(0.0)), 4).alias("recall"),
        F.round(F.coalesce(1 / F.min("_hit"), F.lit(0.0)), 4).alias("mrr"), F.min("_hit").alias("first_rank"),
    )


def attach_deterministic(records: DataFrame, groups: DataFrame | None = None, keys: tuple[str, ...] = ("id",), scored: Column | None = None) -> DataFrame:
    """Records with their judge-free checks: figure_*, draft_primary, grounding_*, and by labels labelled, n_groups, hit, recall, mrr, first_rank.

    records: (keys, id, ground_truth, answer, draft_answer, status, observations, retrieved); groups: (item_id, group_id, doc_id), without which what the records
    hold of an agent's retrieval is kept as it is, as it is where ``scored`` doesn't hold. A refused answer states no figure; a draft counts where it isn't the answer;
    items without a label have nulls. ``keys`` tell records apart: with the records of several runs, the run and the id.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    seen = F.array_join(F.coalesce("observations", F.array().cast("array<string>")), "\n")
    rows = records.withColumn("_truth", G.extract(text("ground_truth"))).withColumn("_said", G.extract(text("answer"))).withColumn("_drafted", G.extract(F.coalesce("draft_answer", text("answer")))).withColumn("_seen", G.extract(seen))
    rows = rows.withColumn("_f", G.figure_match(F.col("_truth"), F.col("_said"))).withColumn("_d", G.figure_match(F.col("_truth"), F.col("_drafted"))).withColumn("_g", G.grounding(F.col("_drafted"), F.col("_seen")))
    refused, use = F.coalesce(F.col("status") == "refused", F.lit(False)), F.col("_f.applicable")
    other = F.col("draft_answer").isNotNull() & ~F.col("draft_answer").eqNullSafe(F.col("answer"))
    checked = {
        "figure_applicable": use, "figure_recall": F.when(use, F.when(refused, 0.0).otherwise(F.col("_f.recall"))), "figure_exact": F.when(use, ~refused & F.col("_f.exact")), "figure_primary": F.when(use, ~refused & F.col("_f.primary_found")),
        "draft_primary": F.when(other & use, F.col("_d.primary_found")), "grounding_applicable": F.col("_g.applicable"), "n_figures": F.col("_g.n_figures"), "n_grounded": F.col("_g.n_grounded"),
    }
    rows = rows.withColumns(checked).drop("_truth", "_said", "_drafted", "_seen", "_f", "_d", "_g")
    if groups is None:
        return rows
    marked = rows.withColumn("_scored", F.lit(True) if scored is None else F.coalesce(scored, F.lit(False)))
    fresh = agent_retrieval(marked.where("_scored"), groups, keys)
    rows = marked.join(fresh.select(*keys, *[F.col(c).alias(f"_{c}") for c in AGENT]), list(keys), "left")
    new = {c: F.col(f"_{c}") for c in AGENT} | {"labelled": F.coalesce("_labelled", F.lit(False)), "n_groups": F.coalesce("_n_groups", F.lit(0).cast("long"))}
    held = {c: F.when(F.col("_scored"), new[c]).otherwise(F.col(c)) if c in records.columns else F.when(F.col("_scored"), new[c]) for c in AGENT}
    return rows.withColumns(held).drop("_scored", *[f"_{c}" for c in AGENT])


#: Version of the rules by which figures are found and matched, kept with what they gave.
FIGURE_RULES = 1
ALL_CHECKS, FIGURES_ONLY = "figures, grounding, agent retrieval and aggregates", "figures and grounding; agent retrieval kept, its labels are of another index"


def _generation(runs: DataFrame, version: str) -> DataFrame:
    """(run, same_index, has_aggregates) of the generation runs among (run, result_kind, benchmark_version, has_aggregates)."""
    same = F.col("benchmark_version").eqNullSafe(F.lit(version))
    return runs.where("result_kind = 'generation'").select("run", same.alias("same_index"), F.coalesce("has_aggregates", F.lit(False)).alias("has_aggregates"))


def recomputed(records: DataFrame, runs: DataFrame, groups: DataFrame, version: str) -> DataFrame:
    """Stored records of the generation runs under the present rules; judged scores stay.

    records: (run, id, ...) as generation_aggregates() and attach_deterministic() take them, an id once in a run; runs: (run, result_kind, benchmark_version, has_aggregates).
    Labels belong to one index: a run of another benchmark version than ``version`` keeps the agent retrieval that it was scored with, and has its figures and grounding done anew.
    """
    taken = _generation(runs, version).select("run", F.col("same_index").alias("_same"))
    return attach_deterministic(records.join(taken, "run"), groups, ("run", "id"), F.col("_same")).drop("_same")


def recomputed_aggregates(records: DataFrame, runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Aggregates of what recomputed() gave, by run and stratum, for runs that had some; where no run had, nothing."""
    rows = records.join(_generation(runs, "").where("has_aggregates").select("run"), "run", "left_semi")
    return generation_aggregates(rows, metrics, ("run",))


def recompute_notes(runs: DataFrame, version: str) -> DataFrame:
    """(run, what, same_index, figure_rules): what recomputed() did to each run."""
    taken = _generation(runs, version)
    return taken.select("run", F.when(F.col("same_index"), ALL_CHECKS).otherwise(FIGURES_ONLY).alias("what"), "same_index", F.lit(FIGURE_RULES).alias("figure_rules"))


def tool_totals(records: DataFrame) -> DataFrame:
    """(stratum, tool, n): calls of each tool over the metered records."""
    rows = records.where("latency_ms is not null").select("question_type", F.explode("tools_used").alias("tool", "calls"))
    sets = rows.groupingSets([["tool"], ["tool", "question_type"]], "tool", "question_type").agg(F.grouping("question_type").alias("_all"), F.sum("calls").alias("n"))
    return sets.where("_all = 1 or coalesce(question_type, '') <> ''").select(F.when(F.col("_all") == 1, OVERALL).otherwise(F.col("question_type")).alias("stratum"), "tool", "n")


def failure_counts(records: DataFrame) -> DataFrame:
    """(check, n): failed checks of the records that went through verification."""
    judged = records.where("status is not null and status <> 'skipped'")
    return judged.select(F.explode("failures").alias("check")).groupBy("check").agg(F.count("*").alias("n"))


def latency(records: DataFrame, value: str, exclude_terminal: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, stratum, n, mean, p50, p95, p50_linear, p95_linear) overall and by question type."""
    rows = records.where(F.col(value).isNotNull())
    rows = rows.where(F.col("terminal_failure").isNull()) if exclude_terminal else rows
    both = rows.select(*within, F.explode(F.array(F.lit(OVERALL), F.nullif(F.col("question_type"), F.lit("")))).alias("stratum"), F.col(value).alias("_value")).where("stratum is not null")
    means = both.groupBy(*within, "stratum").agg(F.count("*").alias("n"), F.round(F.avg("_value"), 1).alias("mean"))
    wanted = {"p50": ("nearest", 50), "p95": ("nearest", 95), "p50_linear": ("linear", 50), "p95_linear": ("linear", 95)}
    return means.join(N.percentiles(both, [*within, "stratum"], "_value", wanted), [*within, "stratum"])


def subset(records: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of ``ids`` (column id), and one row (n_requested, n_generated, complete)."""
    rows = records.join(ids.select("id").distinct(), "id", "left_semi")
    asked = ids.agg(F.count_distinct("id").alias("n_requested"))
    got = rows.agg(F.count_distinct("id").alias("n_generated"))
    return rows, asked.join(got).withColumn("complete", F.col("n_requested") == F.col("n_generated"))  # one row each


def judged_values(records: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, value): what the judged thresholds apply to."""
    failures = F.count_if(F.col("terminal_failure").isNotNull() | F.col("error").isNotNull())
    block = records.agg(*score_block(metrics), *deterministic_block(), failures.alias("terminal_failures"))
    unexplained = sum((F.col(f"{m}_n_unexplained") for m in metrics), start=F.lit(0))
    values = {m: F.col(f"{m}_failures_as_zero") for m in metrics} | {"figure_primary_rate": F.col("figure_primary_rate"), "terminal_failures": F.col("terminal_failures"), "unexplained_nan": unexplained}
    return block.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])))


def calibration_values(records: DataFrame, ids: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(metric, value) of a committed run over the items of a gate alone: what its thresholds sit under."""
    return judged_values(subset(records, ids)[0], metrics)


def mismatches(config: DataFrame, expected: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """(key, expected, got) where a run's configuration differs from what its thresholds were set for; both are (key, value)."""
    got = F.coalesce(F.col("value"), F.element_at(F.create_map(*[F.lit(x) for kv in (defaults or {"": ""}).items() for x in kv]), F.col("key")))
    rows = expected.withColumnRenamed("value", "expected").join(config, "key", "left").withColumn("got", got)
    return rows.where(~F.col("expected").eqNullSafe(F.col("got"))).select("key", "expected", "got")


def gate_problems(thresholds: DataFrame, committed: DataFrame) -> DataFrame:
    """(scope, metric, problem): thresholds without a committed value, or above it. Both are keyed by scope and metric."""
    rows = thresholds.join(committed.withColumnRenamed("value", "committed"), ["scope", "metric"], "left")
    problem = F.when(F.col("committed").isNull(), "no committed value").when(F.col("higher_is_better") & (F.col("threshold") > F.col("committed")), "threshold above the committed value")
    problem = problem.when(~F.col("higher_is_better") & (F.col("committed") > F.col("threshold")), "committed value above the limit")
    return rows.select("scope", "metric", problem.alias("problem")).where("problem is not null")


def tool_items(records: DataFrame, calls: DataFrame, labels: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Of each record with calls: counts, failures, first tool and how it was found, batching, redundancy, conformity to its label, argument checks.

    calls: (item_id, pos, tool, start_ms, ms, error, args), labels as in tools.conformity, checks as lookup_checks gives them.
    A record without calls in its meter has no row in ``calls`` and counts no calls; items without a label have null there.
    """
    per = calls.groupBy("item_id").agg(F.count("*").alias("n_calls"), F.count_if("error").alias("failed_calls"), F.count("args").alias("n_calls_with_args"))
    first = O.first_calls(calls)
    rows = records.withColumnRenamed("id", "item_id").join(per, "item_id", "left").join(first, "item_id", "left").join(O.redundant(calls), "item_id", "left").join(O.batches(calls), "item_id", "left")
    rows = rows.join(O.conformity(calls, labels).drop("first_tool"), "item_id", "left")
    for c in ("n_calls", "failed_calls", "n_calls_with_args"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    agent = agent_llm_calls(F.col("llm_calls"), F.col("status"), F.col("attempts"))
    steps = F.greatest(agent - 1, F.lit(0))  # the last call is the answer
    heuristic = F.col("steps").isNull()
    rows = rows.withColumn("agent_llm_calls", agent).withColumn("more_calls_than_steps", F.coalesce(F.col("n_calls") > steps, F.lit(False)))
    rows = rows.withColumn("method", F.when(heuristic, "heuristic").otherwise("t0")).withColumn("batched", F.when(heuristic, F.col("more_calls_than_steps")).otherwise(F.col("batched")))
    rows = rows.withColumn("steps", F.coalesce(F.col("steps"), steps)).withColumn("redundant_calls", F.when(F.col("n_calls_with_args") > 0, F.col("redundant_calls")))
    if checks is not None:
        good = [F.count_if(c).alias(c) for c in ("ticker_ok", "concept_present", "concept_resolved", "concept_returns_rows")]
        years = [F.count_if(F.col("fiscal_year") == y).alias(f"year_{y}") for y in ("exact", "omitted", "wrong")]
        counted = checks.groupBy("item_id").agg(F.count("*").alias("lookup_calls"), F.count("concept_returns_rows").alias("lookup_concepts"), F.count("fiscal_year").alias("lookup_years"), *good, *years)
        rows = rows.join(counted, "item_id", "left")
    return rows


def tool_summary(items: DataFrame) -> DataFrame:
    """The tool-call block, overall and by question type."""
    col, t0 = F.col, F.col("method") == "t0"
    share = lambda name, good, of: [F.count_if(of & good).alias(f"{name}_n"), F.count_if(of).alias(f"{name}_of"), N.ratio(F.count_if(of & good), F.count_if(of)).alias(name)]
    known = lambda c: col(c).isNotNull()
    checks = []
    if "lookup_calls" in items.columns:
        of = {"ticker_ok": "lookup_calls", "concept_present": "lookup_calls", "concept_resolved": "lookup_concepts", "concept_returns_rows": "lookup_concepts", "year_exact": "lookup_years", "year_omitted": "lookup_years", "year_wrong": "lookup_years"}
        checks = [F.coalesce(F.sum("lookup_calls"), F.lit(0)).alias("lookup_calls"), *[N.ratio(F.sum(c), F.sum(n)).alias(f"arg_{c}") for c, n in of.items()]]
    return strata(items, [
        F.count("*").alias("n_items"), F.sum("n_calls").alias("tool_calls"), N.ratio(F.sum("n_calls") - F.sum("failed_calls"), F.sum("n_calls")).alias("call_validity"), *share("items_with_a_failed_call", col("failed_calls") > 0, F.lit(True)),
        *share("first_tool_ok", col("first_tool_ok"), known("first_tool_ok")), *share("tool_set_ok", col("tool_set_ok"), known("tool_set_ok")), *share("allowed_only_ok", F.size("disallowed") == 0, known("disallowed")),
        F.sum(F.when(t0, col("steps"))).alias("steps"), F.sum("batched_steps").alias("batched_steps"), *share("items_with_a_batched_step", col("batched"), t0), *share("heuristic_batched", col("batched"), ~t0),
        *share("more_calls_than_steps", col("more_calls_than_steps"), F.lit(True)), F.count("redundant_calls").alias("items_measured"), F.sum("redundant_calls").alias("redundant_calls"), F.count_if(col("redundant_calls") > 0).alias("items_with_a_redundant_call"),
        *checks, F.round(F.avg("agent_llm_calls"), 2).alias("agent_llm_calls_mean"), F.round(F.avg("llm_calls"), 2).alias("llm_calls_mean"), F.count("terminal_failure").alias("terminal_failures"),
        F.round(F.avg("cost_usd"), 6).alias("cost_usd_mean"), F.round(F.sum("cost_usd"), 4).alias("cost_usd_total"), *share("figure_primary", col("figure_primary"), col("figure_applicable")),
    ])


def compare_runs(current: DataFrame, baseline: DataFrame, columns: list[str]) -> DataFrame:
    """Two summaries side by side by stratum: current_c and baseline_c of each column; a stratum that one lacks has nulls there."""
    side = lambda df, name: df.select("stratum", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return side(current, "current").join(side(baseline, "baseline"), "stratum", "full_outer")


def lookup_checks(calls: DataFrame, labels: DataFrame, found: DataFrame | None = None, tool: str = "lookup_financial_fact") -> DataFrame:
    """One row for each look-up call with arguments (JSON) of a labelled item: is the ticker the label's, is there a concept, is the year right,
    and, with ``found`` (item_id, pos, resolved, n_rows), does the concept resolve and return rows.

    labels: (item_id, tickers, years). Years of a label that names none are not applicable.
    """
    arg = lambda k: F.get_json_object("args", f"$.{k}")
    rows = calls.where((F.col("tool") == tool) & F.col("args").isNotNull()).join(labels.select("item_id", "tickers", "years"), "item_id")
    year = F.when(F.trim(arg("fiscal_year")).rlike("^[0-9]+$"), F.trim(arg("fiscal_year")).cast("long"))
    kind = F.when(arg("fiscal_year").isNull(), "omitted").when(F.coalesce(F.array_contains("years", year), F.lit(False)), "exact").otherwise("wrong")
    concept, ticker = F.trim(F.coalesce(arg("concept"), F.lit(""))), F.upper(F.trim(F.coalesce(arg("ticker"), F.lit(""))))
    rows = rows.select("item_id", "pos", F.array_contains(F.transform("tickers", F.upper), ticker).alias("ticker_ok"), (concept != "").alias("concept_present"), F.when(F.size("years") > 0, kind).alias("fiscal_year"), ((concept != "") & (ticker != "")).alias("_asked"))
    if found is None:
        none = F.lit(None).cast("boolean")
        return rows.withColumn("concept_resolved", none).withColumn("concept_returns_rows", none).drop("_asked")
    rows = rows.join(found.select("item_id", "pos", "resolved", "n_rows"), ["item_id", "pos"], "left")
    said = lambda c: F.when(F.col("_asked"), F.coalesce(c, F.lit(False)))
    return rows.withColumn("concept_resolved", said(F.col("resolved"))).withColumn("concept_returns_rows", said(F.col("n_rows") > 0)).drop("_asked", "resolved", "n_rows")


def meter(runs: DataFrame, events: DataFrame, messages: DataFrame, cost: Column) -> DataFrame:
    """A summary of each run: latency, calls, tokens, cost and tool timings.

    runs: (run_id, model, start_ms, end_ms); events: (run_id, kind, name, ms, input_tokens, output_tokens) of kinds llm and tool; messages:
    (run_id, input_tokens, output_tokens) of those with usage, whose sums are preferred where they say anything. ``cost`` reads model, input_tokens, output_tokens.
    """
    llm, tool = F.col("kind") == "llm", F.col("kind") == "tool"
    counted = events.groupBy("run_id").agg(
        F.count_if(llm).alias("e_calls"), *[F.sum(F.when(llm, F.col(c))).alias(f"e_{c}") for c in ("input_tokens", "output_tokens")],
        F.count_if(tool).alias("n_tool_calls"), F.round(F.sum(F.when(tool, F.col("ms"))), 1).alias("tool_ms_total"),
    )
    tools = events.where(tool).groupBy("run_id", "name").agg(F.count("*").alias("n"))
    tools = tools.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tools"))  # a run's few tools
    rows = runs.join(counted, "run_id", "left").join(tools, "run_id", "left").join(tokens_of(messages), "run_id", "left")
    said = F.coalesce(F.col("m_input_tokens") + F.col("m_output_tokens") > 0, F.lit(False))
    pick = lambda c: F.when(said, F.col(f"m_{c}")).otherwise(F.coalesce(F.col(f"e_{c}"), F.lit(0))).cast("long").alias(c)
    rows = rows.select("run_id", "model", F.round(F.col("end_ms") - F.col("start_ms"), 1).alias("latency_ms"), pick("calls"), pick("input_tokens"), pick("output_tokens"), F.coalesce("n_tool_calls", F.lit(0)).alias("n_tool_calls"), "tools", F.coalesce("tool_ms_total", F.lit(0.0)).alias("tool_ms_total"))
    return rows.withColumnRenamed("calls", "llm_calls").withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("cost_usd", cost)


def tokens_of(messages: DataFrame) -> DataFrame:
    """(run_id, m_calls, m_input_tokens, m_output_tokens): sums over the messages that carry usage."""
    used = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    zero = lambda c: F.sum(F.when(used, F.coalesce(F.col(c), F.lit(0)))).alias(f"m_{c}")
    return messages.groupBy("run_id").agg(F.count_if(used).alias("m_calls"), zero("input_tokens"), zero("output_tokens"))


PUBLIC = ("run_id", "latency_ms", "llm_calls", "input_tokens", "output_tokens", "cost_usd", "tools", "tool_ms_total")


def public_meta(summaries: DataFrame) -> DataFrame:
    """What a client may see of a summary: no arguments, no model."""
    return summaries.select(*PUBLIC)


def turn_score(applicable: Column, primary: Column, answer: Column, status: Column) -> Column:
    """Whether a turn's answer is right: a missing, blank or refused answer is wrong."""
    asserts = F.coalesce(F.length(answer) > 0, F.lit(False)) & ~F.coalesce(status == "refused", F.lit(False))
    return asserts & applicable & F.coalesce(primary, F.lit(False))


def probe_plan(turns: DataFrame) -> DataFrame:
    """(place, conversation, turn, mode, thread): every turn on its conversation's thread, then the turns that depend on history on their own.

    turns: (conversation, turn, depends_on_history).
    """
    memory = turns.select(F.lit(0).alias("part"), "conversation", "turn", F.lit("memory").alias("mode"), F.col("conversation").cast("string").alias("thread"))
    alone = turns.where("depends_on_history").select(F.lit(1).alias("part"), "conversation", "turn", F.lit("isolated").alias("mode"), F.lit(None).cast("string").alias("thread"))
    return memory.unionByName(alone)


def probe_summary(turns: DataFrame, safety: float = 1.25) -> DataFrame:
    """One row over (mode, depends_on_history, correct, http_status, status, cost_usd, latency_ms) of a probe's requests."""
    mode, depends, right = F.col("mode"), F.col("depends_on_history"), F.col("correct")
    return turns.agg(
        F.count_if((mode == "memory") & depends).alias("n_follow_up_turns"), F.count_if((mode == "memory") & ~depends).alias("n_first_turns"),
        F.count_if((mode == "memory") & depends & right).alias("correct_with_memory"), F.count_if((mode == "isolated") & depends & right).alias("correct_in_isolation"),
        F.count_if((mode == "memory") & ~depends & right).alias("first_turns_correct"), F.count("*").alias("n_requests"), F.count_if(F.col("http_status") != 200).alias("http_errors"),
        F.count_if(F.col("status") == "refused").alias("refused"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd_actual"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)) * safety, 6).alias("cost_usd_counted"), F.round(F.avg("latency_ms"), 1).alias("latency_ms_mean"),
    )


def expected_cost(n: Column, each: float = 0.0025, safety: float = 1.25) -> tuple[Column, Column]:
    """(expected, counted) US dollars of ``n`` queries."""
    return F.round(n * each, 4), F.round(n * each * safety, 4)


def rank_runs(runs: DataFrame, metric: str, within: list[str] | None = None) -> DataFrame:
    """``runs`` with their place by a metric, missing ones as 0; a leaderboard, so a handful of rows."""
    return runs.withColumn("place", F.row_number().over(W.partitionBy(*(within or [])).orderBy(F.desc(F.coalesce(F.col(metric).cast("double"), F.lit(0.0))), "run_id")).cast("long"))
