"""Observations and claims: parsing what tools showed, and checking that a record's figures are in what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import figures as G
from siltstone.functions import messages as S
from siltstone.functions import text as T

#: Lines that structure an observation, fixed patterns.
SECTION = r"^===\s*(\S+)\s*==="
CHUNK = r"^\s*\[\d+\]\s*(?:ticker=(\S+)\s+)?chunk_idx=(\S+)"
FACT = r"^\s*\[\d+\]\s*ticker=(\S+)\s+fact_id=(\S+)"
CALC = r"^\s*\[\d+\]\s*calc=(\S+)"
FALLBACK = r"ticker=(\S+)\s+chunk_idx=(\S+)"


def has_markers(text: Column) -> Column:
    return text.rlike(FALLBACK) | text.rlike("(?m)" + CHUNK)


def parse(observations: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, kind, ticker, ref, id, snippet): passages, facts and results of each observation, in order.

    A section names the company for what follows; a header opens an entry that the lines up to a blank one or the next header
    fill; entries without text are left out.
    """
    lines = observations.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    line = F.col("line")
    kind = F.when(line.rlike(SECTION), "section").when(line.rlike(CHUNK), "chunk").when(line.rlike(FACT), "fact").when(line.rlike(CALC), "calc").when(F.trim(line) == "", "blank")
    lines = lines.withColumn("kind", kind)
    order = W.partitionBy(*keys).orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    section = F.last(F.when(F.col("kind") == "section", F.upper(F.regexp_extract(line, SECTION, 1))), ignorenulls=True).over(so_far)
    lines = lines.withColumn("section", section).withColumn("block", F.sum(F.col("kind").isNotNull().cast("int")).over(so_far))
    opened = F.col("kind").isin("chunk", "fact", "calc")
    own = F.when(F.col("kind") == "chunk", F.regexp_extract(line, CHUNK, 1)).when(F.col("kind") == "fact", F.regexp_extract(line, FACT, 1)).otherwise("")
    ref = F.when(F.col("kind") == "chunk", F.regexp_extract(line, CHUNK, 2)).when(F.col("kind") == "fact", F.regexp_extract(line, FACT, 2)).otherwise(F.regexp_extract(line, CALC, 1))
    head = F.struct("line_no", "kind", F.upper(F.coalesce(F.nullif(own, F.lit("")), "section", F.lit("UNKNOWN"))).alias("ticker"), F.regexp_replace(ref, ",+$", "").alias("ref"))
    body = F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), F.struct("line_no", F.trim(line).alias("t")))))
    blocks = lines.groupBy(*keys, "block").agg(F.max(F.when(opened, head)).alias("h"), F.trim(F.array_join(F.transform(body, lambda x: x["t"]), " ")).alias("snippet"))
    blocks = blocks.where("h is not null and snippet <> ''")
    ticker = F.when(F.col("h.kind") == "calc", "").otherwise(F.col("h.ticker"))
    ident = (
        F.when(F.col("h.kind") == "fact", F.concat(ticker, F.lit("_10K_fact_"), "h.ref")).when(F.col("h.kind") == "calc", F.concat(F.lit("calc_"), "h.ref")).otherwise(F.concat(ticker, F.lit("_10K_chunk_"), "h.ref"))
    )
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("h.line_no")).cast("long")
    return blocks.select(*keys, pos.alias("pos"), F.col("h.kind").alias("kind"), ticker.alias("ticker"), F.col("h.ref").alias("ref"), ident.alias("id"), "snippet")


def first_seen(parsed: DataFrame, run: str, order: list[str]) -> DataFrame:
    """(run, ids): passage ids by first appearance; facts and results are no passages."""
    seen = parsed.where("kind = 'chunk'").groupBy(run, "id").agg(F.min(F.struct(*order)).alias("at"))
    return seen.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))


def by_id(parsed: DataFrame, run: str, order: list[str]) -> DataFrame:
    """(run, id, text): texts with one id joined by newlines, in order."""
    texts = F.array_sort(F.collect_list(F.struct(*order, "snippet")))
    return parsed.groupBy(run, "id").agg(F.array_join(F.transform(texts, lambda x: x["snippet"]), "\n").alias("text"))


def contexts(parsed: DataFrame, run: str, order: list[str]) -> DataFrame:
    """(run, contexts): each passage, fact and result with where it comes from, in the order seen."""
    label = F.when(F.col("kind") == "chunk", F.concat(F.lit("chunk "), "ref")).when(F.col("kind") == "fact", F.concat(F.lit("fact "), "ref")).otherwise(F.col("id"))
    shown = parsed.select(run, *order, S.context(F.col("ticker"), label, F.col("kind"), F.col("snippet")).alias("c"))
    return shown.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "c"))), lambda x: x["c"]).alias("contexts"))


def sources(observations: DataFrame, parsed: DataFrame, run: str, order: list[str], text: str) -> DataFrame:
    """(run, pos, ticker, id, snippet): what an answer may cite, once each, in the order seen; results of calculations are no sources.

    A run of which nothing could be parsed falls back on the bare marks in its texts, without snippets.
    """
    first = W.partitionBy(run, "ticker", "id").orderBy(*order)
    own = parsed.where("kind <> 'calc'").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    marks = F.regexp_extract_all(text, F.lit(FALLBACK), F.lit(1)), F.regexp_extract_all(text, F.lit(FALLBACK), F.lit(2))
    bare = observations.join(own.select(run).distinct(), run, "left_anti")
    found = bare.select(run, *[c for c in order if c in bare.columns], F.posexplode(F.arrays_zip(marks[0].alias("t"), marks[1].alias("i"))).alias("_at", "m"))
    ref = F.regexp_replace(F.col("m.i"), ",+$", "")
    place = [*[c for c in order if c in bare.columns], "_at"]
    found = found.select(run, F.struct(*place).cast("string").alias("_p"), *place, F.upper("m.t").alias("ticker"), F.concat(F.upper("m.t"), F.lit("_10K_chunk_"), ref).alias("id"))
    found = found.withColumn("_n", F.row_number().over(W.partitionBy(run, "ticker", "id").orderBy(*place))).where("_n = 1")
    numbered = lambda df, by: df.withColumn("pos", F.row_number().over(W.partitionBy(run).orderBy(*by)).cast("long"))
    return numbered(own, order).select(run, "pos", "ticker", "id", "snippet").unionByName(numbered(found, place).select(run, "pos", "ticker", "id", F.lit("").alias("snippet")))


def check_claims(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(run, n_claims, n_figures, n_supported, failures, cited, status) of each record.

    records: (run, draft, claims array<struct<text, sources>>, parsed boolean); sources: (run, id, text). Failures are structs (check, detail):
    no_contract, empty_record, unknown_source, uncited_figure, unsupported_figure, dropped_figure. An id may come with several texts, and a run have any number of sources.
    """
    own = sources.groupBy("run", "id").agg(F.flatten(F.collect_list(G.extract(F.col("text")))).alias("f"))  # a source that is observed again says more
    claims = records.select("run", F.posexplode("claims").alias("pos", "c")).select("run", "pos", F.col("c.text").alias("text"), F.coalesce("c.sources", F.array().cast("array<string>")).alias("cites"))
    claims = claims.withColumn("figures", G.extract(F.col("text")))
    cites = claims.select("run", "pos", F.posexplode("cites").alias("at", "id")).join(own, ["run", "id"], "left")
    cites = cites.groupBy("run", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "id", F.col("f").isNotNull().alias("known"), F.coalesce("f", F.array().cast(G.TYPE)).alias("f")))).alias("seen"))
    claims = claims.join(cites, ["run", "pos"], "left").withColumn("seen", F.coalesce("seen", F.array().cast(cites.schema["seen"].dataType)))
    claims = claims.withColumn("own", G.content(F.col("figures")))
    fails = lambda check, items: F.transform(items, lambda d: F.struct(F.lit(check).alias("check"), d.alias("detail")))
    raws = lambda fs: F.transform(fs, lambda f: f["raw"])
    ids = lambda seen: F.transform(seen, lambda s: s["id"])
    unknown = ids(F.filter("seen", lambda s: ~s["known"]))
    claims = claims.withColumn("evidence", F.flatten(F.transform("seen", lambda s: s["f"]))).withColumn("cited", ids(F.filter("seen", lambda s: s["known"])))
    lost = F.filter("own", lambda f: ~G.supported(f, F.col("evidence")))
    none = F.array().cast("array<struct<check:string,detail:string>>")
    bare = F.size("cites") == 0
    claims = claims.withColumn("n_supported", F.when(bare, 0).otherwise(F.size("own") - F.size(lost)))
    claims = claims.withColumn("failures", F.concat(fails("unknown_source", unknown), F.when(bare, fails("uncited_figure", raws(F.col("own")))).otherwise(fails("unsupported_figure", raws(lost)))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "failures", "cited", "figures")))
    summed = claims.groupBy("run").agg(F.sum(F.size("own")).alias("n_figures"), F.sum("n_supported").alias("n_supported"), ordered.alias("o"))
    rows = records.join(summed, "run", "left").withColumn("drafted", G.content(G.extract(F.col("draft"))))
    said = F.coalesce(F.flatten(F.transform("o", lambda x: x["figures"])), F.array().cast(G.TYPE))
    dropped = F.filter("drafted", lambda f: ~F.exists(said, lambda g: G.matches(f, g) | G.matches(g, f)))
    count = F.size("claims")
    blank = F.when((count == 0) & (F.trim("draft") != ""), F.array(F.struct(F.lit("empty_record").alias("check"), F.lit("no sentences").alias("detail")))).otherwise(none)
    unread = F.array(F.struct(F.lit("no_contract").alias("check"), F.lit("the record could not be parsed").alias("detail")))
    found = F.concat(blank, F.coalesce(F.flatten(F.transform("o", lambda x: x["failures"])), none), fails("dropped_figure", raws(dropped)))
    rows = rows.withColumn("failures", F.when(F.col("parsed"), found).otherwise(unread))
    cited = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("o", lambda x: x["cited"])))), F.array().cast("array<string>"))
    return rows.select(
        "run", count.alias("n_claims"), F.coalesce("n_figures", F.lit(0)).alias("n_figures"), F.coalesce("n_supported", F.lit(0)).alias("n_supported"), "failures", cited.alias("cited"),
        F.when(F.size("failures") == 0, "verified").otherwise("unverified").alias("status"),
    )


def served(status: Column, mode: Column) -> Column:
    """The verdict by mode: off skips, strict refuses what isn't verified."""
    return F.when(mode == "off", "skipped").when((status != "verified") & (mode == "strict"), "refused").otherwise(status)


def described(failure: Column, claim: Column) -> Column:
    """A failure (struct check, detail) of a claim in words, as a second attempt is told it; a long claim is shown by its beginning."""
    where = F.when(F.coalesce(claim, F.lit("")) != "", F.concat(F.lit(' in "'), F.left(claim, F.lit(120)), F.lit('"'))).otherwise("")
    detail, check = failure["detail"], failure["check"]
    return (
        F.when(check == "unsupported_figure", F.concat(detail, where, F.lit(" stands in nothing that the sentence cites")))
        .when(check == "uncited_figure", F.concat(detail, where, F.lit(" cites nothing")))
        .when(check == "unknown_source", F.concat(detail, F.lit(" is cited"), where, F.lit(" but wasn't observed in this turn")))
        .when(check == "dropped_figure", F.concat(detail, F.lit(" is in the draft and in no sentence of the record")))
        .when(check == "empty_record", F.lit("the record has no sentences, but the draft isn't empty"))
        .when(check == "no_contract", F.concat(F.lit("no record that can be used: "), detail))
        .otherwise(F.concat(check, F.lit(": "), detail))
    )


def refusal(failures: Column, shown: int = 4) -> Column:
    """Reasons of a refusal, the first few and how many more."""
    reasons = F.transform(F.slice(failures, 1, shown), lambda f: F.concat(f["check"], F.lit(": "), f["detail"]))
    return F.concat(F.array_join(reasons, "; "), F.when(F.size(failures) > shown, F.concat(F.lit("; and "), (F.size(failures) - shown).cast("string"), F.lit(" more"))).otherwise(""))


def upgraded(records: DataFrame, run: str, marker: str) -> DataFrame:
    """Records of any age in the present shape, nothing generated again; ``run`` tells them apart.

    records: (run, answer, contexts, and as far as they have them observations and terminal_failure). Old ones kept what tools showed under contexts; from it come
    observations, contexts (one for each passage, fact and result), retrieved (ids of passages by first appearance), n_observations and n_contexts. An answer that
    ended early is told by its text where nothing is noted.
    """
    empty = F.array().cast("array<string>")
    held = {c: F.col(c) if c in records.columns else F.lit(None).cast(t) for c, t in (("observations", "array<string>"), ("terminal_failure", "string"))}
    ended = F.coalesce(held["terminal_failure"], T.terminal_state(F.col("answer"), marker))
    rows = records.withColumns({"observations": F.coalesce(held["observations"], F.col("contexts"), empty), "terminal_failure": ended, "recursion_limit_hit": F.coalesce(ended == "recursion_limit", F.lit(False))})
    parsed = parse(rows.select(run, F.posexplode("observations").alias("obs", "text")), [run, "obs"], "text")
    shown = contexts(parsed, run, ["obs", "pos"]).join(first_seen(parsed, run, ["obs", "pos"]), run, "left")
    rows = rows.drop("contexts", "retrieved", "n_contexts").join(shown.withColumnRenamed("ids", "retrieved"), run, "left")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in ("contexts", "retrieved")})
    return rows.withColumns({f"n_{c}": F.size(c).cast("long") for c in ("observations", "contexts")})
