"""Queries over texts: cleaning, chunking, audit, names, labels, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import corpus as C
from siltstone.operators import serving
from siltstone.plans.catalog import query
from siltstone.session import table

TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
PROSE = "(length(trim({0})) > 20 AND contains(trim({0}), ' ') AND NOT contains(trim({0}), ':') AND NOT contains(trim({0}), '/'))"


def re2(pattern: str) -> str:
    return pattern.replace("'", "''")


STRIP = """trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query("clean_strip_html", f"SELECT page_id, {STRIP} AS text FROM pages")
def clean_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("clean_html_parser")
def clean_html_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faithful form: a tolerant parser, in Arrow batches."""
    return table(spark, sf_dir, "pages").select("page_id", C.page_text("html").alias("text"))


@query("clean_prose_lines", f"SELECT doc_id, line_no, {PROSE.format('line')} AS prose FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS line_no FROM documents)")
def clean_prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.is_prose_line(F.col("line")).alias("prose"))


@query(
    "clean_preamble",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
f AS (SELECT doc_id, lines, greatest(coalesce(list_position(list_transform(lines, lambda x: {PROSE.format('x')}), true), 0), 1) AS first FROM l)
SELECT doc_id, array_to_string(lines[first:], chr(10)) AS body FROM f""",
)
def clean_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.without_preamble(F.col("text")).alias("body"))


@query(
    "clean_whitespace",
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '(?m)^[ \\t]+', '', 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM documents",
)
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_whitespace(F.col("text")).alias("body"))


ENVELOPE = "'<DOCUMENT><TYPE>EX-99' || chr(10) || '<TEXT>exhibit ' || page_id || '</TEXT></DOCUMENT><DOCUMENT><TYPE>10-K/A' || chr(10) || '<TEXT>' || url || '</TEXT></DOCUMENT>'"


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes put together from the pages table: an exhibit, then the main document."""
    body = F.concat(F.lit("<DOCUMENT><TYPE>EX-99\n<TEXT>exhibit "), F.col("page_id").cast("string"), F.lit("</TEXT></DOCUMENT><DOCUMENT><TYPE>10-K/A\n<TEXT>"), F.col("url"), F.lit("</TEXT></DOCUMENT>"))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("submission"))


@query("envelope_documents", "SELECT page_id, 0::BIGINT AS pos, 'EX-99' AS type, 'exhibit ' || page_id AS body FROM pages UNION ALL SELECT page_id, 1, '10-K/A', url FROM pages")
def envelope_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.documents(_submissions(spark, sf_dir), "submission")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "type", "body")


@query("envelope_primary", "SELECT page_id, url AS body, 1::BIGINT AS others FROM pages")
def envelope_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.primary_document(_submissions(spark, sf_dir), "page_id", "submission")


@query("chunk_fixed", "SELECT doc_id, i AS chunk_idx, substr(text, i * 462 + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 462.0)::BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"))).alias("chunk_idx", "chunk"))
    return chunks.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(table(spark, sf_dir, "documents"), ["doc_id"], "text")


BARE = TRIM.format("coalesce(text, '')")
CLASS = f"""CASE WHEN length({BARE}) < 120 THEN 'short fragment' WHEN regexp_matches({BARE}, '{re2(T.MARKUP)}') THEN 'escaped markup' WHEN regexp_matches({BARE}, '{re2(T.JSON_LIKE)}') THEN 'json / metadata'
 WHEN len(regexp_extract_all({BARE}, '{re2(T.IDENTIFIER)}')) >= 3 OR len(list_filter(regexp_split_to_array({BARE}, '\\s+'), lambda w: length(w) > 30)) > 2 THEN 'identifiers'
 WHEN len(regexp_extract_all({BARE}, '\\p{{L}}'))::DOUBLE / length({BARE}) < 0.4 THEN 'numeric table' ELSE 'prose' END"""


@query("audit_classify", f"SELECT doc_id, {CLASS} AS class FROM documents")
def audit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.classify(F.col("text")).alias("class"))


CLASS_ROWS = "(VALUES ('prose'), ('numeric table'), ('escaped markup'), ('identifiers'), ('json / metadata'), ('short fragment')) AS v(class)"


@query("audit_overall", f"WITH c AS (SELECT {CLASS} AS class FROM documents) SELECT v.class, count(c.class) AS n, round(count(c.class)::DOUBLE / (SELECT count(*) FROM c), 4) AS share FROM {CLASS_ROWS} LEFT JOIN c ON c.class = v.class GROUP BY v.class")
def audit_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.audit(table(spark, sf_dir, "documents"), "text")


@query("audit_by_source", f"WITH c AS (SELECT source, {CLASS} AS class FROM documents) SELECT source, count(*) AS n_chunks, " + ", ".join(f"count(*) FILTER (class = '{c}') AS \"{c}\"" for c in T.CLASSES) + " FROM c GROUP BY source")
def audit_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.audit_by(table(spark, sf_dir, "documents"), "source", "text")


@query("audit_grouping_sets", f"WITH c AS (SELECT source, lang, {CLASS} AS class FROM documents) SELECT source, lang, class, count(*) AS n FROM c GROUP BY GROUPING SETS ((class), (source, class), (lang, class), (source, lang, class))")
def audit_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", T.classify(F.col("text")).alias("class"))
    s, la, c = F.col("source"), F.col("lang"), F.col("class")
    return rows.groupingSets([[c], [s, c], [la, c], [s, la, c]], s, la, c).agg(F.count("*").alias("n"))


def _company_sql(text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)\\b(?:{'|'.join((k.lower(), *v))})\\b') THEN '{k}' END" for k, v in T.COMPANIES.items()) + "], lambda x: x IS NOT NULL)"


#: Words of the conversations stand in for company names, so that names occur.
ASKED = "CASE turn % 4 WHEN 0 THEN 'How did Apple do? ' WHEN 1 THEN 'Compare google and AWS. ' WHEN 2 THEN 'metadata only ' ELSE 'META or meta? ' END || text"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("turn") % 4 == 0, "How did Apple do? ").when(F.col("turn") % 4 == 1, "Compare google and AWS. ").when(F.col("turn") % 4 == 2, "metadata only ").otherwise("META or meta? ")
    return table(spark, sf_dir, "conversations").withColumn("text", F.concat(lead, "text"))


@query("infer_ticker", f"SELECT conv_id, turn, {_company_sql('t')} AS tickers FROM (SELECT conv_id, turn, {ASKED} AS t FROM conversations)")
def infer_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", T.companies(F.col("text")).alias("tickers"))


@query("infer_single", f"SELECT conv_id, turn, CASE WHEN len(x) = 1 THEN x[1] END AS ticker FROM (SELECT conv_id, turn, {_company_sql('t')} AS x FROM (SELECT conv_id, turn, {ASKED} AS t FROM conversations))")
def infer_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", T.single_company(F.col("text")).alias("ticker"))


@query("split_references", "SELECT item_id, list_filter(list_transform(string_split_regex(f, '\\|\\||;;'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS refs FROM (SELECT item_id, text || ' || ' || text || '1 ;; ;;tail' AS f FROM benchmark)")
def split_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.concat("text", F.lit(" || "), "text", F.lit("1 ;; ;;tail"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.references(field).alias("refs"))


@query("normalize_text", "SELECT item_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS norm FROM benchmark")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize(F.col("text")).alias("norm"))


@query("chunk_ids", "SELECT doc_id, upper(source) || '_10K_chunk_' || doc_id AS chunk_id, upper(source) AS symbol, doc_id::INTEGER AS chunk_idx FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"))
    return rows.withColumn("p", T.parse_chunk_id(F.col("chunk_id"))).select("doc_id", "chunk_id", F.col("p.symbol").alias("symbol"), F.col("p.chunk_idx").alias("chunk_idx"))


@query("snippets", "SELECT doc_id, trim(replace(left(text, 500), chr(10), ' ')) AS snippet, CASE WHEN length(trim(text)) <= 80 THEN trim(text) ELSE rtrim(left(trim(text), 80)) || '…' END AS clipped FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.clip(F.col("text"), 80).alias("clipped"))


@query("list_companies", "SELECT DISTINCT source FROM documents ORDER BY source")
def list_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().orderBy("source")


@query("scan_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")))
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("newest_file", "SELECT lang, max(source) AS newest FROM documents GROUP BY lang")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last name of each group by code point, as the newest filing of a company is found."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.max_by("source", "source").alias("newest"))


@query("terminal_states", "SELECT conv_id, turn, CASE WHEN trim(coalesce(a, '')) = '' THEN 'empty_answer' WHEN contains(lower(a), 'need more steps') THEN 'recursion_limit' END AS state FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'Sorry, NEED more steps to answer' ELSE text END AS a FROM conversations)")
def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("turn") % 3 == 0, "  ").when(F.col("turn") % 3 == 1, "Sorry, NEED more steps to answer").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.terminal_state(answer, "need more steps").alias("state"))


@query(
    "request_checks",
    """SELECT conv_id, turn, list_filter([CASE WHEN length(q) < 1 OR length(q) > 2000 THEN 'question' END, CASE WHEN length(ticker) > 10 THEN 'ticker' END, CASE WHEN thread IS NOT NULL AND NOT regexp_full_match(thread, '[A-Za-z0-9_-]{8,64}') THEN 'thread_id' END], lambda x: x IS NOT NULL) AS problems
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN '' WHEN 2 THEN repeat(text || 'x', 40) ELSE text END AS q, CASE conv_id % 3 WHEN 0 THEN left(text, 12) WHEN 1 THEN role END AS ticker, CASE turn % 3 WHEN 0 THEN 'thread_' || conv_id WHEN 1 THEN left(text, 20) END AS thread FROM conversations)""",
)
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with requests: questions that are empty or too long, tickers that are none, thread ids that aren't opaque keys."""
    n, turn = F.col("conv_id"), F.col("turn")
    question = F.when(turn % 4 == 3, "").when(turn % 4 == 2, F.repeat(F.concat("text", F.lit("x")), F.lit(40))).otherwise(F.col("text"))
    ticker = F.when(n % 3 == 0, F.left("text", F.lit(12))).when(n % 3 == 1, F.col("role"))
    thread = F.when(turn % 3 == 0, F.concat(F.lit("thread_"), n.cast("string"))).when(turn % 3 == 1, F.left("text", F.lit(20)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", serving.request_problems(question, ticker, thread).alias("problems"))


@query("quarantine", "SELECT count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM (SELECT length(text) >= 120 AS ok FROM documents)")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a step can't take go to a table of their own; the run goes on."""
    return table(spark, sf_dir, "documents").select((F.length("text") >= 120).alias("ok")).agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
