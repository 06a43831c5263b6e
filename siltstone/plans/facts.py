"""Queries over facts. Line items stand in for tagged facts: a concept per return flag, dimensions from the line status,
a fiscal year from the ship date, the extended price as value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import numbers as N
from siltstone.operators import facts as X
from siltstone.operators import xbrl
from siltstone.plans.catalog import query
from siltstone.session import place_of, table
from siltstone.sources import files
from siltstone.sources.versions import Versions

NAMES = {"A": "us-gaap:Revenues", "N": "us-gaap:NetIncomeLoss", "R": "us-gaap:OperatingIncomeLoss"}
FACTS = """facts AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'T' || (l_suppkey % 5) AS ticker,
  CASE l_returnflag WHEN 'A' THEN 'us-gaap:Revenues' WHEN 'N' THEN 'us-gaap:NetIncomeLoss' ELSE 'us-gaap:OperatingIncomeLoss' END AS concept, l_extendedprice AS value,
  CASE WHEN l_linenumber % 2 = 0 THEN 'instant' ELSE 'duration' END AS period_type, CASE WHEN l_linenumber % 2 = 1 THEN 200 + 40 * l_linenumber END::INTEGER AS days, year(l_shipdate)::INTEGER AS fiscal_year,
  CASE WHEN l_quantity < 10 THEN '' ELSE 'srt:ProductOrServiceAxis=us-gaap:' || CASE l_linestatus WHEN 'O' THEN 'ServiceMember' ELSE 'ProductMember' END END AS dims, CASE WHEN l_quantity < 10 THEN 0 ELSE 1 END::INTEGER AS dim_count FROM lineitem),
filings AS (SELECT ticker, max(fiscal_year) AS fiscal_year_focus FROM facts GROUP BY ticker)"""


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored facts and filings: written at their first use, read from then on."""
    path = place_of(spark, sf_dir, "lineitem", "facts")
    if not Versions(spark, path).last():
        made = _derived(spark, sf_dir)
        files.write_facts(made, made.groupBy("ticker").agg(F.max("fiscal_year").alias("fiscal_year_focus")), path)
    return files.read_facts(spark, path)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, in ranges of company and concept."""
    return _stored(spark, sf_dir)[0]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[1]


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    odd, small = F.col("l_linenumber") % 2 == 1, F.col("l_quantity") < 10
    member = F.when(F.col("l_linestatus") == "O", "ServiceMember").otherwise("ProductMember")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string")).alias("ticker"),
        F.coalesce(*[F.when(F.col("l_returnflag") == k, v) for k, v in NAMES.items()]).alias("concept"), F.col("l_extendedprice").alias("value"),
        F.when(odd, "duration").otherwise("instant").alias("period_type"), F.when(odd, 200 + 40 * F.col("l_linenumber")).cast("int").alias("days"), F.year("l_shipdate").alias("fiscal_year"),
        F.when(small, "").otherwise(F.concat(F.lit("srt:ProductOrServiceAxis=us-gaap:"), member)).alias("dims"), F.when(small, 0).otherwise(1).alias("dim_count"),
    )


#: (request_id, ticker, concept, fiscal_year, segment)
REQUESTS = [
    (1, "t0", "Net sales", None, None), (2, "T1", "net income", 1997, None), (3, "T2", "operating profit", 1996, "services"), (4, "T3", "us-gaap:revenues", 1998, None),
    (5, "T4", "no such thing", None, None), (6, "T0", "income loss", 1995, None), (7, "T1", "us-gaap:Missing", None, None), (8, "T2", "revenue", 1999, "product"),
]


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, "request_id long, ticker string, concept string, fiscal_year int, segment string")


@query("fact_tickers", f"WITH {FACTS} SELECT ticker, fiscal_year_focus FROM filings ORDER BY ticker")
def fact_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).orderBy("ticker")


@query("fact_concepts", f"WITH {FACTS} SELECT DISTINCT ticker, concept FROM facts")
def fact_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("ticker", "concept").distinct()


@query("fact_latest_year", f"WITH {FACTS} SELECT ticker, fiscal_year_focus FROM filings")
def fact_latest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir)


@query("years_available", f"WITH {FACTS} SELECT ticker, concept, list(DISTINCT fiscal_year ORDER BY fiscal_year) AS years FROM facts GROUP BY ALL")
def years_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("ticker", "concept").agg(F.array_sort(F.collect_set("fiscal_year")).alias("years"))


@query("fact_get", f"WITH {FACTS} SELECT id, concept, value FROM facts WHERE id = 11")
def fact_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where("id = 11").select("id", "concept", "value")


def _lookup_sql(extra: str, segment: str, dims: str) -> str:
    return f"""WITH {FACTS}, m AS (SELECT f.*, row_number() OVER (PARTITION BY ticker, concept ORDER BY dim_count, days DESC NULLS LAST, abs(value) DESC, id) AS rank
  FROM facts f JOIN filings g USING (ticker) WHERE f.fiscal_year = g.fiscal_year_focus AND (period_type = 'instant' OR days > 300) AND {dims} {extra})
SELECT ticker, concept, rank, id, value FROM m WHERE rank <= 12"""


def _each(spark: SparkSession, sf_dir: str, segment: str | None) -> DataFrame:
    """A request for every company and concept, in the filing's year."""
    f, g = facts(spark, sf_dir), filings(spark, sf_dir)
    resolved = f.select("ticker", "concept").distinct().withColumn("request_id", F.concat_ws("|", "ticker", "concept"))
    asked = resolved.select("request_id", "ticker", F.lit(None).cast("int").alias("fiscal_year"), F.lit(segment).cast("string").alias("segment"))
    return X.lookup(asked, resolved, f, g)


@query("fact_lookup", _lookup_sql("", "", "dim_count = 0"))
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, None).where("not fallback").select("ticker", "concept", "rank", "id", "value")


@query("fact_segment", _lookup_sql("", "", "dims LIKE '%:ServiceMember'"))
def fact_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, "services").select("ticker", "concept", "rank", "id", "value")


@query(
    "fact_fallback",
    f"""WITH {FACTS}, s AS (SELECT * FROM facts WHERE dim_count = 1), m AS (SELECT f.*, row_number() OVER (PARTITION BY ticker, concept ORDER BY abs(value) DESC, id) AS rank
  FROM s f JOIN (SELECT ticker, max(fiscal_year) AS y FROM s GROUP BY ticker) g USING (ticker) WHERE f.fiscal_year = y AND (period_type = 'instant' OR days > 300))
SELECT ticker, concept, rank, id, value, true AS fallback FROM m WHERE rank <= 12""",
)
def fact_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing consolidated: values of one dimension instead."""
    f = facts(spark, sf_dir).where("dim_count = 1")
    resolved = f.select("ticker", "concept").distinct().withColumn("request_id", F.concat_ws("|", "ticker", "concept"))
    asked = resolved.select("request_id", "ticker", F.lit(None).cast("int").alias("fiscal_year"), F.lit(None).cast("string").alias("segment"))
    found = X.lookup(asked, resolved, f, f.groupBy("ticker").agg(F.max("fiscal_year").alias("fiscal_year_focus")))
    return found.select("ticker", "concept", "rank", "id", "value", "fallback")


#: What the requests resolve to: (request_id, ticker, how, concept, pos, fiscal_year, segment token).
RESOLVED = [
    (1, "T0", "synonym", "Revenues", 1, None, None), (2, "T1", "synonym", "NetIncomeLoss", 1, 1997, None), (3, "T2", "synonym", "OperatingIncomeLoss", 1, 1996, "service"), (4, "T3", "exact", "Revenues", 1, 1998, None),
    (6, "T0", "search", "NetIncomeLoss", 1, 1995, None), (6, "T0", "search", "OperatingIncomeLoss", 2, 1995, None), (8, "T2", "synonym", "Revenues", 1, 1999, "product"),
]
_sql = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _resolved_sql(rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(_sql(f"us-gaap:{x}" if i == 3 else x) for i, x in enumerate(r)) + ")" for r in rows)
    return f"rs(request_id, ticker, how, concept, pos, fy, tok) AS (SELECT request_id::BIGINT, ticker, how, concept, pos::BIGINT, fy::INTEGER, tok::VARCHAR FROM (VALUES {values}) v(request_id, ticker, how, concept, pos, fy, tok))"


def _requests_sql(rows: list[tuple]) -> str:
    return f"""WITH {FACTS}, {_resolved_sql(rows)}, mm AS (SELECT rs.request_id, rs.tok, f.*, CASE WHEN tok IS NULL THEN dim_count = 0 ELSE contains(lower(regexp_extract(dims, ':([^:]*)$', 1)), tok) END AS main
  FROM rs JOIN filings USING (ticker) JOIN facts f ON f.ticker = rs.ticker AND f.concept = rs.concept AND f.fiscal_year = coalesce(fy, fiscal_year_focus) WHERE period_type = 'instant' OR days > 300),
kk AS (SELECT *, NOT bool_or(main) OVER (PARTITION BY request_id) AS fallback FROM mm WHERE main OR (tok IS NULL AND dim_count = 1)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN NOT fallback THEN dim_count END, CASE WHEN NOT fallback THEN days END DESC NULLS LAST, abs(value) DESC, id) AS rank FROM kk WHERE main OR fallback) WHERE rank <= 12)"""


@query("concept_resolve", f"WITH {_resolved_sql(RESOLVED)} SELECT request_id, how, concept, pos FROM rs")
def concept_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.resolve(requests(spark), facts(spark, sf_dir))


@query("fact_requests", _requests_sql(RESOLVED) + " SELECT request_id, rank, fallback, concept, id, value FROM found")
def fact_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-language requests from resolving to facts."""
    asked, f = requests(spark), facts(spark, sf_dir)
    return X.lookup(asked, X.resolve(asked, f), f, filings(spark, sf_dir)).select("request_id", "rank", "fallback", "concept", "id", "value")


BLOCK = """'[' || rank || '] ticker=' || ticker || '  fact_id=' || id || chr(10) || '    ' || concept || ' | ' || CASE WHEN period_type = 'instant' THEN 'as of ' || fiscal_year || '-12-31' ELSE 'FY' || fiscal_year || ' (' || fiscal_year || '-01-01 to ' || fiscal_year || '-12-31)' END
  || ' | $' || format('{:,}', round_even(value, 0)::BIGINT) || ' | ' || CASE WHEN dims = '' THEN 'consolidated' ELSE 'ProductOrService=' || replace(regexp_extract(dims, ':([^:]*)$', 1), 'Member', '') END"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.col("fiscal_year").cast("string")
    return facts(spark, sf_dir).withColumns({"unit": F.lit("USD"), "period_start": F.concat(year, F.lit("-01-01")), "period_end": F.concat(year, F.lit("-12-31"))})


@query("fact_observation", _requests_sql(RESOLVED) + f" SELECT request_id, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY rank) AS text FROM found GROUP BY request_id")
def fact_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, f = requests(spark), _dated(spark, sf_dir)
    return X.observations(X.lookup(asked, X.resolve(asked, f), f, filings(spark, sf_dir)))


#: Requests in plain words, their segment inside the phrase: (request_id, ticker, concept, fiscal_year, segment).
ASKED = [
    (1, "t0", "services revenue", None, None), (2, "T1", "net sales", 1996, None), (3, "T2", "no such thing", None, None), (4, "T3", "AWS", 1997, None),
    (5, "T4", "operating income", None, "product"), (6, "T2", "revenue", 1850, None), (7, "T1", "income loss", 1994, None),
]
ASKED_RESOLVED = [
    (1, "T0", "synonym", "Revenues", 1, None, "service"), (2, "T1", "synonym", "Revenues", 1, 1996, None), (4, "T3", "synonym", "Revenues", 1, 1997, "amazonwebservices"), (5, "T4", "synonym", "OperatingIncomeLoss", 1, None, "product"),
    (6, "T2", "synonym", "Revenues", 1, 1850, None), (7, "T1", "search", "NetIncomeLoss", 1, 1994, None), (7, "T1", "search", "OperatingIncomeLoss", 2, 1994, None),
]


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "request_id long, ticker string, concept string, fiscal_year int, segment string")


@query("fact_phrase_lookup", _requests_sql(ASKED_RESOLVED) + " SELECT request_id, rank, fallback, concept, id, value FROM found")
def fact_phrase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lookup_phrase(_asked(spark), facts(spark, sf_dir), filings(spark, sf_dir))[0].select("request_id", "rank", "fallback", "concept", "id", "value")


ASKED_INFO = f"""{_requests_sql(ASKED_RESOLVED)}, aq(request_id, ticker, fy, segment) AS (SELECT request_id::BIGINT, ticker, fy::INTEGER, segment::VARCHAR FROM (VALUES (1, 'T0', NULL, 'services'), (2, 'T1', 1996, NULL), (3, 'T2', NULL, NULL), (4, 'T3', 1997, 'aws'), (5, 'T4', NULL, 'product'), (6, 'T2', 1850, NULL), (7, 'T1', 1994, NULL)) v(request_id, ticker, fy, segment)),
yy AS (SELECT request_id, list_sort(list(DISTINCT fiscal_year)) AS years FROM rs JOIN facts USING (ticker, concept) GROUP BY request_id), nn AS (SELECT request_id, count(*) AS n, bool_or(fallback) AS fb FROM found GROUP BY request_id),
cc AS (SELECT request_id, any_value(how) AS how, list(concept ORDER BY pos) AS concepts FROM rs GROUP BY request_id)
SELECT request_id, aq.ticker, coalesce(how, 'none') AS resolved_by, coalesce(concepts, []) AS concepts, CASE WHEN how IS NULL THEN fy ELSE coalesce(fy, fiscal_year_focus) END AS fiscal_year, how IS NOT NULL AND fy IS NULL AS fiscal_year_defaulted, segment, coalesce(years, []) AS years_available, coalesce(n, 0) AS n_rows,
 CASE WHEN fb THEN 'no consolidated value; segment values returned' END AS note FROM aq LEFT JOIN filings USING (ticker) LEFT JOIN cc USING (request_id) LEFT JOIN yy USING (request_id) LEFT JOIN nn USING (request_id)"""


@query("fact_phrase_info", ASKED_INFO)
def fact_phrase_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a phrase was resolved, the year that was used, and the years that there are."""
    return X.lookup_phrase(_asked(spark), facts(spark, sf_dir), filings(spark, sf_dir))[1]


UNITS = "CASE l_linenumber % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'USDPerShares' WHEN 2 THEN 'shares' WHEN 3 THEN 'pure' WHEN 4 THEN 'kg' ELSE 'USD' END"
VALUE = "CASE l_linenumber % 6 WHEN 0 THEN round(l_extendedprice) WHEN 1 THEN round(l_discount * 1000) / 100 WHEN 2 THEN round(l_extendedprice) WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN l_discount / 8192 ELSE l_extendedprice * 0.7310585 END WHEN 4 THEN l_extendedprice * 0.9173331 / (1 + l_suppkey % 3 * 977) ELSE -round(l_extendedprice) * 1e4 END"
SHOWN = """CASE l_linenumber % 6 WHEN 0 THEN '$' || format('{:,}', v::BIGINT) WHEN 1 THEN '$' || format('{:.2f}', v) || ' per share' WHEN 2 THEN format('{:,}', v::BIGINT) || ' shares'
 WHEN 3 THEN format('{:g}', v) || CASE WHEN abs(v) > 1.5 THEN '' ELSE ' (' || format('{:.1f}', v * 100) || '%)' END WHEN 4 THEN CASE WHEN v >= 1000 AND v < 9999.5 THEN format('{:,}', round(v)::BIGINT) ELSE format('{:.4g}', v) END || ' kg'
 ELSE '-$' || CASE WHEN v::BIGINT % 1000000 = 0 THEN format('{:,}', (-v / 1e6)::BIGINT) ELSE format('{:,}', floor(round(-v / 1e5) / 10)::BIGINT) || '.' || (round(-v / 1e5)::BIGINT % 10) END || ' million' END"""


@query("formatted_values", f"SELECT l_orderkey, l_linenumber, {SHOWN} AS shown FROM (SELECT *, {VALUE} AS v FROM lineitem WHERE l_linenumber % 6 <> 5 OR abs(round(l_extendedprice) * 1e4) >= 1e6)")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as values of six kinds of units."""
    rows = table(spark, sf_dir, "lineitem").withColumn("u", F.expr(UNITS)).withColumn("v", F.expr(VALUE)).where("l_linenumber % 6 <> 5 or abs(v) >= 1e6")
    return rows.select("l_orderkey", "l_linenumber", X.formatted_value(F.col("v"), F.col("u")).alias("shown"))


@query("camel_words", f"WITH {FACTS} SELECT DISTINCT concept, lower(regexp_replace(regexp_replace(concept, '^[^:]*:', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS words FROM facts")
def camel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("concept").distinct().select("concept", X.concept_words(F.col("concept")).alias("words"))


SPLIT = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || ' revenue' WHEN 1 THEN 'revenue' WHEN 2 THEN c_mktsegment || ' sales' ELSE 'net sales in ' || lower(c_mktsegment) END AS concept,
 CASE c_custkey % 4 WHEN 0 THEN 'google cloud' WHEN 1 THEN 'aws' WHEN 3 THEN 'iphone' END AS segment FROM customer"""


@query("split_segment", SPLIT)
def split_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases about market segments, some of which name a business segment."""
    kind, name = F.col("c_custkey") % 4, F.col("c_mktsegment")
    phrase = F.when(kind == 0, F.concat(F.lit("Google Cloud "), name, F.lit(" revenue"))).when(kind == 1, "AWS").when(kind == 2, F.concat(name, F.lit(" sales"))).otherwise(F.concat(F.lit("iPhone net sales in "), name))
    rows = table(spark, sf_dir, "customer").select("c_custkey", phrase.alias("phrase"))
    concept, segment = X.split_segment(F.col("phrase"))
    return rows.select("c_custkey", concept.alias("concept"), segment.alias("segment"))


TOTALS = "t AS (SELECT year(o_orderdate)::INTEGER AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1), p AS (SELECT a.year, a.total AS a, b.total AS b FROM t a JOIN t b ON b.year = a.year - 1)"
FORMULAS = {
    "difference": "a - b", "sum": "a + b", "ratio": "a / b", "pct_change": "(a - b) / b * 100", "margin_pct": "a / b * 100", "cagr_pct": "(pow(a / b, 1.0::DOUBLE / 2) - 1) * 100",
}


def _compute(op: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Year on year, over totals of orders."""
        totals = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
        pairs = totals.withColumnRenamed("total", "a").join(totals.select((F.col("year") + 1).alias("year"), F.col("total").alias("b")), "year")
        got = pairs.select("year", N.compute(F.lit(op), F.col("a"), F.col("b"), F.lit(2)).alias("c"))
        return got.select("year", F.round("c.result", 6).alias("result"), F.col("c.error").alias("error"))

    return run


for _op, _formula in FORMULAS.items():
    query(f"compute_metric_{_op}", f"WITH {TOTALS} SELECT year, round({_formula}, 6) AS result, NULL::VARCHAR AS error FROM p")(_compute(_op))

@query(
    "compute_errors",
    """WITH c AS (SELECT o_orderkey, o_orderkey % 6 AS kind, round(o_totalprice)::DOUBLE AS a, (o_custkey % 3 - 1)::DOUBLE AS b, (o_orderkey % 5)::INTEGER AS n FROM orders),
e AS (SELECT *, CASE kind WHEN 3 THEN 'unknown operation' WHEN 1 THEN CASE WHEN n <= 0 THEN 'n must be positive' WHEN b <= 0 THEN 'a and b must have the same sign' END WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE CASE WHEN b = 0 THEN 'division by zero' END END AS error FROM c)
SELECT o_orderkey, round(CASE WHEN error IS NULL THEN CASE kind WHEN 0 THEN a / b WHEN 1 THEN (pow(a / b, 1.0 / n) - 1) * 100 WHEN 2 THEN (a - b) / b * 100 WHEN 4 THEN a + b WHEN 5 THEN a - b END END, 6) AS result, error FROM e""",
)
def compute_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on orders, by names as people write them, with nothing to divide by, opposite signs, no years and names that there aren't."""
    names = F.array(*map(F.lit, ["ratio", "cagr_pct", "pct_change", "power", "SUM ", " Difference"]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("op"), F.round("o_totalprice").alias("a"), (F.col("o_custkey") % 3 - 1).cast("double").alias("b"), (F.col("o_orderkey") % 5).cast("int").alias("n"))
    return rows.withColumn("c", N.compute(F.col("op"), F.col("a"), F.col("b"), F.col("n"))).select("o_orderkey", F.round("c.result", 6).alias("result"), F.col("c.error").alias("error"))


@query(
    "parse_number",
    """SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN v * s WHEN 1 THEN -v * s WHEN 2 THEN -v * s WHEN 3 THEN 0.0 WHEN 4 THEN NULL WHEN 5 THEN (v + 0.5) * s WHEN 6 THEN NULL WHEN 7 THEN v * s WHEN 8 THEN 0.0 END AS value
FROM (SELECT *, floor(l_extendedprice) AS v, pow(10.0::DOUBLE, l_suppkey % 4) AS s FROM lineitem)""",
)
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of line items as filings write them: thousands, parentheses, signs, dashes, comma decimals, hard spaces, zero formats, and no numbers at all."""
    kind, v = (F.col("l_orderkey") + F.col("l_linenumber")) % 9, F.floor("l_extendedprice").cast("long")
    shown = F.format_number(v, 0)
    text = F.when(kind == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(kind.isin(3, 8), "-").when(kind == 4, "—").when(kind == 5, F.concat(F.replace(shown, F.lit(","), F.lit(".")), F.lit(",5"))).when(kind == 6, F.concat(shown, F.lit(" or so"))).when(kind == 7, F.concat(F.lit(" "), F.replace(shown, F.lit(","), F.lit(" ")))).otherwise(shown)
    form = F.when(kind == 3, "ixt:fixed-zero").when(kind == 5, "ixt:num-comma-decimal").when(kind == 8, "ixt:numzerodash")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", N.parse_number(text, form, (F.col("l_suppkey") % 4).cast("int"), F.when(kind == 2, "-")).alias("value"))


@query("days_between", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INTEGER AS days, NULL::INTEGER AS bad FROM orders")
def days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.days_between(F.lit("1995-01-01"), end).alias("days"), N.days_between(F.lit("not a date"), end).alias("bad"))


@query("price_cost", "SELECT event_id, CASE event_type WHEN 'click' THEN round(((user_id * 0.25 + event_id * 1.5) / 1000000)::DECIMAL(38, 12), 6)::DOUBLE WHEN 'view' THEN round(((user_id * 1.5 + event_id * 9.0) / 1000000)::DECIMAL(38, 12), 6)::DOUBLE END AS cost FROM events")
def price_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("event_type") == "click", "google/gemini-3.1-flash-lite-001").when(F.col("event_type") == "view", "gemini-3.5-flash").otherwise("another-model")
    return table(spark, sf_dir, "events").select("event_id", N.cost_usd(model, F.col("user_id"), F.col("event_id")).alias("cost"))


#: Filings put together from orders: every customer's orders are filings of one company, each with the same context and unit ids, one
#: number that all of them have, one that is given twice, one of a context that isn't there, and one whose scale is no number in every
#: fiftieth. The contexts stand in a second document.
FILED = "filed AS (SELECT 'F' || o_orderkey AS filing, 'T' || o_custkey AS ticker, o_orderkey, 2000 + o_orderkey % 20 AS year FROM orders)"


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, year = F.col("o_orderkey").cast("string"), (2000 + F.col("o_orderkey") % 20).cast("string")
    number = lambda name, at, text: F.concat(F.lit(f'<ix:nonFraction name="{name}" contextRef="c1" unitRef="u" '), at, F.lit(">"), text, F.lit("</ix:nonFraction>"))
    scale = F.when(F.col("o_orderkey") % 50 == 0, 'scale="three"').otherwise('scale="3"')
    numbers = F.concat(
        F.lit("<html>"), number("us-gaap:Revenues", F.lit('scale="3" id="f1"'), key), number("us-gaap:Revenues", F.lit('scale="3"'), key), number("us-gaap:Assets", scale, F.lit("(1,5<b>00</b>)")),
        number("us-gaap:NetIncomeLoss", F.lit('sign="-"'), F.lit("<b>1</b>,5")), F.lit('<ix:nonFraction name="x" contextRef="none">1</ix:nonFraction></html>'),
    )
    contexts = F.concat(
        F.lit('<html><xbrli:context id="c1"><xbrli:entity><xbrli:identifier>77</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>'), year, F.lit("-01-01</xbrli:startDate><xbrli:endDate>"), year,
        F.lit('-12-31</xbrli:endDate></xbrli:period></xbrli:context><xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><ix:nonNumeric name="dei:DocumentFiscalYearFocus">2010</ix:nonNumeric></html>'),
    )
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("F"), key).alias("filing"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"), F.posexplode(F.array(numbers, contexts)).alias("part", "html"))
    return xbrl.extracted(rows, "filing", "ticker", "html", "part")


_FACTS_SQL = "f AS (SELECT *, 'us-gaap:Revenues' AS concept, o_orderkey * 1000.0::DOUBLE AS value, 0 AS place FROM filed UNION ALL SELECT *, 'us-gaap:Assets', -1500000.0, 2 FROM filed WHERE o_orderkey % 50 <> 0 UNION ALL SELECT *, 'us-gaap:NetIncomeLoss', -15.0, 3 FROM filed)"


@query("xbrl_facts", f"WITH {FILED}, {_FACTS_SQL} SELECT filing, ticker, row_number() OVER (PARTITION BY filing ORDER BY place) AS id, concept, value, 'iso4217:USD' AS unit, year::INTEGER AS fiscal_year, (CASE WHEN year % 4 = 0 THEN 365 ELSE 364 END)::INTEGER AS days, 0 AS dim_count FROM f")
def xbrl_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all filings, by a table function called with a filing at a time."""
    return xbrl.facts(_filed(spark, sf_dir)).select("filing", "ticker", "id", "concept", "value", "unit", "fiscal_year", "days", F.col("dim_count").cast("int").alias("dim_count"))


@query("xbrl_filings", f"WITH {FILED} SELECT filing, ticker, '77' AS cik, 2010 AS fiscal_year_focus, year || '-12-31' AS period_end, (CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 3 END)::BIGINT AS n_facts, CASE WHEN year <> 2010 THEN ['year focus 2010 is not the period end''s ' || year] ELSE [] END AS notes FROM filed")
def xbrl_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _filed(spark, sf_dir)
    return xbrl.filings(found, xbrl.facts(found)).select("filing", "ticker", "cik", "fiscal_year_focus", "period_end", "n_facts", "notes")


@query("xbrl_quarantine", f"WITH {FILED} SELECT filing, ticker, 'number 2 (us-gaap:Assets): scale ''three''' AS reason FROM filed WHERE o_orderkey % 50 = 0")
def xbrl_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What couldn't be read: the rest of these filings is there."""
    return xbrl.quarantine(_filed(spark, sf_dir))
