"""Tagged facts: concept resolution, segments, lookup with fallback, display, and arithmetic over them.

facts: (id, ticker, concept, value, raw_text, unit, scale, period_type, period_start, period_end, days, fiscal_year, dims, dim_count)
requests: (request_id, ticker, concept, fiscal_year, segment)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Concepts by plain name, most common first; fixed values.
CONCEPTS = {
    "revenue": ["us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap:Revenues", "us-gaap:SalesRevenueNet"],
    "net income": ["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss"],
    "operating income": ["us-gaap:OperatingIncomeLoss"],
    "gross profit": ["us-gaap:GrossProfit"],
    "cost of revenue": ["us-gaap:CostOfRevenue", "us-gaap:CostOfGoodsAndServicesSold"],
    "research and development": ["us-gaap:ResearchAndDevelopmentExpense"],
    "selling general and administrative": ["us-gaap:SellingGeneralAndAdministrativeExpense"],
    "income tax": ["us-gaap:IncomeTaxExpenseBenefit"],
    "effective tax rate": ["us-gaap:EffectiveIncomeTaxRateContinuingOperations"],
    "eps diluted": ["us-gaap:EarningsPerShareDiluted"],
    "eps basic": ["us-gaap:EarningsPerShareBasic"],
    "total assets": ["us-gaap:Assets"],
    "total liabilities": ["us-gaap:Liabilities"],
    "stockholders equity": ["us-gaap:StockholdersEquity", "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "cash": ["us-gaap:CashAndCashEquivalentsAtCarryingValue"],
    "long-term debt": ["us-gaap:LongTermDebtNoncurrent", "us-gaap:LongTermDebt"],
    "operating cash flow": ["us-gaap:NetCashProvidedByUsedInOperatingActivities"],
    "capital expenditures": ["us-gaap:PaymentsToAcquirePropertyPlantAndEquipment"],
    "share repurchases": ["us-gaap:PaymentsForRepurchaseOfCommonStock"],
    "dividends paid": ["us-gaap:PaymentsOfDividends", "us-gaap:PaymentsOfDividendsCommonStock"],
    "depreciation and amortization": ["us-gaap:DepreciationDepletionAndAmortization", "us-gaap:DepreciationAmortizationAndAccretionNet"],
    "stock-based compensation": ["us-gaap:ShareBasedCompensation", "us-gaap:AllocatedShareBasedCompensationExpense"],
    "goodwill": ["us-gaap:Goodwill"],
    "inventory": ["us-gaap:InventoryNet"],
    "accounts receivable": ["us-gaap:AccountsReceivableNetCurrent"],
    "interest expense": ["us-gaap:InterestExpense", "us-gaap:InterestExpenseNonoperating"],
    "shares outstanding": ["dei:EntityCommonStockSharesOutstanding", "us-gaap:CommonStockSharesOutstanding"],
    "weighted average diluted shares": ["us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding"],
}
#: Other phrasings of those names; fixed values. Phrases with a hyphen can't be reached, as normalising takes it away.
PHRASES = {
    "revenues": "revenue", "total revenue": "revenue", "total revenues": "revenue", "net sales": "revenue", "total net sales": "revenue",
    "sales": "revenue", "net revenue": "revenue", "net revenues": "revenue", "turnover": "revenue",
    "profit": "net income", "net earnings": "net income", "earnings": "net income", "net profit": "net income",
    "income from operations": "operating income", "operating profit": "operating income", "gross margin": "gross profit",
    "cost of sales": "cost of revenue", "cost of goods sold": "cost of revenue", "cogs": "cost of revenue",
    "r&d": "research and development", "rd": "research and development",
    "sg&a": "selling general and administrative", "sga": "selling general and administrative",
    "income taxes": "income tax", "provision for income taxes": "income tax", "tax expense": "income tax",
    "diluted eps": "eps diluted", "earnings per share": "eps diluted", "eps": "eps diluted", "basic eps": "eps basic",
    "assets": "total assets", "liabilities": "total liabilities", "shareholders equity": "stockholders equity", "equity": "stockholders equity",
    "total equity": "stockholders equity", "cash and cash equivalents": "cash", "debt": "long-term debt", "long term debt": "long-term debt",
    "cash from operations": "operating cash flow", "cash flow from operations": "operating cash flow",
    "net cash provided by operating activities": "operating cash flow", "capex": "capital expenditures",
    "purchases of property and equipment": "capital expenditures", "buybacks": "share repurchases", "repurchases": "share repurchases",
    "stock repurchases": "share repurchases", "dividends": "dividends paid", "d&a": "depreciation and amortization",
    "depreciation": "depreciation and amortization", "sbc": "stock-based compensation", "share-based compensation": "stock-based compensation",
    "receivables": "accounts receivable", "inventories": "inventory",
}
#: Segment names and the token in a member's name; fixed values.
SEGMENTS = {
    "aws": "amazonwebservices", "amazon web services": "amazonwebservices", "fba": "familyofapps", "family of apps": "familyofapps",
    "reality labs": "realitylabs", "google services": "googleservices", "google cloud": "googlecloud", "other bets": "otherbets",
    "intelligent cloud": "intelligentcloud", "productivity and business processes": "productivityandbusinessprocesses",
    "more personal computing": "morepersonalcomputing", "iphone": "iphone", "mac": "mac", "ipad": "ipad",
    "wearables": "wearableshomeandaccessories", "services": "service", "north america": "northamerica", "international": "international",
    "americas": "americas", "europe": "europe", "greater china": "greaterchina", "japan": "japan", "rest of asia pacific": "restofasiapacific",
}
LIMIT, ANNUAL_DAYS, SEARCH_LIMIT = 12, 300, 8


def _map(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def phrase(text: Column) -> Column:
    """Lower case, runs of anything but letters, digits and & to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9&]+", " "))


def concept_words(concept: Column) -> Column:
    """A concept's local name as words."""
    return F.lower(F.regexp_replace(F.regexp_replace(concept, "^[^:]*:", ""), "(?<=[a-z0-9])(?=[A-Z])", " "))


def segment_token(segment: Column) -> Column:
    key = phrase(segment)
    return F.coalesce(F.element_at(_map(SEGMENTS), key), F.replace(key, F.lit(" "), F.lit("")))


def segment_matches(dims: Column, token: Column) -> Column:
    """Whether a token is part of any member's local name; axes don't count, an empty token matches nothing."""
    member = lambda p: F.lower(F.element_at(F.split(F.regexp_extract(p, "=(.*)$", 1), ":"), -1))
    return (token != "") & F.exists(F.split(F.coalesce(dims, F.lit("")), ";"), lambda p: F.contains(member(p), token))


def split_segment(text: Column) -> tuple[Column, Column]:
    """(concept, segment): the longest segment name in a phrase is lifted out; what is left, or revenue, is the concept."""
    q = phrase(text)
    whole = lambda a: F.concat(F.lit(r"\b\Q"), a, F.lit(r"\E\b"))
    segment = F.get(F.filter(F.array(*map(F.lit, sorted(SEGMENTS, key=len, reverse=True))), lambda a: F.regexp(q, whole(a))), F.lit(0))
    rest = F.trim(F.regexp_replace(F.regexp_replace(q, whole(segment), F.lit(" ")), r"\s+", " "))
    return F.when(segment.isNull(), text).when(rest == "", "revenue").otherwise(rest), segment


def resolve(requests: DataFrame, available: DataFrame) -> DataFrame:
    """(request_id, how, concept, pos): the concepts of a request at its company.

    requests: (request_id, ticker, concept); available: (ticker, concept). A name with a colon is exact or nothing; a known phrase
    gives its concepts that the company has, in order; else names are searched by the share of words that they hold:
    best share, then shorter, then later by name, eight at most.
    """
    asked = requests.select("request_id", F.upper("ticker").alias("ticker"), F.trim(F.coalesce("concept", F.lit(""))).alias("q"))
    key = phrase(F.col("q"))
    asked = asked.withColumn("key", F.coalesce(F.element_at(_map(PHRASES), key), key)).withColumn("exact", F.col("q").contains(":"))
    known = F.coalesce(F.element_at(_map(CONCEPTS), F.col("key")), F.array().cast("array<string>"))
    words = F.filter(F.split("key", " "), lambda t: F.length(t) > 2)
    rows = asked.withColumn("known", known).withColumn("tokens", words).join(available.select("ticker", F.col("concept").alias("c")).distinct(), "ticker")
    named = concept_words(F.col("c"))
    share = F.size(F.filter("tokens", lambda t: F.contains(named, t))) / F.greatest(F.size("tokens"), F.lit(1))
    rows = rows.withColumn("share", share).withColumn("words", F.length(named))
    how = F.when(F.col("exact"), F.when(F.lower("c") == F.lower("q"), "exact")).when(F.array_contains("known", F.col("c")), "synonym").when(F.col("share") > 0, "search")
    rows = rows.withColumn("how", how).where("how is not null")
    mine = W.partitionBy("request_id")
    rows = rows.withColumn("any_known", F.max(F.col("how") == "synonym").over(mine)).where("how <> 'search' or not any_known")
    rows = rows.withColumn("best", F.max(F.when(F.col("how") == "search", F.col("share"))).over(mine))
    rows = rows.where((F.col("how") != "search") | (F.col("share") >= F.greatest(F.lit(0.5), F.col("best") - 1e-9)))
    order = W.partitionBy("request_id").orderBy(F.when(F.col("how") == "synonym", F.array_position("known", F.col("c"))), F.desc("share"), "words", F.desc("c"))
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long")).where((F.col("how") != "search") | (F.col("pos") <= SEARCH_LIMIT))
    return rows.select("request_id", "how", F.col("c").alias("concept"), "pos")


def asked_facts(requests: DataFrame) -> DataFrame:
    """Requests with the segment lifted out of their phrase, where they name none themselves."""
    concept, segment = split_segment(F.col("concept"))
    given = F.col("segment").isNotNull()
    return requests.withColumn("_c", F.when(given, F.col("concept")).otherwise(concept)).withColumn("segment", F.coalesce("segment", segment)).withColumn("concept", F.col("_c")).drop("_c")


def lookup_phrase(requests: DataFrame, facts: DataFrame, filings: DataFrame, limit: int = LIMIT, annual_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of lookup(), info) of requests in plain words.

    info has one row for each request: resolved_by (exact, synonym, search or none), concepts, fiscal_year and whether it was
    defaulted, segment, years_available of those concepts, n_rows, and a note where segments stand in for a consolidated value.
    """
    asked = asked_facts(requests).withColumn("ticker", F.upper("ticker"))
    found = resolve(asked, facts.select("ticker", "concept"))
    rows = lookup(asked, found, facts, filings, limit, annual_only)
    names = found.groupBy("request_id").agg(F.first("how").alias("how"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "concept"))), lambda x: x["concept"]).alias("concepts"))
    years = asked.select("request_id", "ticker").join(found.select("request_id", "concept"), "request_id").join(facts.select("ticker", "concept", "fiscal_year").distinct(), ["ticker", "concept"])
    years = years.groupBy("request_id").agg(F.array_sort(F.collect_set("fiscal_year")).alias("years_available"))
    counted = rows.groupBy("request_id").agg(F.count("*").alias("n_rows"), F.bool_or("fallback").alias("fallback"))
    info = asked.join(filings.select("ticker", "fiscal_year_focus"), "ticker", "left").join(names, "request_id", "left").join(years, "request_id", "left").join(counted, "request_id", "left")
    none = F.col("how").isNull()
    return rows, info.select(
        "request_id", "ticker", F.coalesce("how", F.lit("none")).alias("resolved_by"), F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"),
        F.when(none, F.col("fiscal_year")).otherwise(F.coalesce("fiscal_year", "fiscal_year_focus")).alias("fiscal_year"), (~none & F.col("fiscal_year").isNull()).alias("fiscal_year_defaulted"), "segment",
        F.coalesce("years_available", F.array().cast("array<int>")).alias("years_available"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(F.col("fallback"), "no consolidated value; segment values returned").alias("note"),
    )


def lookup(requests: DataFrame, resolved: DataFrame, facts: DataFrame, filings: DataFrame, limit: int = LIMIT, annual_only: bool = True) -> DataFrame:
    """(request_id, rank, fallback, id, ...): facts of each request.

    The year defaults to the filing's. Consolidated values, or those of the segment asked for, by fewest dimensions, longest
    period, largest value; where there is none and no segment was asked for, values of one dimension instead.
    """
    asked = requests.withColumn("ticker", F.upper("ticker")).join(filings.select("ticker", "fiscal_year_focus"), "ticker", "left")
    asked = asked.withColumn("year", F.coalesce("fiscal_year", "fiscal_year_focus")).select("request_id", "ticker", "year", "segment")
    wanted = asked.join(resolved.select("request_id", "concept"), "request_id")
    usable = facts.where((F.col("period_type") == "instant") | (F.col("days") > ANNUAL_DAYS)) if annual_only else facts
    rows = usable.join(wanted.withColumnRenamed("year", "fiscal_year"), ["ticker", "concept", "fiscal_year"])
    segment = F.col("segment").isNotNull()
    token = segment_token(F.col("segment"))
    rows = rows.where(~segment | F.contains(F.lower("dims"), token))  # coarse, on the whole string, before members are taken apart
    main = F.when(segment, segment_matches(F.col("dims"), token)).otherwise(F.col("dim_count") == 0)
    rows = rows.withColumn("main", main).where(F.col("main") | (~segment & (F.col("dim_count") == 1)))
    rows = rows.withColumn("fallback", ~F.max("main").over(W.partitionBy("request_id"))).where("main or fallback")
    order = W.partitionBy("request_id").orderBy(
        F.when(~F.col("fallback"), F.col("dim_count")), F.when(~F.col("fallback"), F.col("days")).desc_nulls_last(), F.desc(F.abs("value")), "id"
    )
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).drop("main")


def segment_label(dims: Column) -> Column:
    """consolidated, or axis=member pairs by their local names."""
    local = lambda x, tail: F.replace(F.element_at(F.split(x, ":"), -1), F.lit(tail), F.lit(""))
    pair = lambda p: F.concat(local(F.regexp_extract(p, "^([^=]*)", 1), "Axis"), F.lit("="), local(F.regexp_extract(p, "=(.*)$", 1), "Member"))
    return F.when(F.coalesce(dims, F.lit("")) == "", "consolidated").otherwise(F.array_join(F.transform(F.split(dims, ";"), pair), "; "))


def _trimmed(number: Column) -> Column:
    """Digits without zeros at the end of decimals."""
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.?0+$", "")).otherwise(number)


def significant(value: Column, digits: int, grouped: bool = False) -> Column:
    """A number to so many significant digits: plain, or as mantissa and exponent where it is under 0.0001 or has more digits before the point."""
    size = F.abs(value)
    parts = F.split(F.format_string(f"%.{digits - 1}e", value), "e")  # rounding may carry, so the exponent is read from the result
    power = F.get(parts, F.lit(1)).cast("int")
    plain = F.coalesce(*[F.when(power == p, F.format_string(f"%{',' if grouped else ''}.{max(0, digits - 1 - p)}f", value)) for p in range(-4, digits)])
    tail = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    scientific = F.concat(_trimmed(F.get(parts, F.lit(0))), F.lit("e"), tail)
    return F.when(size == 0, "0").when(plain.isNotNull(), _trimmed(plain)).otherwise(scientific)


def formatted_value(value: Column, unit: Column) -> Column:
    """A value as people write it. Money is whole, in millions from one million on (one decimal unless they are whole), and to the cent
    per share; shares are whole; pure numbers have six significant digits, and their percentage up to 1.5; anything else has four and its unit."""
    kind, size = F.lower(F.coalesce(unit, F.lit(""))), F.abs(value)
    money, shares = F.contains(kind, F.lit("usd")), F.contains(kind, F.lit("shares"))
    whole = lambda x, places: F.format_string(f"%,.{places}f", x)
    millions = F.concat(whole_half_even(size / 1e6, F.when(size == F.bround(size / 1e6, 0) * 1e6, 0).otherwise(1)), F.lit(" million"))
    dollars = F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), F.when(size >= 1e6, millions).otherwise(whole_half_even(size, F.lit(0))))
    percent = F.when(size <= 1.5, F.concat(F.lit(" ("), F.format_string("%.1f", value * 100), F.lit("%)"))).otherwise("")
    return (
        F.when(money & shares, F.concat(F.lit("$"), whole(value, 2), F.lit(" per share")))
        .when(money, dollars)
        .when(shares, F.concat(whole_half_even(value, F.lit(0)), F.lit(" shares")))
        .when(F.contains(kind, F.lit("pure")), F.concat(significant(value, 6), percent))
        .otherwise(F.concat(significant(value, 4, grouped=True), F.lit(" "), unit))
    )


def whole_half_even(value: Column, places: Column) -> Column:
    """With thousands separated, to no or one decimal, halves to the even digit."""
    return F.when(places == 0, F.format_string("%,.0f", F.bround(value, 0))).otherwise(F.format_string("%,.1f", value))


def period_label(kind: Column, year: Column, start: Column, end: Column) -> Column:
    return F.when(kind == "instant", F.concat(F.lit("as of "), end)).otherwise(F.concat(F.lit("FY"), year.cast("string"), F.lit(" ("), start, F.lit(" to "), end, F.lit(")")))


#: What an unresolved phrase is told, a fixed value.
NO_CONCEPT = "Try a standard line item (revenue, net income, operating income, gross profit, diluted EPS, total assets, operating cash flow, capital expenditures) or a segment name, or search the filing text."


def observations(found: DataFrame, info: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(request_id, text): numbered blocks of a request's facts, as a tool would show them.

    With the info of lookup_phrase() and the requests, a first line says how the phrase was resolved, and requests
    without facts get the text that says what was tried.
    """
    tagged = F.concat(F.lit('tagged "'), F.coalesce("raw_text", F.lit("")), F.lit('" x10^'), F.coalesce("scale", F.lit(0)).cast("string"), F.lit(" "), "unit") if "raw_text" in found.columns else None
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] ticker="), "ticker", F.lit("  fact_id="), F.col("id").cast("string"), F.lit("\n    "), "concept", F.lit(" | "),
        period_label(F.col("period_type"), F.col("fiscal_year"), F.col("period_start"), F.col("period_end")), F.lit(" | "), formatted_value(F.col("value"), F.col("unit")), F.lit(" | "), segment_label(F.col("dims")),
        *([] if tagged is None else [F.lit(" | "), tagged, F.lit(" | source: "), "ticker", F.lit(" 10-K inline XBRL")]),
    )
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))  # LIMIT facts at most
    text = found.groupBy("request_id").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n").alias("text"))
    if info is None:
        return text
    quoted = F.concat(F.lit("'"), F.col("phrase"), F.lit("'"))
    concepts, year = F.array_join("concepts", ", "), F.coalesce(F.col("fiscal_year").cast("string"), F.lit("None"))
    note = F.when(F.col("fiscal_year_defaulted"), " (the most recent fiscal year in the filing; pass fiscal_year for another)").otherwise("")
    segment = F.when(F.col("segment").isNotNull(), F.concat(F.lit(" segment '"), "segment", F.lit("'"))).otherwise("")
    nothing = F.concat(F.lit("No XBRL concept matches "), quoted, F.lit(" for "), "ticker", F.lit(". " + NO_CONCEPT))
    untagged = F.concat(F.lit("Resolved "), quoted, F.lit(" to "), concepts, F.lit(" for "), "ticker", F.lit(", but no annual value is tagged for fiscal year "), year, segment, note, F.lit(". The filing covers fiscal years "), F.array_join(F.transform("years_available", lambda y: y.cast("string")), ", "), F.lit("."))
    head = F.concat(F.lit("XBRL facts for "), "ticker", F.lit(": "), quoted, F.lit(" resolved by "), "resolved_by", F.lit(" to "), concepts, F.lit("; fiscal year "), year, note, F.lit("."), F.coalesce(F.concat(F.lit(" Note: "), F.col("note"), F.lit(".")), F.lit("")))
    all_ = info.join(asked.select("request_id", F.col("concept").alias("phrase")), "request_id").join(text, "request_id", "left")
    return all_.select("request_id", F.when(F.size("concepts") == 0, nothing).when(F.col("text").isNull(), untagged).otherwise(F.concat(head, F.lit("\n\n"), "text")).alias("text"))
