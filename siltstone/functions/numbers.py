"""Numeric expressions: tagged numbers, dates, arithmetic, prices, percentiles, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.session import stored

#: Dollars per million tokens (in, out) by model, fixed values, in order.
PRICES = {
    "gemini-3.1-flash-lite": (0.25, 1.50),
    "gemini-3.5-flash-lite": (0.30, 2.50),
    "gemini-3.5-flash": (1.50, 9.00),
    "gemini-3.6-flash": (0.75, 3.75),
    "gemini-3.7-flash": (0.75, 3.75),
    "gemini-3.8-flash": (0.75, 3.75),
}
OPERATIONS = ("cagr_pct", "difference", "margin_pct", "pct_change", "ratio", "sum")


def parse_number(text: Column, fmt: Column, scale: Column, sign: Column) -> Column:
    """The value of a tagged number: zero formats, dashes, parentheses, comma decimals, sign and power of ten; else null."""
    fmt = F.coalesce(fmt, F.lit(""))

    def read(bare: Column) -> Column:
        digits = F.regexp_replace(bare, r"^[()]+|[()]+$", "")
        digits = F.when(fmt.endswith("num-comma-decimal"), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
        value = digits.try_cast("double") * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0)))
        negative = F.coalesce(sign == "-", F.lit(False)) | (bare.startswith("(") & bare.endswith(")"))
        return (
            F.when(fmt.endswith("fixed-zero") | fmt.endswith("zerodash"), F.lit(0.0))
            .when(bare.isin("", "-", "—", "–"), F.when(fmt.contains("zero"), F.lit(0.0)))
            .otherwise(value * F.when(negative, -1.0).otherwise(1.0))
        )

    # by way of an array, so that the text is bared once and not for each mention of it
    return F.get(F.transform(F.array(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", "")), read), F.lit(0))


def days_between(start: Column, end: Column) -> Column:
    """Days from one ISO date to another, null if either is none."""
    return F.datediff(F.try_to_date(end, "yyyy-MM-dd"), F.try_to_date(start, "yyyy-MM-dd"))


def compute(operation: Column, a: Column, b: Column, n: Column) -> Column:
    """struct(result, error) of a named operation; one of the two is null."""
    op = F.lower(F.trim(operation))
    share = F.try_divide(a, b)
    result = (
        F.when(op == "difference", a - b)
        .when(op == "sum", a + b)
        .when(op == "ratio", share)
        .when(op == "pct_change", F.try_divide(a - b, b) * 100)
        .when(op == "margin_pct", share * 100)
        .when((op == "cagr_pct") & (n > 0) & (share > 0), (F.pow(share, 1 / n) - 1) * 100)
    )
    error = (
        F.when(F.coalesce(~op.isin(*OPERATIONS), F.lit(True)), "unknown operation")
        .when((op == "cagr_pct") & F.coalesce(n <= 0, F.lit(True)), "n must be positive")
        .when((op == "cagr_pct") & F.coalesce(share <= 0, F.lit(True)), "a and b must have the same sign")
        .when(~op.isin("difference", "sum") & (b == 0), "division by zero")
    )
    return F.struct(F.when(error.isNull(), result).alias("result"), error.alias("error"))


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]] | None = None) -> Column:
    """Dollars rounded to 6 places; by exact name, else by the first name that the model's starts with; null if unknown."""
    key = F.lower(F.element_at(F.split(model, "/"), -1))
    table = prices or PRICES
    price = lambda p: (tokens_in * F.lit(p[0]) + tokens_out * F.lit(p[1])) / 1e6
    options = [F.when(key == name, price(p)) for name, p in table.items()] + [F.when(key.startswith(name), price(p)) for name, p in table.items()]
    return F.round(F.coalesce(*options), 6)


def _steps(pct: float, kind: str, n: Column) -> list[tuple[Column, Column]]:
    """(index from 0, share of the way to it) of the ordered values that a percentile lies between: the lower first, and for linear ones the higher."""
    place = F.lit(pct / 100) * (n - 1)
    if kind == "nearest":
        return [(F.bround(place, 0).cast("long"), F.lit(0.0))]
    low = F.floor(place).cast("long")
    return [(low, F.lit(0.0)), (F.least(low + 1, n - 1), place - low)]


ACCURACY = 2000
GROUPS = 20_000  # groups that go through the driver, a row each, and are broadcast; more are stored and joined


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]], digits: int = 1) -> DataFrame:
    """``by`` and a column for each of ``wanted``: name -> (nearest or linear, percent), rounded; null values don't count.

    A first pass gives each group's number of values and, from a mergeable sketch, a bracket of values around each wanted percent;
    small groups are brackets whole. A second pass counts what lies below a bracket and each value inside it, in the task that reads
    it, and only these counts are put in order. Should a bracket have missed a place, its group is done again with a bracket of all its values.
    """
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    around = [max(0.0, min(1.0, pct / 100 + side * 3 / ACCURACY)) for _, pct in wanted.values() for side in (-1, 1)]
    sketched = values.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", around, ACCURACY).alias("_q"))
    small = F.col("_n") <= ACCURACY
    ends = lambda i: F.struct(F.lit(i).alias("i"), F.when(~small, F.col("_q")[2 * i]).alias("low"), F.when(~small, F.col("_q")[2 * i + 1]).alias("high"))
    brackets, few = _settled(sketched.select(*by, "_n", F.array(*[ends(i) for i in range(len(wanted))]).alias("_ends")))
    found, rows_found = _settled(_placed(values, brackets, few is not None, by, wanted))
    whole = F.forall("_found", lambda x: x.isNotNull())
    complete = len(rows_found) == len(few) and all(None not in r["_found"] for r in rows_found) if few is not None and rows_found is not None else None
    if complete is None:
        complete = brackets.join(found.where(whole), by, "left_anti").isEmpty()
    if not complete:
        missed = brackets.join(found.where(whole), by, "left_anti")
        wide = missed.withColumn("_ends", F.transform("_ends", lambda e: F.struct(e["i"].alias("i"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))))
        found = found.where(whole).unionByName(_placed(values, wide, few is not None, by, wanted))
    return found.select(*by, *[F.round(F.col("_found")[i], digits).alias(name) for i, name in enumerate(wanted)])


def _settled(df: DataFrame) -> tuple[DataFrame, list | None]:
    """``df`` computed once: its rows too where they are few."""
    rows = df.take(GROUPS + 1)
    if len(rows) <= GROUPS:
        return df.sparkSession.createDataFrame(rows, df.schema), rows
    return stored(df, "groups"), None


def _placed(values: DataFrame, brackets: DataFrame, few: bool, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, _found): the wanted percentiles of each group, in order, null where its bracket doesn't hold them."""
    held = F.broadcast(brackets) if few else brackets
    names = {c: f"_by_{i}" for i, c in enumerate(by)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    held = held.withColumnsRenamed(names)
    each = F.filter("_ends", lambda e: e["high"].isNull() | (F.col("_v") <= e["high"]))  # what lies above takes no part
    key = lambda e: F.struct(e["i"].alias("i"), F.when(e["low"].isNull() | (F.col("_v") >= e["low"]), F.col("_v")).alias("v"))  # noqa: E731  null: below
    counted = values.join(held, same).select(*by, "_n", F.explode(F.transform(each, key)).alias("_k")).groupBy(*by, "_n", "_k.i", "_k.v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()))
    counted = counted.withColumn("_to", upto).where("v is not null")
    parts = []
    for i, (kind, pct) in enumerate(wanted.values()):
        steps = _steps(pct, kind, F.col("_n"))
        at = lambda place, i=i: F.max(F.when((F.col("i") == i) & (F.col("_to") > place) & (F.col("_to") - F.col("_c") <= place), F.col("v")))
        low = at(steps[0][0])
        if len(steps) == 2:
            share = F.max(steps[1][1])
            low = low + (at(steps[1][0]) - low) * share
        parts.append(low)
    return counted.groupBy(*by).agg(F.array(*parts).alias("_found"))


def ratio(n: Column, of: Column) -> Column:
    """Share rounded to 4 places, null of none."""
    return F.when(of > 0, F.round(n / of, 4))
