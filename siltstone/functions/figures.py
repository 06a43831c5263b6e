"""Numeric figures in text: a grammar, and how one figure answers another.

Extraction needs to look back and ahead of a match, so it is an Arrow function; everything after it (matching, first
figures, grounding) is expressions over arrays of structs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale words, fixed values.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12, "mm": 1e6, "bn": 1e9}
#: A figure's token, and what keeps a number from being one; fixed patterns.
FIGURE = r"\$?\s*(?P<num>\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*(?P<pct>%|percent(?:age points?)?))?(?:\s*(?P<scale>thousand|million|billion|trillion|mm|bn)\b)?"
MONTH_BEFORE = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s*$"
FORM_AFTER = r"^(?:-[A-Za-z]|[A-Z]\b)"
FORM_BEFORE = r"(?:\bitem|\bform|\bsection|\bnote)\s*$"
#: The token alone, for engines without look-around.
PLAIN = r"\$?\s*(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*(?:%|percent(?:age points?)?))?(?:\s*(?:thousand|million|billion|trillion|mm|bn)\b)?"
TYPE = "array<struct<raw:string,unscaled:double,scaled:double,percent:boolean,precision:double>>"
TOLERANCE = 5e-4

_FIGURE, _MONTH, _AFTER, _BEFORE = re.compile(FIGURE, re.I), re.compile(MONTH_BEFORE, re.I), re.compile(FORM_AFTER), re.compile(FORM_BEFORE, re.I)


def figures_of(text: str | None) -> list[dict]:
    """Figures in order. Days after a month's name and numbers of forms and sections are none, unless marked by a scale or percent."""
    found = []
    for m in _FIGURE.finditer(text or ""):
        digits, scale = m["num"].replace(",", ""), (m["scale"] or "").lower()
        if not (scale or m["pct"]):
            before = text[: m.start()]
            day = float(digits) <= 31 and _MONTH.search(before[-12:])
            if day or _AFTER.match(text[m.end() : m.end() + 2]) or _BEFORE.search(before[-10:]):
                continue
        factor, _, decimals = SCALES.get(scale, 1.0), *digits.partition(".")[1:]
        found.append({"raw": m[0].strip(), "unscaled": float(digits), "scaled": float(digits) * factor, "percent": bool(m["pct"]), "precision": factor / 10 ** len(decimals)})
    return found


def extract(text: Column) -> Column:
    @F.pandas_udf(TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(figures_of)

    return run(text)


def plain(text: Column) -> Column:
    """Tokens of the grammar without the rules on context."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + PLAIN), F.lit(0))


def is_year(f: Column) -> Column:
    return ~f["percent"] & (f["scaled"] == f["unscaled"]) & (f["unscaled"] == F.floor(f["unscaled"])) & f["unscaled"].between(1900, 2100)


def content(figures: Column) -> Column:
    """All but bare years."""
    return F.filter(figures, lambda f: ~is_year(f))


def primary(figures: Column) -> Column:
    """The first figure that isn't a year, or null."""
    return F.get(content(figures), F.lit(0))


def _near(a: Column, b: Column, tolerance: float, floor: float) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def _bare(f: Column) -> Column:
    return (f["scaled"] == f["unscaled"]) & (f["unscaled"] == F.floor(f["unscaled"]))


def matches(expected: Column, candidate: Column) -> Column:
    """Whether ``candidate`` states ``expected``, maybe more precisely. Bare integers only match the same; not symmetric."""
    p = expected["precision"]
    rounded = F.bround(candidate["scaled"] / p, 0) * p
    rounds = F.abs(rounded - expected["scaled"]) <= F.greatest(1e-9 * F.greatest(F.abs(rounded), F.abs(expected["scaled"])), p * 1e-9)
    close = _near(expected["scaled"], candidate["scaled"], TOLERANCE, 1e-12) | _near(expected["unscaled"], candidate["unscaled"], TOLERANCE, 1e-12) | rounds
    return (expected["percent"] == candidate["percent"]) & F.when(_bare(expected) & _bare(candidate), expected["unscaled"] == candidate["unscaled"]).otherwise(close)


def dedupe(figures: Column) -> Column:
    """Figures that match none kept before them; matching isn't transitive, so this folds in order."""
    none = F.array().cast(TYPE)
    return F.aggregate(figures, none, lambda kept, f: F.when(F.exists(kept, lambda k: matches(f, k)), kept).otherwise(F.concat(kept, F.array(f))))


def supported(figure: Column, sources: Column) -> Column:
    """Whether a source states it; a percentage may stand there as a plain number."""
    as_plain = F.struct(figure["raw"].alias("raw"), figure["unscaled"].alias("unscaled"), figure["scaled"].alias("scaled"), F.lit(False).alias("percent"), figure["precision"].alias("precision"))
    bare = F.exists(sources, lambda g: ~g["percent"] & (g["scaled"] == g["unscaled"]) & matches(as_plain, g))
    return F.exists(sources, lambda g: matches(figure, g)) | (figure["percent"] & bare)


def figure_match(truth: Column, answer: Column) -> Column:
    """struct(applicable, n_expected, n_found, recall, exact, primary, primary_found, missing) of two arrays of figures.

    Null scores where the truth has no figure but years.
    """
    expected = dedupe(truth)
    missing = F.filter(expected, lambda e: ~F.exists(answer, lambda g: matches(e, g)))
    first = primary(expected)
    use = first.isNotNull()
    n, found = F.size(expected), F.size(expected) - F.size(missing)
    return F.struct(
        use.alias("applicable"),
        F.when(use, n).otherwise(0).alias("n_expected"),
        F.when(use, found).otherwise(0).alias("n_found"),
        F.when(use, F.round(found / n, 4)).alias("recall"),
        F.when(use, F.size(missing) == 0).alias("exact"),
        F.when(use, first["raw"]).alias("primary"),
        F.when(use, F.exists(answer, lambda g: matches(first, g))).alias("primary_found"),
        F.when(use, F.transform(missing, lambda m: m["raw"])).otherwise(F.array().cast("array<string>")).alias("missing"),
    )


def grounding(figures: Column, seen: Column) -> Column:
    """struct(applicable, n_figures, n_grounded, grounded, ungrounded): which content figures anything seen supports."""
    own = content(figures)
    lost = F.filter(own, lambda f: ~supported(f, seen))
    use = F.size(own) > 0
    return F.struct(
        use.alias("applicable"), F.size(own).alias("n_figures"), (F.size(own) - F.size(lost)).alias("n_grounded"), F.when(use, F.size(lost) == 0).alias("grounded"), F.transform(lost, lambda f: f["raw"]).alias("ungrounded")
    )
