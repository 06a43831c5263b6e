"""Inline-XBRL: filings to facts, a table of the filings, and a quarantine of what couldn't be read.

A filing may come in several documents, and a number in one may name a context in another. So a task gets all documents of its
filings, each filing's one after the other and in order: it keeps one filing's contexts, units and names, and gives a row
for each number, one for the filing, and one for each thing that is wrong with it. A bad attribute costs its number, a
bad document that document; neither stops the job. Values, days and years are Spark's expressions over these rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siltstone.functions import numbers as N
from siltstone.session import on_workers, stored

ROW = (
    "filing string, ticker string, kind string, pos int, concept string, raw string, format string, scale int, sign string, unit string, decimals string, fact_id string, context_id string, "
    "period_type string, period_start string, period_end string, dims string, cik string, year_focus string, document_type string, registrant string, reason string"
)
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


#: A tag as well-formed pages have them, and its attributes; elements whose content isn't markup, which are left to the parser.
_SPACE, _NAME = r"[ \t\n\r\f]", r"[A-Za-z_:][-A-Za-z0-9_:.]*"
_TAG = r"[A-Za-z][-A-Za-z0-9_:.]*"
TAG = re.compile(rf'<(?:/({_TAG}){_SPACE}*|({_TAG})((?:{_SPACE}+{_NAME}="[^"<>\0]*")*){_SPACE}*(/?))>')
ATTRIBUTE = re.compile(rf'({_NAME})="([^"]*)"')
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Tags(HTMLParser):
    """Elements of interest with their text; nested ones all collect it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = []
        self.contexts: list[dict] = []
        self.units: list[dict] = []
        self.names: list[dict] = []
        self.numbers: list[dict] = []
        self.cik: str | None = None

    def read(self, html: str) -> None:
        """The elements of a document: where each of its ``<`` begins a plain tag, tag by tag, else by the tolerant parser, which says the same of such ones."""
        parts = TAG.split(html) if "\0" not in html else []  # text, then end, start, attributes, slash, text of each tag
        if len(parts) != 1 + 5 * html.count("<") or any(x and x.lower() in RAW for x in set(parts[2::5])):
            self.feed(html)
            self.close()
            return
        opened = self.open
        for end, start, attrs, slash, text in zip(parts[1::5], parts[2::5], parts[3::5], parts[4::5], parts[5::5], strict=True):
            name = _kept(end or start)
            if name:
                if start:
                    self.handle_starttag(name, [(k, unescape(v)) for k, v in ATTRIBUTE.findall(attrs)])
                if end or slash:
                    self.handle_endtag(name)
            if opened and text:
                self.handle_data(unescape(text))

    KEEP = {"context", "unit", "measure", "identifier", "startdate", "enddate", "instant", "explicitmember", "typedmember", "nonnumeric", "nonfraction"}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name = tag.rsplit(":", 1)[-1]
        if name in self.KEEP:
            at = {k.lower(): v or "" for k, v in attrs}
            self.open.append((name, at, []))
            if name == "context":
                self.contexts.append({"id": at.get("id", ""), "dims": []})
            elif name == "unit":
                self.units.append({"id": at.get("id", ""), "measures": []})
            elif name == "nonfraction":
                at["pos"] = str(len(self.numbers))
                self.numbers.append({})

    def handle_data(self, data: str) -> None:
        for _, _, text in self.open:
            text.append(data)

    def handle_endtag(self, tag: str) -> None:
        name = tag.rsplit(":", 1)[-1]
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == name), None)
        if name not in self.KEEP or at is None:
            return
        _, attrs, parts = self.open.pop(at)
        text = "".join(parts).strip()
        if name in ("startdate", "enddate", "instant") and self.contexts:
            self.contexts[-1][name] = text
        elif name in ("explicitmember", "typedmember") and self.contexts:
            self.contexts[-1]["dims"].append(f"{attrs.get('dimension') or '?'}={text}")
        elif name == "measure" and self.units:
            self.units[-1]["measures"].append(text)
        elif name == "identifier":
            self.cik = self.cik or text
        elif name == "nonnumeric" and attrs.get("name", "").startswith("dei:"):
            self.names.append({"name": attrs["name"], "value": text})
        elif name == "nonfraction":
            self.numbers[int(attrs["pos"])] = {
                "concept": attrs.get("name"), "context_id": attrs.get("contextref"), "unit_id": attrs.get("unitref", ""), "format": attrs.get("format"),
                "scale": attrs.get("scale") or "0", "sign": attrs.get("sign"), "decimals": attrs.get("decimals"), "fact_id": attrs.get("id"), "raw": text,
            }


@lru_cache(maxsize=4096)
def _kept(tag: str) -> str | None:
    """The name of an element of interest, without its prefix."""
    name = tag.lower().rsplit(":", 1)[-1]
    return name if name in _Tags.KEEP else None


def parse(html: str | None) -> dict:
    """Contexts and units by id, names and numbers of one document."""
    tags = _Tags()
    tags.read(html or "")
    contexts: dict[str, dict] = {}
    for c in tags.contexts:
        dims = ";".join(sorted(c["dims"]))
        if c.get("instant"):
            contexts.setdefault(c["id"], {"period_type": "instant", "period_start": None, "period_end": c["instant"], "dims": dims})
        elif c.get("enddate"):
            contexts.setdefault(c["id"], {"period_type": "duration", "period_start": c.get("startdate"), "period_end": c["enddate"], "dims": dims})
    units = {u["id"]: "/".join(u["measures"]) or u["id"] for u in reversed(tags.units)}
    names = {n["name"]: n["value"] for n in reversed(tags.names)}
    return {"contexts": contexts, "units": units, "names": names, "cik": tags.cik, "numbers": [n for n in tags.numbers if n]}


class Filing:
    """Rows (filing, ticker, part, html) of one filing, in order of their parts, to rows of ROW."""

    def __init__(self) -> None:
        self.key: tuple[str | None, str | None] | None = None
        self.contexts: dict = {}
        self.units: dict = {}
        self.names: dict = {}
        self.cik: str | None = None
        self.numbers: list[dict] = []
        self.wrong: list[str] = []

    def _row(self, **held: object) -> tuple:
        filing, ticker = self.key or (None, None)
        row = {"filing": filing, "ticker": ticker, **held}
        return tuple(map(row.get, COLUMNS))

    def eval(self, row: dict) -> None:
        self.key = self.key or (row["filing"], row["ticker"])
        if row["html"] is None:
            self.wrong.append(f"document {row['part']}: no text")
            return
        try:
            found = parse(row["html"])
        except Exception as e:  # noqa: BLE001  a parser of other people's pages may meet anything
            self.wrong.append(f"document {row['part']}: {type(e).__name__}")
            return
        for held, new in ((self.contexts, found["contexts"]), (self.units, found["units"]), (self.names, found["names"])):
            for k, v in new.items():
                held.setdefault(k, v)
        self.cik = self.cik or found["cik"]
        self.numbers += found["numbers"]

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        for pos, n in enumerate(self.numbers):
            context = self.contexts.get(n["context_id"])
            if context is None or n["concept"] is None:
                continue
            try:
                scale = int(n["scale"])
            except ValueError:
                self.wrong.append(f"number {pos} ({n['concept']}): scale {n['scale']!r}")
                continue
            yield self._row(kind="fact", pos=pos, unit=self.units.get(n["unit_id"], n["unit_id"]), cik=self.cik or "", **context, **(n | {"scale": scale}))
        names = self.names.get
        yield self._row(kind="filing", cik=self.cik or "", year_focus=names("dei:DocumentFiscalYearFocus"), document_type=names("dei:DocumentType"), registrant=names("dei:EntityRegistrantName"))
        for pos, reason in enumerate(self.wrong):
            yield self._row(kind="error", pos=pos, reason=reason)


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a task's filings, whose documents come one after the other: a filing may go on in the next batch."""
    last, filing, rows = None, None, []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    for batch in batches:
        for key, ticker, part, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if filing is None or key != last:
                if filing is not None:
                    rows += filing.terminate()
                last, filing = key, Filing()
            filing.eval({"filing": key, "ticker": ticker, "part": part, "html": html})
        if rows:
            yield made()
            rows = []
    if filing is not None:
        rows += filing.terminate()
        yield made()


def extracted(submissions: DataFrame, filing: str, ticker: str, html: str, part: str | None = None) -> DataFrame:
    """The rows of all filings, stored. ``filing`` says which documents are one filing, ``part`` their order in it."""
    on_workers(submissions.sparkSession)
    order = F.col(part).cast("int") if part else F.lit(0)
    rows = submissions.select(F.col(filing).cast("string").alias("filing"), F.col(ticker).cast("string").alias("ticker"), order.alias("part"), F.col(html).alias("html"))
    schema = to_arrow_schema(StructType.fromDDL(ROW))
    return stored(rows.repartition("filing").sortWithinPartitions("filing", "part").mapInArrow(lambda batches: _read(batches, schema), ROW), "xbrl")


def facts(found: DataFrame) -> DataFrame:
    """Facts of extracted() filings: numbers with a known context and a readable value; of those that a filing repeats the first. ``id`` counts them in their filing."""
    value = N.parse_number(F.col("raw"), F.col("format"), F.col("scale"), F.col("sign"))
    rows = found.where("kind = 'fact'").withColumn("value", value).where("value is not null")
    rows = rows.select(
        "filing", "ticker", "cik", "concept", "value", F.col("raw").alias("raw_text"), "unit", "decimals", "scale", "period_type", "period_start", "period_end", N.days_between(F.col("period_start"), F.col("period_end")).alias("days"),
        F.left("period_end", F.lit(4)).try_cast("int").alias("fiscal_year"), "dims", F.regexp_count("dims", F.lit("=")).alias("dim_count"), "context_id", "fact_id", "pos",
    )
    # context ids are a filing's own; a filing is what a task holds, a company may be any number of filings
    again = F.row_number().over(W.partitionBy("filing", "concept", "context_id", "unit", "value").orderBy("pos"))
    rows = rows.withColumn("_again", again).where("_again = 1").drop("_again")
    return rows.withColumn("id", F.row_number().over(W.partitionBy("filing").orderBy("pos")).cast("long")).drop("pos")


def quarantine(found: DataFrame) -> DataFrame:
    """(filing, ticker, reason): what was left out of extracted() filings."""
    return found.where("kind = 'error'").select("filing", "ticker", "reason")


def filings(found: DataFrame, all_facts: DataFrame) -> DataFrame:
    """A row per filing: its year, period end, type, registrant, number of facts, and a note where years disagree."""
    focus = F.regexp_extract(F.coalesce("year_focus", F.lit("")), r"\d{4}", 0)
    rows = found.where("kind = 'filing'").select("filing", "ticker", "cik", F.when(focus != "", focus.cast("int")).alias("fiscal_year_focus"), "document_type", "registrant")
    whole = (F.col("period_type") == "duration") & (F.col("days") > 300) & (F.col("dims") == "")
    ends = all_facts.groupBy("filing").agg(F.max(F.when(whole, F.col("period_end"))).alias("period_end"), F.count("*").alias("n_facts"))
    rows = rows.join(ends.withColumnRenamed("filing", "_filing"), F.col("filing").eqNullSafe(F.col("_filing")), "left").drop("_filing").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    year = F.left("period_end", F.lit(4)).try_cast("int")
    note = F.when(F.col("fiscal_year_focus") != year, F.concat(F.lit("year focus "), F.col("fiscal_year_focus").cast("string"), F.lit(" is not the period end's "), year.cast("string")))
    return rows.withColumn("notes", F.array_compact(F.array(note)))
