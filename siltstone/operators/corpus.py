"""From submissions to chunks: envelopes, page text, recursive splitting, audits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

CHUNK_CHARS, CHUNK_OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def _envelope(text: str) -> Column:
    """array<struct<type, body>> of a submission's documents, in order."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    inner = lambda b: F.regexp_extract(b, r"(?s)<TEXT>(.*?)</TEXT>", 1)
    return F.transform(
        F.filter(blocks, lambda b: b.rlike("<TYPE>")),
        lambda b: F.struct(F.trim(F.regexp_extract(b, r"<TYPE>([^\r\n<]*)", 1)).alias("type"), F.when(b.rlike(r"(?s)<TEXT>.*?</TEXT>"), inner(b)).otherwise(b).alias("body")),
    )


def documents(submissions: DataFrame, text: str) -> DataFrame:
    """One row per document of a submission: pos from 0, type, body (the whole block where it has no inner text)."""
    rest = [c for c in submissions.columns if c != text]
    return submissions.select(*rest, F.posexplode(_envelope(text)).alias("pos", "d")).select(*rest, "pos", F.col("d.type").alias("type"), F.col("d.body").alias("body"))


def primary_document(submissions: DataFrame, key: str, text: str, kind: str = "10-K") -> DataFrame:
    """(key, body, others): the first document of a kind and the number of others; without an envelope the text itself and 0."""
    docs = _envelope(text)
    main = F.get(F.filter(docs, lambda d: F.upper(d["type"]).startswith(kind)), F.lit(0))
    missing = F.raise_error(F.concat(F.lit(f"no {kind} document in submission "), F.col(key).cast("string")))
    body = F.when(F.size(docs) == 0, F.col(text)).when(main.isNull(), missing.cast("string")).otherwise(main["body"])
    return submissions.select(key, body.alias("body"), F.greatest(F.size(docs) - 1, F.lit(0)).cast("long").alias("others"))


class _Text(HTMLParser):
    """Text nodes outside elements that hold none to read."""

    HIDDEN = {"script", "style", "ix:header", "ix:hidden", "ix:resources", "ix:references"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """Text of a page, one line per text node."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(p for p in (x.strip() for x in parser.parts) if p)


def page_text(html: str) -> Column:
    """Text of a column of pages by a tolerant parser."""

    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(html_text, na_action="ignore")

    return parse(html)


def _pieces(text: str, separator: str) -> list[str]:
    """``text`` cut before each separator; single characters for the empty one."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def split_text(text: str | None, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of ``size`` characters at most: cut at the first separator that occurs, oversized pieces at the next ones,
    small pieces joined, each chunk beginning with a tail of the one before, of ``overlap`` at most. Blank texts give none."""
    if not text or not text.strip():
        return []
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out: list[str] = []
    held: deque[str] = deque()
    chars = 0  # of what is held

    def emit() -> None:
        if chunk := "".join(held).strip():
            out.append(chunk)

    for piece in _pieces(text, separators[at]):
        if len(piece) > size and at + 1 < len(separators):
            emit()
            held.clear()
            chars = 0
            out += split_text(piece, size, overlap, separators[at + 1 :])
            continue
        if held and chars + len(piece) > size:
            emit()
            while held and (chars > overlap or chars + len(piece) > size):
                chars -= len(held.popleft())
        held.append(piece)
        chars += len(piece)
    emit()
    return out


def chunks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, chunk_idx, chunk): chunks in document order, counted from 0."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(split_text)

    return docs.select(*keys, F.posexplode(split(text)).alias("chunk_idx", "chunk"))


def audit(docs: DataFrame, text: str) -> DataFrame:
    """(class, n, share) for every class, those that don't occur too."""
    counts = docs.select(T.classify(F.col(text)).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    wide = counts.agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(T.CLASSES)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"c{i}").alias("n")) for i, c in enumerate(T.CLASSES)]))
    return wide.select("total", rows.alias("r")).select("r.class", "r.n", F.coalesce(F.round(F.try_divide(F.col("r.n"), F.col("total")), 4), F.lit(0.0)).alias("share"))


def audit_by(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each key: all chunks and those of each class."""
    rows = docs.select(key, T.classify(F.col(text)).alias("class"))
    return rows.groupBy(key).agg(F.count("*").alias("n_chunks"), *[F.count_if(F.col("class") == c).alias(c) for c in T.CLASSES])


def cleaned(filings: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(keys, text) of the clean text of submissions, and (keys, reason) of those that give none: one bad filing never stops the others.

    The primary document's page becomes text, one line a text node, from the first prose line on, with white space in order.
    """
    docs = _envelope(text)
    main = F.get(F.filter(docs, lambda d: F.upper(d["type"]).startswith("10-K")), F.lit(0))["body"]
    body = F.when(F.size(docs) == 0, F.col(text)).otherwise(main)
    page = filings.select(*keys, F.col(text).isNull().alias("_none"), page_text(body).alias("_page"))
    made = page.select(*keys, "_none", F.col("_page").isNull().alias("_lost"), T.clean_whitespace(T.without_preamble(F.col("_page"))).alias("text"))
    reason = F.when(F.col("_none"), "no text").when(F.col("_lost"), "no primary document").when(F.col("text") == "", "nothing to read")
    made = made.withColumn("reason", reason)
    return made.where("reason is null").select(*keys, "text"), made.where("reason is not null").select(*keys, "reason")


def ingest(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, ticker, source, chunk_idx, text) of filings (ticker, source, text), and (ticker, source, reason) of those left out."""
    clean, failed = cleaned(filings, ["ticker", "source"], "text")
    cut = chunks(clean, ["ticker", "source"], "text").withColumnRenamed("chunk", "text")
    symbol = F.upper("ticker")
    return cut.select(T.chunk_id(symbol, F.col("chunk_idx")).alias("chunk_id"), symbol.alias("ticker"), F.coalesce("source", F.lit("")).alias("source"), "chunk_idx", "text"), failed
