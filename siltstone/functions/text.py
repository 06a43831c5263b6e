"""Text expressions: normalising, tokens, predicates, ids, company names, chunk classes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters and digits, with decimal or thousands parts kept together.
TOKEN = r"[a-z0-9]+(?:[.,][0-9]+)*"
#: Company symbols and the words that name them in questions, fixed values, in order.
COMPANIES = {
    "AAPL": ("apple",),
    "MSFT": ("microsoft",),
    "GOOGL": ("alphabet", "google"),
    "AMZN": ("amazon", "aws"),
    "META": ("meta", "facebook", "instagram"),
}
CLASSES = ("prose", "numeric table", "escaped markup", "identifiers", "json / metadata", "short fragment")
#: Patterns that tell the classes apart, fixed values.
MARKUP = r"(?i)<\s*/?\s*(td|tr|div|span|p|table|font|br|html|body)\b|&lt;|&gt;|style=\""
JSON_LIKE = r"(?i)MetaLinks|\"instance\"\s*:|\"dts\"|\"report\"\s*:|\"nsuri\"|\"localname\"|\"presentation\"|\.xsd\b|_cal\.xml|_def\.xml|_lab\.xml|_pre\.xml"
IDENTIFIER = r"(?i)\b(us-gaap|dei|xbrli|srt|ecd|iso4217|xbrldi|xlink)[:_][A-Za-z]|\b[a-z]+:[A-Z][A-Za-z]+Member\b|\bC_[0-9a-f]{8}|\bF_[0-9a-f]{8}|http://fasb\.org|http://xbrl\."
SHORT_CHARS = 120


def normalize(text: Column) -> Column:
    """White space collapsed to single spaces, trimmed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def references(field: Column) -> Column:
    """Passages of a field that joins them by || or ;;, trimmed, blank ones left out."""
    parts = F.transform(F.split(F.coalesce(field, F.lit("")), r"\|\||;;"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def is_prose_line(line: Column) -> Column:
    """Over twenty characters, with a space, without a colon or a slash."""
    bare = F.trim(line)
    return (F.length(bare) > 20) & bare.contains(" ") & ~bare.contains(":") & ~bare.contains("/")


def without_preamble(text: Column) -> Column:
    """Lines from the first prose line on; all of them if there is none."""
    lines = F.split(text, "\n")
    marks = F.transform(lines, lambda x: is_prose_line(x))
    first = F.greatest(F.array_position(marks, True), F.lit(1)).cast("int")
    return F.array_join(F.slice(lines, first, F.size(lines)), "\n")


def clean_whitespace(text: Column) -> Column:
    """Hard spaces to spaces, blanks off both ends of each line, three or more newlines to two, trimmed."""
    out = F.replace(text, F.lit(" "), F.lit(" "))
    out = F.regexp_replace(out, r"(?m)^[ \t]+", "")
    out = F.regexp_replace(out, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_html(html: Column) -> Column:
    """Text of a page by patterns: scripts and styles go whole, then comments, then tags; entities of the basic five."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _any(text: Column, *parts: str) -> Column:
    """Whether a text holds one of some plain parts: told at a fraction of what a pattern costs."""
    out = text.contains(parts[0])
    for part in parts[1:]:
        out = out | text.contains(part)
    return out


def classify(text: Column) -> Column:
    """One of CLASSES, the first rule that holds. A pattern is only tried on texts with a part that each of its branches needs."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    low = F.lower(bare)
    long_words = F.regexp_count(bare, F.lit(r"\S{31,}"))
    letters = F.length(F.regexp_replace(bare, r"\P{L}+", ""))
    return (
        F.when(F.length(bare) < SHORT_CHARS, "short fragment")
        .when(_any(low, "<", "&lt;", "style=") & bare.rlike(MARKUP), "escaped markup")
        .when(_any(low, '"', "metalinks", ".xsd", ".xml") & bare.rlike(JSON_LIKE), "json / metadata")
        .when((_any(bare, ":", "_") & (F.regexp_count(bare, F.lit(IDENTIFIER)) >= 3)) | (long_words > 2), "identifiers")
        .when(letters / F.length(bare) < 0.4, "numeric table")
        .otherwise("prose")
    )


def companies(text: Column, names: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Symbols that a text names by symbol or by word, in table order."""
    named = [F.when(F.coalesce(text, F.lit("")).rlike(rf"(?i)\b(?:{'|'.join((symbol.lower(), *words))})\b"), F.lit(symbol)) for symbol, words in (names or COMPANIES).items()]
    return F.array_compact(F.array(*named))


def single_company(text: Column, names: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The one company named; null for none or several."""
    found = companies(text, names)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def chunk_id(symbol: Column, index: Column) -> Column:
    return F.concat(F.upper(symbol), F.lit("_10K_chunk_"), index.cast("string"))


CHUNK_ID = r"^([A-Z0-9.\-]+)_10K_chunk_(\d+)$"


def parse_chunk_id(cid: Column) -> Column:
    """struct(symbol, chunk_idx), null if the id isn't canonical."""
    return F.when(cid.rlike(CHUNK_ID), F.struct(F.regexp_extract(cid, CHUNK_ID, 1).alias("symbol"), F.regexp_extract(cid, CHUNK_ID, 2).cast("int").alias("chunk_idx")))


def snippet(text: Column, chars: int = 500) -> Column:
    return F.trim(F.regexp_replace(F.left(text, F.lit(chars)), "\n", " "))


def clip(text: Column, limit: int) -> Column:
    """Trimmed, and cut with an ellipsis if longer than ``limit``."""
    bare = F.trim(text)
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.rtrim(F.left(bare, F.lit(limit))), F.lit("…")))


def fixed_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Windows of ``size`` characters that repeat the last ``overlap``; none for an empty text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def terminal_state(answer: Column, marker: str) -> Column:
    """empty_answer, recursion_limit or null."""
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", "empty_answer").when(F.lower(answer).contains(marker.lower()), "recursion_limit")
