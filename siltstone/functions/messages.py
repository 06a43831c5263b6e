"""Message, id and label strings as expressions: payload blocks, contexts, prompts, arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARG_CHARS, ARGS_CHARS = 200, 500


def observation_text(blocks: Column) -> Column:
    """A tool message's blocks (array of struct type, text) as one text: those with text, a line each."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"]), "\n")


def content_text(blocks: Column) -> Column:
    """An answer's blocks as one text: its text blocks, run together; none is empty."""
    text = F.filter(blocks, lambda b: b["type"] == "text")
    return F.coalesce(F.array_join(F.transform(text, lambda b: F.coalesce(b["text"], F.lit(""))), ""), F.lit(""))


def build_question(question: Column, ticker: Column) -> Column:
    """A question that names its company, where one is given."""
    return F.when(F.coalesce(ticker, F.lit("")) == "", question).otherwise(F.concat(question, F.lit(" (company: "), F.upper(ticker), F.lit(")")))


def chunk_idx_of(source: Column) -> Column:
    """The place that an id names: a chunk's number, 'fact ID' for a fact, else nothing."""
    last = lambda mark: F.element_at(F.split(source, mark), -1)
    return F.when(F.contains(source, F.lit("_chunk_")), last("_chunk_")).when(F.contains(source, F.lit("_fact_")), F.concat(F.lit("fact "), last("_fact_"))).otherwise("")


def thread_id(label: Column, conversation: Column) -> Column:
    """A thread id of a probe: anything but letters, digits, _ and - becomes _, 64 characters at most."""
    return F.left(F.regexp_replace(F.concat(F.lit("probe-"), label, F.lit("-"), conversation), r"[^\p{L}\p{N}_-]", "_"), F.lit(64))


def sanitized_thread(raw: Column) -> Column:
    """A client's thread id: ASCII only, 64 characters at most, padded with _ to 8."""
    kept = F.left(F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_"), F.lit(64))
    return F.when(F.length(kept) < 8, F.rpad(kept, 8, "_")).otherwise(kept)


def answer_words(answer: Column) -> Column:
    """An answer as it streams: each word with the white space after it."""
    return F.regexp_extract_all(answer, F.lit(r"\S+\s*"), F.lit(0))


def config_label(mode: Column, rerank: Column, fetch_k: Column, ticker_filter: Column) -> Column:
    """A configuration's short name."""
    return F.concat_ws("-", mode, F.when(rerank, F.concat(F.lit("rerank"), fetch_k.cast("string"))), F.when(ticker_filter != "none", F.concat(F.lit("ticker-"), ticker_filter)))


def config_phrase(mode: Column, rrf_k: Column, weights: tuple[Column, Column], rerank: Column, fetch_k: Column, ticker_filter: Column) -> Column:
    """What sets a configuration apart, in words: its mode, and what isn't the default; ``weights`` are dense and sparse."""
    hybrid, shown = mode == "hybrid", lambda x: F.format_string("%.1f", x.cast("double"))
    return F.concat_ws(
        ", ",
        mode,
        F.when(hybrid & (rrf_k != 60), F.concat(F.lit("rrf_k="), rrf_k.cast("string"))),
        F.when(hybrid & ((weights[0] != 1) | (weights[1] != 1)), F.concat(F.lit("w="), shown(weights[0]), F.lit("/"), shown(weights[1]))),
        F.when(rerank, F.concat(F.lit("rerank fetch="), fetch_k.cast("string"))).when((mode != "dense") & (fetch_k != 25), F.concat(F.lit("fetch="), fetch_k.cast("string"))),
        F.when(F.coalesce(ticker_filter, F.lit("none")) != "none", F.concat(F.lit("ticker="), ticker_filter)),
    )


def canonical_args(args: Column) -> Column:
    """A JSON text with the keys of its objects in order at every level, so that equal arguments are equal text; a number stays other than its digits as a string.

    What is no JSON, or repeats a key, stays as it is.
    """
    return F.coalesce(F.to_json(F.try_parse_json(args)), args)


def safe_args(args: Column) -> Column:
    """Arguments (map of strings) as bounded JSON: values cut at ARG_CHARS characters, and a whole over ARGS_CHARS replaced by its beginning."""
    cut = F.transform_values(args, lambda _, v: F.left(v, F.lit(ARG_CHARS)))
    whole = F.to_json(F.coalesce(cut, F.create_map().cast("map<string,string>")))
    return F.when(F.length(whole) <= ARGS_CHARS, whole).otherwise(F.to_json(F.create_map(F.lit("_truncated"), F.left(whole, F.lit(ARGS_CHARS)))))


def fingerprint(text: Column) -> Column:
    """A version of a prompt or a schema: the first 12 digits of its digest."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(text, 256), F.lit(12)))


def rendered(observations: Column) -> Column:
    """Observations (array of struct id, text) as prompt text."""
    return F.array_join(F.transform(observations, lambda o: F.concat(F.lit("["), o["id"], F.lit("] "), o["text"])), "\n\n")


def verification_prompt(question: Column, draft: Column, observations: Column, reasons: Column) -> Column:
    """What a structuring model is asked: question, draft, observations, and on a second attempt what failed (array of strings)."""
    first = F.concat(F.lit("Question: "), question, F.lit("\n\nDraft answer:\n"), draft, F.lit("\n\nObservations:\n"), rendered(observations))
    again = F.concat(F.lit("\n\nThe last record failed:\n"), F.array_join(F.transform(reasons, lambda r: F.concat(F.lit("- "), r)), "\n"))
    return F.concat(first, F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, again).otherwise(""))


def context(ticker: Column, label: Column, kind: Column, text: Column) -> Column:
    """A passage with where it comes from, as the reader of an answer has to see it."""
    head = F.when(kind == "calc", F.concat(F.lit("["), label, F.lit("] "))).otherwise(F.concat(F.lit("["), ticker, F.lit(" 10-K, "), label, F.lit("] ")))
    return F.concat(head, text)
