"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-copy group stays, sources are
mixed to their weights, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the columns of
documents, in their order, whatever else is among them. No stage can be expressed in SQL as a whole: tests/llm/test_pipeline.py holds each
against a brute-force version. All stages give no rows of an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, line_dedup, mixing, ngram_join, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the machine, trained on the labelled part of ``docs``, doesn't score toxic. Null and empty texts stay, repeated rows go or stay together.

    Without labels of both kinds nothing is toxic.
    """
    model = toxicity.fitted(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that repeat, exactly or nearly, an earlier one (by doc_id, then line); n_chars says how long the text is now.

    Rows that hold nothing but blank lines then go, unless they did so before; null texts stay, as do lines under three words and six characters. Rows that
    repeat id and text keep the same lines.
    """
    out = line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link by five-word shingles at a similarity of 0.8 the one with the smallest doc_id. Texts without words stay."""
    return ngram_join.without_near_copies(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, twice at most; rows without words once."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens, each with its ids and their crc32; an empty or null text is one piece, its separator."""
    return packing.pack(docs, packing.tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result stored before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
