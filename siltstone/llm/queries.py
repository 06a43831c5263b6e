"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, filter_audit, language, licenses, line_dedup, mixing, neighbours, ngram_join, packing, secrets, simhash_tiles, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language": language.op4_language,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_licenses": licenses.op7_licenses,
    "op8_packing": packing.op8_packing,
    "op9_secrets": secrets.op9_secrets,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_alignment": alignment.op11_alignment,
    "op12_simhash": simhash_tiles.op12_simhash,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
