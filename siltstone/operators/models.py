"""Seams for models that work on batches: an encoder of texts, and a scorer of question and passage.

A model is given as a function that makes it, called once in each Python worker, and returns a function of whole batches; Spark
hands it Arrow batches cut to the size that it wants. projection() is a model without weights, for tests and as a baseline.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from siltstone.functions import text as T
from siltstone.session import on_workers

Encode = Callable[[np.ndarray], np.ndarray]
DIMS, BATCH = 64, 256


@lru_cache(maxsize=200_000)
def _place(token: str, dims: int, seed: str) -> tuple[int, int]:
    digest = hashlib.md5(f"{seed}{token}".encode(), usedforsecurity=False).hexdigest()
    return int(digest[:4], 16) % dims, 1 if digest[4] < "8" else -1


def projection(dims: int = DIMS, seed: str = "") -> Callable[[], Encode]:
    """A model that adds up a signed place for each token and scales the sum to length one; a text without tokens is zero."""

    def make() -> Encode:
        token = re.compile(T.TOKEN)

        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, text in zip(out, texts, strict=True):
                for t in token.findall((text or "").lower()):
                    at, sign = _place(t, dims, seed)
                    row[at] += sign
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return make


def encoded(rows: DataFrame, text: str, model: Callable[[], Encode], out: str = "vector", batch: int = BATCH) -> DataFrame:
    """``rows`` with a vector of each text; null is an empty text."""
    on_workers(rows.sparkSession)
    encode = predict_batch_udf(model, return_type=ArrayType(DoubleType()), batch_size=batch)
    return rows.withColumn(out, encode(F.coalesce(F.col(text), F.lit(""))))


def cosine_scorer(model: Callable[[], Encode], query_col: str = "query_text", text_col: str = "text", batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A scorer for rerank(): the inner product of what an encoder makes of the question and of the passage, in one call for both."""

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        encode = model()

        def score(asked: np.ndarray, texts: np.ndarray) -> np.ndarray:
            names, place = np.unique(asked.astype(str), return_inverse=True)  # a question stands beside each of its candidates
            return np.round((encode(names)[place] * encode(texts)).sum(axis=1), 6)

        return score

    def score(pairs: DataFrame) -> DataFrame:
        on_workers(pairs.sparkSession)
        udf = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch)
        whole = lambda c: F.coalesce(F.col(c), F.lit(""))
        return pairs.withColumn("rerank_score", udf(whole(query_col), whole(text_col)))

    return score


