"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its words' character n-grams (1 to 4, with word boundaries), hashed into
BUCKETS rows. Embeddings and softmax are trained together by stochastic gradient descent in numpy on the driver, over
a bounded sample of labelled rows (SAMPLE_ROWS of them, whole; a parameter), in windows of random place and length. After training the two fold into
one table of class scores by bucket, so a text's scores are a sum over its words, and workers keep the sums of the words they have
seen. A temperature fitted on held-back rows of the sample calibrates the probability; below ``reject`` the answer is
``und``. Every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

UNKNOWN = "und"
BUCKETS, DIM, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
SAMPLE_ROWS = 4000
LETTER = regex.compile(r"\p{L}")


def _grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and the word of each."""
    cut, owner = words.pieces([f"<{w}>" for w in tokens])
    codes = words.matrix(cut).astype(np.uint64)
    ids, rows = [], []
    for n in GRAMS:
        h = np.full((len(cut), words.WIDTH - n + 1), 14695981039346656037 + n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[:, k : words.WIDTH - n + 1 + k]) * np.uint64(1099511628211)
        at = np.nonzero(codes[:, n - 1 :])
        ids.append(((h[at] >> np.uint64(24)) % np.uint64(BUCKETS)).astype(np.int64))
        rows.append(owner[at[0]])
    return np.concatenate(ids), np.concatenate(rows)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # class scores by bucket
    temperature: float

    def score_words(self, tokens: list[str]) -> np.ndarray:
        """Class scores of each word's n-grams, summed, and their number."""
        ids, rows = _grams(tokens)
        out = np.zeros((len(tokens), len(self.labels) + 1), dtype=np.float32)
        for c in range(len(self.labels)):
            out[:, c] = np.bincount(rows, self.table[ids, c], len(tokens))
        out[:, -1] = np.bincount(rows, minlength=len(tokens))
        return out

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = sums[:, :-1] / np.maximum(sums[:, -1:], 1) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 5, rate: float = 0.3, seed: int = 7) -> Model:
    """SGD with steps by gradient history, over windows of the texts, long and short, so that short texts are calibrated too."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels], dtype=np.int64)
    if not names:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), dtype=np.float32), 1.0)
    tokens = [t.lower().split() for t in texts]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, len(names)))
    emb_seen, out_seen = np.full((BUCKETS, DIM), 1e-8), np.full(out.shape, 1e-8)
    order = rng.permutation(len(texts))
    held = set(order[: max(1, len(order) // 8)].tolist()) if len(order) > 16 else set()

    def window(i: int) -> list[str]:
        n = int(2 ** rng.uniform(1, 9))
        a = int(rng.integers(0, max(1, len(tokens[i]) - n + 1)))
        return tokens[i][a : a + n]

    def batch(rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spans = [window(i) for i in rows]
        ids, owner = _grams([w for s in spans for w in s] or [""])
        of = np.repeat(np.arange(len(spans)), [len(s) for s in spans]) if any(spans) else np.zeros(1, dtype=np.int64)
        at = of[owner]
        pair, n = np.unique(at * BUCKETS + ids, return_counts=True)
        at, ids = pair // BUCKETS, pair % BUCKETS
        share = n / np.maximum(np.bincount(at, n, len(spans)), 1)[at]
        return ids, at, share

    def mean(ids: np.ndarray, at: np.ndarray, share: np.ndarray, rows: int) -> np.ndarray:
        x = emb[ids] * share[:, None]
        return np.stack([np.bincount(at, x[:, d], rows) for d in range(DIM)], axis=1)

    steps = [i for i in order.tolist() if i not in held]
    for epoch in range(epochs):
        rng.shuffle(steps)
        step = rate * (1 - epoch / epochs)
        for a in range(0, len(steps), 32):
            rows = steps[a : a + 32]
            ids, at, share = batch(rows)
            x = mean(ids, at, share, len(rows))
            z = x @ out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ out.T
            grad = x.T @ p / len(rows)
            out_seen += grad**2
            out -= step * grad / np.sqrt(out_seen)
            touched, where = np.unique(ids, return_inverse=True)
            each = back[at] * share[:, None]
            grad = np.stack([np.bincount(where, each[:, d], len(touched)) for d in range(DIM)], axis=1) / len(rows)
            emb_seen[touched] += grad**2
            emb[touched] -= step * grad / np.sqrt(emb_seen[touched])
    model = Model(names, (emb @ out).astype(np.float32), 1.0)
    if held:
        rows = sorted(held)
        ids, at, share = batch(rows)
        z = mean(ids, at, share, len(rows)) @ out

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(rows)), y[rows]] - np.log(np.exp(s).sum(axis=1))).mean())

        model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def sample(docs: DataFrame, where: Column, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """Whole texts and labels of about ``rows`` labelled rows, by a hash of the id."""
    labelled = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = rows / max(1, labelled.count())
    picked = labelled.where(common.share_below(share, "language", F.col(id_col)))
    got = picked.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).collect()
    got.sort()
    return [r["text"] for r in got], [r["lang"] for r in got]


def _predict(batches: Iterator[pa.RecordBatch], model: Model, reject: float) -> Iterator[pa.RecordBatch]:
    cache = words.Cache(model.score_words, len(model.labels) + 1)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        known = [t is not None and LETTER.search(t) is not None for t in texts]
        tokens = [t.lower().split() if k else [] for t, k in zip(texts, known, strict=True)]
        flat = [w for t in tokens for w in t]
        sums = np.zeros((len(texts), len(model.labels) + 1))
        if flat:
            rows, at = cache(flat), np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
            for c in range(sums.shape[1]):
                sums[:, c] = np.bincount(at, rows[:, c], len(texts))
        p = model.probabilities(sums)
        best, top = p.argmax(axis=1), p.max(axis=1)
        said = [model.labels[b] if k and s >= reject else UNKNOWN for b, k, s in zip(best, known, top, strict=True)]
        score = [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, reject: float = 0.0) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score for each row.

    Null texts and texts without a letter are ``und`` with score 0, and so are texts scored under ``reject`` (with
    their score). Repeated rows give repeated answers; an empty table gives an empty result; texts of any length are read whole; ids stay as they are;
    other columns are ignored.
    """
    common.python_ready(docs.sparkSession)
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held.alias("held_out"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(common.in_arrow(lambda b: _predict(b, model, reject)), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(*sample(docs, ~held, "doc_id", "text", "lang"))
    return identify(docs, model, held_out=held)
