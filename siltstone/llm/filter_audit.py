"""What five quality filters take away in every order that they can be applied in: each filter's own, shared and lost documents.

1. Arrow's text buffers are read as bytes, without a string per document: byte classes say what is space, capital, symbol or
   the start of a code point, and prefix sums of the classes, taken at the offsets of the texts, count them for each one.
2. Words are hashed in lanes of eight bytes. A document's hashes are sorted, equal neighbours are verified byte by byte, and
   what is left are its distinct words; a document whose hashes collide is counted again by its words.
3. Documents are then known by the filters that they fail. Equal texts meet by a digest: rows of one text are added up by
   part and labels before they do, so a text that a third of the table repeats is a few rows.
4. The failures of a part reduce to at most 32 counts, and these give all orders and steps.

Filters: A fewer than LEAST_WORDS words; B fewer than LEAST_DISTINCT percent of the words are distinct; C more than
MOST_CAPITALS percent of the code points are A to Z; D a symbol; E the text of a row with a smaller id, removed or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .ngram_join import mix

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LONG_WORD = 512  # bytes; longer words are hashed and compared one by one
U = np.uint64
_SPACE, _CAPITAL, _SYMBOL, _START = (np.zeros(256, bool) for _ in range(4))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL[0x41:0x5B] = True
_SYMBOL[list(SYMBOLS)] = True
_START[:] = (np.arange(256) & 0xC0) != 0x80


class Texts:
    """The texts of an Arrow column as one array of bytes, with where each one begins; null is empty."""

    def __init__(self, column: pa.Array) -> None:
        large = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = large.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[large.offset : large.offset + len(large) + 1] if offsets is not None else np.zeros(len(large) + 1, np.int64)
        held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.data, self.at = held, at - at[0]

    def counted(self, flags: np.ndarray) -> np.ndarray:
        """How many of ``flags``, one for each byte, every text has."""
        up = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
        return up[self.at[1:]] - up[self.at[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, text) of all words."""
        space = _SPACE[self.data]
        edge = np.zeros(len(space) + 1, bool)  # where a text begins or ends
        edge[self.at] = True
        begin = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
        end = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
        return begin, end, np.searchsorted(self.at, begin, side="right") - 1


def _lane(whole: np.ndarray, begin: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes from each ``begin``, those past a word's end (``left`` bytes are left) as zeros."""
    at, shift = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
    low = whole[at] >> shift
    high = (whole[at + 1] << U(1)) << (U(63) - shift)
    keep = U(0xFFFFFFFFFFFFFFFF) >> (U(64) - (np.minimum(left, 8) << 3).astype(np.uint64))
    return (low | high) & keep


def distinct_words(texts: Texts, begin: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Number of distinct words of each text."""
    data, n_texts = texts.data, len(texts.at) - 1
    if not len(begin):
        return np.zeros(n_texts, np.int64)
    whole = np.concatenate([data, np.zeros(16 + -len(data) % 8, np.uint8)]).view("<u8")
    size = end - begin
    hashes = mix(size.astype(np.uint64))
    long = np.flatnonzero(size > LONG_WORD)
    live = np.flatnonzero(size <= LONG_WORD)
    step = 0
    while len(live):
        hashes[live] = mix(hashes[live] * U(0x9E3779B97F4A7C15) ^ _lane(whole, begin[live] + step, size[live] - step))
        step += 8
        live = live[size[live] > step]
    for i in long.tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]])
    # the text's number takes the upper bits, so one sort orders all texts; what this leaves of a hash is verified like any other
    bits = U(max(1, int(n_texts - 1).bit_length()))
    keys = (of.astype(np.uint64) << (U(64) - bits)) | (hashes >> bits)
    order = np.argsort(keys)
    keys = keys[order]
    i, j = order[:-1], order[1:]
    same = keys[1:] == keys[:-1]
    at = np.flatnonzero(same)
    x, y = i[at], j[at]
    wrong = size[x] != size[y]
    live = np.flatnonzero(~wrong & (size[x] <= LONG_WORD))
    step = 0
    while len(live):
        a, b, left = x[live], y[live], size[x[live]] - step
        unlike = _lane(whole, begin[a] + step, left) != _lane(whole, begin[b] + step, left)
        wrong[live[unlike]] = True
        step += 8
        live = live[(left > 8) & ~unlike]
    for k in np.flatnonzero(~wrong & (size[x] > LONG_WORD)).tolist():
        wrong[k] = not np.array_equal(data[begin[x[k]] : end[x[k]]], data[begin[y[k]] : end[y[k]]])
    n_words = np.bincount(of, minlength=n_texts)
    n = n_words - np.bincount(of[x], minlength=n_texts)
    for t in np.unique(of[x[wrong]]).tolist():  # hashes that collide
        own = np.flatnonzero(of == t)
        n[t] = len({data[begin[w] : end[w]].tobytes() for w in own.tolist()})
    return n


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, high, low, fails): the digest of the text in two numbers, and which of A to D it fails, as bits."""
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = Texts(batch.column(2))
            begin, end, of = texts.words()
            n_words = np.bincount(of, minlength=len(batch)).astype(np.int64)
            distinct = distinct_words(texts, begin, end, of)
            capitals, symbols, points = (texts.counted(c[texts.data]) for c in (_CAPITAL, _SYMBOL, _START))
            failed = [n_words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n_words, 100 * capitals > MOST_CAPITALS * points, symbols > 0]
            fails = sum(f.astype(np.int32) << k for k, f in enumerate(failed))
            digests = b"".join(hashlib.sha256(texts.data[a:b]).digest()[:16] for a, b in zip(texts.at.tolist(), texts.at[1:].tolist(), strict=False))
            digest = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(fails)], names=["id", "part", "high", "low", "fails"])


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, n, good, toxic): documents of a part that fail just those filters (bits, A is 1), and how many of them are labelled.

    Rows count one by one, rows that repeat an id too: they answer to one id, so that none is the earlier text of the other.
    Rows without an id have no label and are no copy of any row. Null texts are empty texts, null parts the part ''. Of repeated
    labels the largest counts. An empty table gives an empty result; texts are read whole; other columns are ignored.
    """
    common.python_ready(docs.sparkSession)
    ident = F.col(f"`{id_col}`")
    rows = docs.select(ident.alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    seen = rows.mapInArrow(common.in_arrow(_scanned), f"id {id_type}, part string, high long, low long, fails int")
    seen = seen.groupBy("id", "part", "high", "low", "fails").agg(F.count("*").alias("n"))
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # rows without an id match no label, and are dealt out by their text
    spread = F.when(F.col("id").isNull(), F.col("high")).otherwise(0)
    known = seen.withColumn("spread", spread).join(label.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    good, toxic = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("quality", "toxic"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    met = known.groupBy("high", "low", "part", "fails", good.alias("good"), toxic.alias("toxic")).agg(F.sum("n").alias("n"), first, nameless)
    # a text's rows are few by now: one for each part and labels
    earliest = F.min(F.col("first")["id"]).over(W.partitionBy("high", "low"))
    kept = F.col("nameless") + F.when(F.col("first")["id"] == earliest, F.col("first")["n"]).otherwise(0)
    met = met.withColumn("once", kept)
    both = F.array(F.struct(F.col("fails").alias("fails"), F.col("once").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("once")).alias("n")))
    each = met.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return each.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(failed: DataFrame) -> DataFrame:
    """A row for each part, order and step, zeros included, of what failures() counts; see the module."""
    bit = lambda letter: F.lit(1 << FILTERS.index(letter))
    # where in an order the first filter that a document fails stands; 6 if it fails none
    first = F.least(F.lit(6), *[F.when(F.col("fails").bitwiseAND(bit(f)) > 0, F.instr("filter_order", f)).otherwise(6) for f in FILTERS])
    rows = failed.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("first", first)
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("own", F.expr(f"cast(shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1) as int)"))
    fails_own = F.col("fails").bitwiseAND(F.col("own")) > 0
    removed = F.col("first") == F.col("step")

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    share = F.when(fails_own, F.col("n") * F.lit(len(ORDERS)) / F.bit_count("fails")).otherwise(0).cast("long")  # each filter that it fails is first in as many orders
    return rows.groupBy("part", "filter_order", "step").agg(
        total(F.col("first") > F.col("step")).alias("kept"),
        total(removed).alias("removed"),
        total(fails_own & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
seen AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM words),
label AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM seen LEFT JOIN label USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
rows AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS now, translate(fails, before, '') <> fails AS earlier
  FROM failed, steps),
summed AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT now AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN now AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN now AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN now AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN now AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM rows GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""
