"""Ranking passages: BM25, dense vectors, reciprocal rank fusion, filters, a pluggable reranker. Queries come in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.inverted import TermIndex
from siltstone.operators.nearest import nearest
from siltstone.session import shared_dir, stored

FEW_RANKED = 1_000_000


@dataclass(frozen=True)
class RetrievalConfig:
    """How to rank. Modes: dense, bm25, hybrid."""

    mode: str = "dense"
    k: int = 5
    fetch_k: int = 25
    rrf_k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    rerank: bool = False
    ticker_filter: str = "none"

    def __post_init__(self) -> None:
        if self.mode not in ("dense", "bm25", "hybrid"):
            raise ValueError(f"mode {self.mode!r} is none of dense, bm25, hybrid")
        if self.ticker_filter not in ("none", "inferred", "oracle"):
            raise ValueError(f"ticker_filter {self.ticker_filter!r} is none of none, inferred, oracle")

    def depth(self, k: int | None = None) -> int:
        """Candidates to fetch: k alone for plain dense ranking. A k of 0 or None is the default."""
        k = k or self.k
        return k if self.mode == "dense" and not self.rerank else max(self.fetch_k, k)

    def as_dict(self) -> dict:
        return asdict(self)


def top(scored: DataFrame, k: int, by: list[Column], within: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each query, numbered from 1. Spark prunes to k per task before it shuffles."""
    rank = F.row_number().over(W.partitionBy(within).orderBy(*by))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, dl, terms): the number of tokens and the tokens of each document."""
    found = T.tokens(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("terms")).withColumn("dl", F.size("terms").cast("long"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df); partial counts by term leave each task, not postings."""
    return counts.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, id_col: str, text_col: str) -> DataFrame:
    """(query_id, doc_id, score) of all pairs with a positive score, over an index made for the occasion."""
    return indexed(docs, id_col, text_col).scores(queries, query_id, query_text)


def indexed(docs: DataFrame, id_col: str, text_col: str) -> TermIndex:
    """An index of ``docs`` in a folder of its own."""
    spark = docs.sparkSession
    return TermIndex.open(spark, f"{shared_dir(spark)}/bm25/{uuid.uuid4().hex}").put(docs, id_col, text_col, by_term=False)


def bm25_top(queries: DataFrame, docs: DataFrame | TermIndex, k: int, query_id: str, query_text: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) over documents or their index: ties go to the smaller id."""
    index = docs if isinstance(docs, TermIndex) else indexed(docs, id_col, text_col)
    return index.top(queries, k, query_id, query_text)


def with_texts(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked rows (doc_id, ...) with their documents; these are read once and stay where they are unless there are many ranked rows."""
    ranked = stored(ranked, "ranked")
    return docs.join(F.broadcast(ranked) if ranked.count() <= FEW_RANKED else ranked, "doc_id")


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` nearest of each query by exact score, itself left out; scores are rounded to 6 places only to be shown."""
    found = nearest(queries, vectors, k, id_col, vector_col, id_col=id_col, vector_col=vector_col, others=True)
    return found.withColumn("score", F.round("score", 6))


def fuse(lists: list[tuple[DataFrame, float]], rrf_k: int = 60) -> DataFrame:
    """(query_id, doc_id, score, first_seen): weighted reciprocal rank fusion of ranked lists, first list first, however deep they are."""
    tagged = None
    for i, (ranked, weight) in enumerate(lists):
        part = F.lit(float(weight)) / (F.lit(rrf_k) + F.col("rank"))
        one = ranked.select("query_id", "doc_id", part.alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("rank")).alias("seen"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("first_seen"))


def fuse_top(lists: list[tuple[DataFrame, float]], k: int, rrf_k: int = 60) -> DataFrame:
    """Best by fused score, ties by first appearance."""
    return top(fuse(lists, rrf_k), k, [F.desc("score"), F.asc("first_seen")]).select("query_id", "rank", "doc_id", "score")


Scorer = Callable[[DataFrame], DataFrame]


def overlap_scorer(query_col: str = "query_text", text_col: str = "text") -> Scorer:
    """A deterministic lexical scorer: the share of a query's distinct tokens that the passage has."""

    def score(pairs: DataFrame) -> DataFrame:
        asked = F.array_distinct(T.tokens(F.col(query_col)))
        shared = F.size(F.array_intersect(asked, T.tokens(F.col(text_col))))
        return pairs.withColumn("rerank_score", F.round(shared / F.greatest(F.size(asked), F.lit(1)), 6))

    return score


def rerank(candidates: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """The ``k`` best by a scorer, which adds rerank_score; ties keep their order."""
    ranked = scorer(candidates.withColumnRenamed("rank", "prior"))
    return top(ranked, k, [F.desc("rerank_score"), F.asc("prior")])


def retrieve(
    queries: DataFrame, docs: DataFrame, config: RetrievalConfig, vectors: DataFrame | None = None, scorer: Scorer | None = None, k: int | None = None,
    query_id: str = "query_id", query_text: str = "query_text", id_col: str = "doc_id", text_col: str = "text", ticker_col: str = "ticker", index: TermIndex | None = None, index_ticker: Column | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, ticker, text): the passages of each question by a configuration.

    queries: (query_id, query_text[, ticker][, vector]); docs: (doc_id, text[, ticker]); vectors: (doc_id, vector), needed by dense
    and hybrid ranking. A question's own ticker always filters; with ``inferred`` the one company that its text names does, with
    ``oracle`` only its own. Filters act before dense ranking and after BM25 scoring, whose statistics cover the corpus. A ``k`` of 0 or None is the
    configuration's, and ``index`` the documents' term index where there is one; with ``index_ticker``, the ticker from the columns that this keeps, no document moves
    to be filtered. Reranking without a scorer is an error, as is dense ranking without vectors.
    """
    if config.rerank and scorer is None:
        raise ValueError("the configuration reranks, but there is no scorer")
    if config.mode != "bm25" and vectors is None:
        raise ValueError(f"{config.mode} ranking needs vectors")
    depth, k = config.depth(k), k or config.k
    own = F.upper(F.col(ticker_col)) if ticker_col in queries.columns else F.lit(None).cast("string")
    wanted = F.coalesce(own, T.single_company(F.col(query_text))) if config.ticker_filter == "inferred" else own
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("query_text"), wanted.alias("wanted"), *(["vector"] if config.mode != "bm25" else []))
    held = F.upper(F.col(ticker_col)) if ticker_col in docs.columns else F.lit("UNKNOWN")
    passages = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit("UNKNOWN")).alias("ticker"))
    lists = []
    if config.mode != "bm25":
        rows = vectors.select(F.col(id_col).alias("doc_id"), "vector").join(passages.select("doc_id", "ticker"), "doc_id")
        lists.append((nearest(asked, rows, depth, wanted="wanted", value_col="ticker"), config.dense_weight))
    if config.mode != "dense":
        index = index or indexed(passages, "doc_id", "text")
        if config.ticker_filter == "none" and ticker_col not in queries.columns:
            lists.append((index.top(asked, depth), config.sparse_weight))
        else:
            tickers = passages.select("doc_id", F.col("ticker").alias("value")) if index_ticker is None else F.coalesce(F.upper(index_ticker), F.lit("UNKNOWN"))
            lists.append((index.top(asked, depth, values=tickers, wanted="wanted"), config.sparse_weight))
    ranked = lists[0][0] if len(lists) == 1 else fuse_top(lists, depth, config.rrf_k)
    found = with_texts(ranked.select("query_id", "rank", "doc_id"), passages)
    if config.rerank:
        found = rerank(found.join(asked.select("query_id", "query_text"), "query_id"), scorer, k)
    return found.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "ticker", "text")


def answer_context(found: DataFrame) -> DataFrame:
    """(query_id, context): a question's passages numbered and headed, as a prompt shows them; a question without any has no row."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "ticker", F.lit(" "), F.col("doc_id").cast("string"), F.lit("\n"), T.snippet(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))  # k passages at most
    return found.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"))
