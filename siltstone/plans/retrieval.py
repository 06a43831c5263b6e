"""Queries over passages: BM25, dense, fusion, rerank, labels, rank metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import inverted, models, passages
from siltstone.operators import metrics as M
from siltstone.operators import retrieval as R
from siltstone.operators.nearest import nearest
from siltstone.plans.catalog import query
from siltstone.session import place_of, shared_dir, table

TOK = "[a-z0-9]+(?:[.,][0-9]+)*"


def bm25_sql(docs: str = "documents", queries: str = "benchmark", where: str = "", k: int = 5, doc_text: str = "text", prefix: str = "") -> str:
    """CTEs up to ``ranked`` (query_id, rank, doc_id, score)."""
    return f"""
{prefix}tk AS (SELECT doc_id, unnest(regexp_extract_all(lower({doc_text}), '{TOK}')) AS term FROM {docs}),
{prefix}tf AS (SELECT doc_id, term, count(*) AS f FROM {prefix}tk GROUP BY ALL),
{prefix}dl AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM {docs} d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {prefix}tk GROUP BY ALL) x USING (doc_id)),
{prefix}st AS (SELECT count(*) AS n_docs, avg(n) AS avgdl FROM {prefix}dl),
{prefix}idf0 AS (SELECT term, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {prefix}tf, {prefix}st GROUP BY term, n_docs),
{prefix}idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {prefix}idf0) ELSE raw END AS idf FROM {prefix}idf0),
{prefix}q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM {queries}) GROUP BY ALL),
{prefix}sc AS (SELECT query_id, doc_id, round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl.n / avgdl))), 6) AS score
  FROM {prefix}q JOIN {prefix}tf USING (term) JOIN {prefix}idf USING (term) JOIN {prefix}dl AS dl USING (doc_id), {prefix}st GROUP BY ALL),
{prefix}ranked AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {prefix}sc {where} {'AND' if where else 'WHERE'} score > 0) WHERE rank <= {k})"""


NORM = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
LOCATED = f"""
loc0 AS (SELECT b.item_id, d.doc_id, contains({NORM.format('d.text')}, {NORM.format('b.text')}) AS exact, length({NORM.format('b.text')}) >= 20 AS long
  FROM benchmark b, documents d WHERE {NORM.format('b.text')} <> '' AND contains({NORM.format('d.text')}, left({NORM.format('b.text')}, 60))),
loc1 AS (SELECT *, max(exact) OVER (PARTITION BY item_id) AS any_exact FROM loc0),
located AS (SELECT item_id, doc_id, CASE WHEN exact THEN 'exact' ELSE 'prefix' END AS method FROM loc1 WHERE exact OR (NOT any_exact AND long))"""


def index(spark: SparkSession, sf_dir: str) -> inverted.TermIndex:
    """The documents' stored term index, with their language and source: built at its first use, read from then on."""
    docs = table(spark, sf_dir, "documents")
    return inverted.load_or_build(spark, place_of(spark, sf_dir, "documents", "terms"), docs, docs.count(), keep=["lang", "source"])


def _bm25(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return R.bm25_top(table(spark, sf_dir, "benchmark"), index(spark, sf_dir), k, "item_id", "text")


@query("bm25_topk", f"WITH {bm25_sql()} SELECT * FROM ranked")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@query("bm25_index_in_batches", f"WITH {bm25_sql()} SELECT * FROM ranked")
def bm25_index_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a corpus that came in batches: a first one with some texts cut short and some documents that don't belong, a second that
    replaces and adds, a deletion. Its answers are those of an index of the documents as they are."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    early = docs.where(n % 3 != 1).select("doc_id", F.when(n % 3 == 2, F.left("text", F.lit(200))).otherwise(F.col("text")).alias("text"))
    alien = docs.where(n % 7 == 0).select((-1 - n).alias("doc_id"), "text")
    made = inverted.TermIndex.open(spark, f"{shared_dir(spark)}/bm25/{uuid.uuid4().hex}").put(early.unionByName(alien))
    made = made.put(docs.where(n % 3 != 0)).delete(alien)
    return made.top(table(spark, sf_dir, "benchmark"), 5, "item_id", "text", prune_from=0)


@query("bm25_filtered", f"WITH {bm25_sql(where='JOIN documents USING (doc_id) WHERE lang = $$en$$'.replace('$$', chr(39)))} SELECT * FROM ranked")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter acts after scoring: corpus statistics stay those of all documents."""
    asked = table(spark, sf_dir, "benchmark").withColumn("own", F.lit("en"))
    return index(spark, sf_dir).top(asked, 5, "item_id", "text", values=F.col("own_lang"), wanted="own")


@query(
    "compare_topk",
    f"WITH {bm25_sql(k=1_000_000)} SELECT query_id, source, rank, doc_id, score FROM (SELECT query_id, source, doc_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM ranked JOIN documents USING (doc_id)) WHERE rank <= 2",
)
def compare_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each source for each question."""
    return index(spark, sf_dir).top(table(spark, sf_dir, "benchmark"), 2, "item_id", "text", values=F.col("own_source")).withColumnRenamed("value", "source")


@query("bm25_corpus_stats", f"WITH {bm25_sql()} SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf0) AS n_terms, (SELECT round(avg(raw), 6) FROM idf0) AS mean_idf FROM st")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    totals = counts.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = R.document_frequencies(counts).crossJoin(F.broadcast(totals))
    return terms.groupBy("n_docs", "avgdl").agg(F.count("*").alias("n_terms"), F.round(F.avg(raw), 6).alias("mean_idf")).withColumn("avgdl", F.round("avgdl", 6))


@query("term_df", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_frequencies(R.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("doc_length", f"SELECT doc_id, len(regexp_extract_all(lower(text), '{TOK}'))::BIGINT AS dl FROM documents")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "dl")


@query("tokenize_terms", f"SELECT doc_id, regexp_extract_all(lower(text), '{TOK}') AS terms FROM documents")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("terms"))


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
DENSE = f"""
dsc AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, b.label, {DOT.format('a.embedding', 'b.embedding')} AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
dranked AS (SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsc) WHERE rank <= {{k}})"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set (ids divisible by 100) and all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.where("vec_id % 100 = 0"), vectors


@query("dense_topk", f"WITH {DENSE.format(k=10)} SELECT * FROM dranked")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_top(*_vectors(spark, sf_dir), 10, "vec_id", "embedding")


@query("dense_filtered", f"WITH {DENSE.format(k=10)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dsc WHERE label = 3) WHERE rank <= 10")
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter goes into the scan, before any distance."""
    queries, vectors = _vectors(spark, sf_dir)
    return R.dense_top(queries, vectors.where("label = 3"), 10, "vec_id", "embedding")


L2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))"


@query(
    "dense_l2_equals_cosine",
    f"""WITH l2 AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {L2} AS distance, {DOT.format('a.embedding', 'b.embedding')} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), doc_id) AS by_l2, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS by_dot FROM l2)
SELECT query_id, list(doc_id ORDER BY by_l2) AS by_l2, list(doc_id ORDER BY by_l2) = (SELECT list(x.doc_id ORDER BY x.by_dot) FROM r x WHERE x.query_id = r.query_id AND x.by_dot <= 10) AS same FROM r WHERE by_l2 <= 10 GROUP BY query_id""",
)
def dense_l2_equals_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On unit vectors the order by distance is the order by inner product: both are ranked, the distance as a product with one component more."""
    queries, vectors = _vectors(spark, sf_dir)
    twice = lambda v: F.transform(v, lambda x: 2 * x.cast("double"))
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # -|q - v|^2 + |q|^2 = (2 q, -1) (v, |v|^2)
    q = queries.select(F.col("vec_id").alias("query_id"), F.concat(twice("embedding"), F.array(F.lit(-1.0))).alias("vector"))
    v = vectors.select(F.col("vec_id").alias("doc_id"), F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(norm("embedding"))).alias("vector"))
    ids = lambda found, name: found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    by_l2 = ids(nearest(q, v, 10, others=True), "by_l2")
    by_dot = ids(R.dense_top(queries, vectors, 10, "vec_id", "embedding"), "by_dot")
    return by_l2.join(by_dot, "query_id").select("query_id", "by_l2", (F.col("by_l2") == F.col("by_dot")).alias("same"))


@query("dense_blocks", f"WITH {DENSE.format(k=10)} SELECT * FROM dranked")
def dense_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as dense_topk by blocks of queries and shards of vectors, as for more queries than a task holds."""
    queries, vectors = _vectors(spark, sf_dir)
    found = nearest(queries, vectors, 10, "vec_id", "embedding", id_col="vec_id", vector_col="embedding", others=True, held=0, block=8, shard=200)
    return found.withColumn("score", F.round("score", 6))


#: Passages: documents, their language as a company, and the vector of the same id; questions name companies, and some have a company of their own.
PASSAGES = """p AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'AAPL' WHEN 'de' THEN 'MSFT' WHEN 'fr' THEN 'META' ELSE 'AMZN' END AS ticker FROM documents),
aq AS (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' Apple' WHEN 1 THEN ' in MICROSOFT filings' WHEN 2 THEN ' Apple or Microsoft' ELSE '' END AS text, CASE item_id % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'MSFT' END AS named, CASE WHEN item_id % 5 = 0 THEN 'META' END AS own FROM benchmark)"""
_DENSE_OF = f"""SELECT aq.item_id AS query_id, p.doc_id, {DOT.format('a.embedding', 'b.embedding')} AS score FROM aq JOIN embeddings a ON a.vec_id = aq.item_id JOIN p ON {{fits}} JOIN embeddings b ON b.vec_id = p.doc_id"""
_SPARSE_OF = "SELECT sc.query_id, sc.doc_id, sc.score FROM sc JOIN aq ON aq.item_id = sc.query_id JOIN p ON p.doc_id = sc.doc_id WHERE sc.score > 0 AND {fits}"
NO_FILTER, OWN, INFERRED = "true", "(own IS NULL OR own = p.ticker)", "(coalesce(own, named) IS NULL OR coalesce(own, named) = p.ticker)"


def retrieve_sql(mode: str, k: int, fetch: int, fits: str = NO_FILTER, wa: float = 1, wb: float = 1, rrf_k: int = 60) -> str:
    """The rows (query_id, rank, doc_id) of a configuration, from its lists."""
    head = f"WITH {PASSAGES}, {bm25_sql(queries='aq', k=fetch)}, de AS ({_DENSE_OF.format(fits=fits)}), sp AS ({_SPARSE_OF.format(fits=fits)})"
    ranked = ", ".join(f"{n}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {n}) WHERE rank <= {fetch})" for n in ("de", "sp"))
    if mode != "hybrid":
        return f"{head}, {ranked}, found AS (SELECT query_id, rank, doc_id FROM {'de' if mode == 'dense' else 'sp'}_r WHERE rank <= {k})"
    return f"""{head}, {ranked}, fu AS (SELECT query_id, doc_id, {wa}::DOUBLE / ({rrf_k} + rank) AS part, rank AS seen FROM de_r UNION ALL SELECT query_id, doc_id, {wb}::DOUBLE / ({rrf_k} + rank), rank + 1000000 FROM sp_r),
su AS (SELECT query_id, doc_id, round(sum(part), 9) AS score, min(seen) AS first_seen FROM fu GROUP BY ALL), found AS (SELECT query_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM su) WHERE rank <= {k})"""


def _retrieved(spark: SparkSession, sf_dir: str, config: R.RetrievalConfig, scorer: R.Scorer | None = None) -> DataFrame:
    docs, items, vectors = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "embeddings"))
    symbol = lambda lang: F.when(F.col(lang) == "en", "AAPL").when(F.col(lang) == "de", "MSFT").when(F.col(lang) == "fr", "META").otherwise("AMZN")
    n = F.col("item_id")
    asked = items.select(n.alias("query_id"), F.concat("text", F.when(n % 4 == 0, " Apple").when(n % 4 == 1, " in MICROSOFT filings").when(n % 4 == 2, " Apple or Microsoft").otherwise("")).alias("query_text"), F.when(n % 5 == 0, "META").alias("ticker"))
    if config.ticker_filter == "none":
        asked = asked.drop("ticker")
    if config.mode != "bm25":
        asked = asked.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    passages, rows = docs.select("doc_id", "text", symbol("lang").alias("ticker")), vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.retrieve(asked, passages, config, rows, scorer, index=index(spark, sf_dir) if config.mode != "dense" else None, index_ticker=symbol("own_lang"))


FOUND = " SELECT query_id, rank, doc_id FROM found"


@query("retrieve_dense", retrieve_sql("dense", 5, 5) + FOUND)
def retrieve_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig()).select("query_id", "rank", "doc_id")


@query("retrieve_bm25", retrieve_sql("bm25", 5, 25) + FOUND)
def retrieve_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig(mode="bm25")).select("query_id", "rank", "doc_id")


@query("retrieve_hybrid", retrieve_sql("hybrid", 5, 25) + FOUND)
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig(mode="hybrid")).select("query_id", "rank", "doc_id")


@query("retrieve_filtered", retrieve_sql("hybrid", 5, 25, INFERRED) + FOUND)
def retrieve_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's own company, else the one that its text names, filters both lists."""
    return _retrieved(spark, sf_dir, R.RetrievalConfig(mode="hybrid", ticker_filter="inferred")).select("query_id", "rank", "doc_id")


@query("retrieve_oracle_filter", retrieve_sql("dense", 5, 5, OWN) + FOUND)
def retrieve_oracle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig(ticker_filter="oracle")).select("query_id", "rank", "doc_id")


@query(
    "retrieve_reranked",
    retrieve_sql("hybrid", 25, 25)
    + f""", rc AS (SELECT f.query_id, f.doc_id, f.rank AS prior, list_distinct(regexp_extract_all(lower(aq.text), '{TOK}')) AS asked, regexp_extract_all(lower(p.text), '{TOK}') AS had FROM found f JOIN aq ON aq.item_id = f.query_id JOIN p USING (doc_id)),
rs AS (SELECT query_id, doc_id, prior, round(len(list_intersect(asked, had))::DOUBLE / greatest(len(asked), 1), 6) AS score FROM rc)
SELECT query_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM rs) WHERE rank <= 5""",
)
def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig(mode="hybrid", rerank=True), R.overlap_scorer()).select("query_id", "rank", "doc_id")


@query("answer_contexts", retrieve_sql("dense", 5, 5) + " SELECT query_id, string_agg('[' || rank || '] ' || ticker || ' ' || doc_id || chr(10) || trim(replace(left(text, 500), chr(10), ' ')), chr(10) || chr(10) ORDER BY rank) AS context FROM found JOIN p USING (doc_id) GROUP BY query_id")
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a single question is answered from: plain dense ranking, whatever is configured."""
    return R.answer_context(_retrieved(spark, sf_dir, R.RetrievalConfig()))


@query("search_snippets", retrieve_sql("hybrid", 5, 25, INFERRED) + " SELECT query_id, rank, ticker || '_10K_chunk_' || doc_id AS chunk_id, trim(replace(left(text, 500), chr(10), ' ')) AS snippet FROM found JOIN p USING (doc_id)")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _retrieved(spark, sf_dir, R.RetrievalConfig(mode="hybrid", ticker_filter="inferred"))
    return found.select("query_id", "rank", T.chunk_id(F.col("ticker"), F.col("doc_id")).alias("chunk_id"), T.snippet(F.col("text")).alias("snippet"))


def _rrf_sql(wa: float, wb: float, k: int) -> str:
    return retrieve_sql("hybrid", 5, 25, NO_FILTER, wa, wb, k) + FOUND


@query("hybrid_rrf", _rrf_sql(1, 1, 60))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig(mode="hybrid")).select("query_id", "rank", "doc_id")


@query("hybrid_rrf_weighted", _rrf_sql(2, 0.5, 60))
def hybrid_rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig(mode="hybrid", dense_weight=2.0, sparse_weight=0.5)).select("query_id", "rank", "doc_id")


@query("rrf_k20", _rrf_sql(1, 1, 20))
def rrf_k20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, R.RetrievalConfig(mode="hybrid", rrf_k=20)).select("query_id", "rank", "doc_id")


@query(
    "rerank_topk",
    f"""WITH {bm25_sql(k=25)},
c AS (SELECT r.query_id, r.doc_id, r.rank AS prior, list_distinct(regexp_extract_all(lower(b.text), '{TOK}')) AS asked, regexp_extract_all(lower(d.text), '{TOK}') AS had
  FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id)),
s AS (SELECT query_id, doc_id, prior, round(len(list_intersect(asked, had))::DOUBLE / greatest(len(asked), 1), 6) AS rerank_score FROM c)
SELECT query_id, rank, doc_id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior) AS rank FROM s) WHERE rank <= 5""",
)
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    candidates = R.with_texts(_bm25(spark, sf_dir, 25), docs.select("doc_id", "text")).join(queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")
    return R.rerank(candidates, R.overlap_scorer(), 5).select("query_id", "rank", "doc_id", "rerank_score")


HEX = "(instr('0123456789abcdef', substr(m, {0}, 1)) - 1)"
ENCODED = f"""et AS (SELECT kind, id, md5(t) AS m FROM (SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS t FROM documents UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '{TOK}')) FROM benchmark)),
ep AS (SELECT kind, id, ({HEX.format(3)} * 16 + {HEX.format(4)}) % 64 AS at_, sum(CASE WHEN {HEX.format(5)} < 8 THEN 1 ELSE -1 END)::DOUBLE AS v FROM et GROUP BY ALL),
en AS (SELECT kind, id, sqrt(sum(v * v)) AS norm FROM ep GROUP BY ALL),
ev AS (SELECT kind, id, at_, CASE WHEN norm > 0 THEN v / norm ELSE 0.0 END AS v FROM ep JOIN en USING (kind, id))"""


@query("encode_documents", f"WITH {ENCODED}, p AS (SELECT doc_id, unnest(range(64)) AS at_ FROM documents) SELECT doc_id, list(round(coalesce(v, 0.0), 6) ORDER BY p.at_) AS vector FROM p LEFT JOIN ev ON ev.kind = 'd' AND ev.id = p.doc_id AND ev.at_ = p.at_ GROUP BY doc_id")
def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of whole texts by an encoder that takes batches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.encoded(docs, "text", models.projection()).select("doc_id", F.transform("vector", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vector"))


@query(
    "rerank_encoded",
    f"""WITH {bm25_sql(k=25)}, {ENCODED}, c AS (SELECT r.query_id, r.doc_id, r.rank AS prior, round(coalesce(sum(a.v * b.v), 0), 6) AS score FROM ranked r LEFT JOIN ev a ON a.kind = 'q' AND a.id = r.query_id LEFT JOIN ev b ON b.kind = 'd' AND b.id = r.doc_id AND b.at_ = a.at_ GROUP BY ALL)
SELECT query_id, rank, doc_id, score AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM c) WHERE rank <= 5""",
)
def rerank_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates as rerank_topk, reranked by an encoder's inner products."""
    queries, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    candidates = R.with_texts(_bm25(spark, sf_dir, 25), docs.select("doc_id", "text")).join(queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")
    return R.rerank(candidates, models.cosine_scorer(models.projection()), 5).select("query_id", "rank", "doc_id", "rerank_score")


@query("locate_exact", f"WITH {LOCATED} SELECT item_id, doc_id FROM located WHERE method = 'exact'")
def locate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).where("method = 'exact'").select("item_id", "doc_id")


@query("locate_prefix", f"WITH {LOCATED} SELECT item_id, doc_id, method FROM located")
def locate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir)


@query("label_method", f"WITH {LOCATED} SELECT item_id, coalesce(max(method), 'none') AS method, count(doc_id) AS n_chunks FROM benchmark LEFT JOIN located USING (item_id) GROUP BY item_id")
def label_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id").join(_located(spark, sf_dir), "item_id", "left")
    return rows.groupBy("item_id").agg(F.coalesce(F.max("method"), F.lit("none")).alias("method"), F.count("doc_id").alias("n_chunks"))


@query("label_summary", f"WITH {LOCATED}, m AS (SELECT item_id, coalesce(max(method), 'none') AS method, count(doc_id) AS n FROM benchmark LEFT JOIN located USING (item_id) GROUP BY item_id) SELECT method, count(*) AS n_items, count(*) FILTER (n > 0) AS scorable, count(*) FILTER (n > 1) AS multi_chunk FROM m GROUP BY method")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_method(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n_items"), F.count_if(F.col("n_chunks") > 0).alias("scorable"), F.count_if(F.col("n_chunks") > 1).alias("multi_chunk"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.located(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text").withColumnRenamed("ref_id", "item_id")


def _item_sql(cte: str = "ranked") -> str:
    hits = ", ".join(f"max(CASE WHEN hit <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_{k}, round(avg(CASE WHEN hit <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS recall_{k}" for k in M.KS)
    return f"""
hits AS (SELECT l.item_id, l.method AS group_id, min(r.rank) AS hit FROM located l LEFT JOIN {cte} r ON r.query_id = l.item_id AND r.doc_id = l.doc_id GROUP BY ALL),
items AS (SELECT item_id, count(*) AS n_groups, min(hit)::BIGINT AS first_hit_rank, round(coalesce(1.0::DOUBLE / min(hit), 0), 4) AS mrr,
  round(sum(CASE WHEN hit <= 5 THEN 1.0::DOUBLE / log2(hit + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 4) AS ndcg_5, {hits} FROM hits GROUP BY item_id)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the BM25 lists against located passages; a passage's documents are one group."""
    ranked = _bm25(spark, sf_dir, 25).select(F.col("query_id").alias("item_id"), "doc_id", "rank")
    groups = _located(spark, sf_dir).withColumnRenamed("method", "group_id")
    return M.item_metrics(M.group_ranks(ranked, groups))


GATE = [("mrr", 0.01, True), ("recall_25", 0.99, True), ("hit_5", 0.0, True), ("ndcg_10", 0.1, True)]


@query(
    "retrieval_gate",
    f"WITH {bm25_sql(k=25)}, {LOCATED}, {_item_sql()}, a AS (SELECT avg(mrr) AS mrr, avg(recall_25) AS recall_25, avg(hit_5) AS hit_5 FROM items), v AS (SELECT 'mrr' AS metric, round(mrr, 4) AS value FROM a UNION ALL SELECT 'recall_25', round(recall_25, 4) FROM a UNION ALL SELECT 'hit_5', round(hit_5, 4) FROM a), "
    "t(metric, threshold) AS (VALUES ('mrr', 0.01::DOUBLE), ('recall_25', 0.99), ('hit_5', 0.0), ('ndcg_10', 0.1)) SELECT metric, value, threshold, coalesce(value >= threshold, false) AS passed FROM t LEFT JOIN v USING (metric)",
)
def retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration's metrics against the thresholds set for it; a metric that it hasn't measured fails."""
    means = M.mean_metrics(_items(spark, sf_dir))
    values = means.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mrr", "recall_25", "hit_5")])))
    return M.gate(values, spark.createDataFrame(GATE, "metric string, threshold double, higher_is_better boolean"))


MEANS = "count(*) AS n_items, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in M.METRICS)


@query("rank_metrics_item", f"WITH {bm25_sql(k=25)}, {LOCATED}, {_item_sql()} SELECT * FROM items")
def rank_metrics_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)


@query("rank_metrics_overall", f"WITH {bm25_sql(k=25)}, {LOCATED}, {_item_sql()} SELECT {MEANS} FROM items")
def rank_metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_metrics(_items(spark, sf_dir))


@query("rank_metrics_by_stratum", f"WITH {bm25_sql(k=25)}, {LOCATED}, {_item_sql()} SELECT CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS stratum, {MEANS} FROM items JOIN benchmark USING (item_id) GROUP BY 1")
def rank_metrics_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("stratum"))
    return M.mean_metrics(_items(spark, sf_dir).join(strata, "item_id"), ["stratum"])


#: Items of a benchmark with what they are about, and how long each took.
STRATA = {
    "question_type": ("CASE item_id % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'comparison' WHEN 2 THEN 'trend' ELSE 'other' END", ("lookup", "comparison", "trend", "other")),
    "requires_table": ("CASE WHEN item_id % 3 = 0 THEN 'True' ELSE 'False' END", ("True", "False")),
    "difficulty": ("CASE WHEN length(text) < 150 THEN 'easy' WHEN length(text) < 300 THEN 'medium' ELSE 'hard' END", ("easy", "medium", "hard")),
}
LATENCY = "(item_id * 37 % 101)::DOUBLE"
_BLOCKS = " UNION ALL ".join(
    [f"SELECT 'overall' AS block, 'all' AS stratum, {MEANS} FROM x"] + [f"SELECT '{c}', {c}, {MEANS} FROM x GROUP BY {c}" for c in STRATA]
)
_RANK = "list_sort(list(latency))[round_even({p} / 100.0 * (count(*) - 1), 0)::BIGINT + 1]"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = table(spark, sf_dir, "benchmark").select("item_id", *[F.expr(e).alias(c) for c, (e, _) in STRATA.items()], (F.col("item_id") * 37 % 101).cast("double").alias("latency_ms"))
    return _items(spark, sf_dir).join(about, "item_id")


@query("retrieval_aggregates", f"WITH {bm25_sql(k=25)}, {LOCATED}, {_item_sql()}, x AS (SELECT items.*, {', '.join(f'{e} AS {c}' for c, (e, _) in STRATA.items())} FROM items JOIN benchmark USING (item_id)) {_BLOCKS}")
def retrieval_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retrieval run's metrics overall, by question type, by whether a table is needed, and by difficulty."""
    return M.retrieval_blocks(_measured(spark, sf_dir), list(STRATA))


@query("retrieval_latency", f"WITH {LOCATED}, x AS (SELECT DISTINCT item_id, {LATENCY} AS latency FROM located) SELECT round({_RANK.format(p=50)}, 1) AS p50, round({_RANK.format(p=95)}, 1) AS p95, round(avg(latency), 1) AS mean FROM x")
def retrieval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long its questions took."""
    return M.retrieval_latency(_measured(spark, sf_dir))


@query("unlabelled_items", f"WITH {LOCATED} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM located)")
def unlabelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id").join(_located(spark, sf_dir), "item_id", "left_anti")


@query("context_block", f"WITH {bm25_sql(k=3)} SELECT query_id, string_agg('[' || rank || '] document ' || doc_id || chr(10) || trim(replace(left(text, 500), chr(10), ' ')), chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN documents USING (doc_id) GROUP BY query_id")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered passages with a header, k of them at most."""
    rows = R.with_texts(_bm25(spark, sf_dir, 3), table(spark, sf_dir, "documents").select("doc_id", "text"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] document "), F.col("doc_id").cast("string"), F.lit("\n"), T.snippet(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"))
