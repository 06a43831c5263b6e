"""Streams over the files of a table, run until what is there is done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.plans.catalog import query
from siltstone.plans.corpus import STRIP
from siltstone.plans.evaluation import STEPS
from siltstone.plans.retrieval import bm25_sql
from siltstone.session import place_of, shared_dir, table
from siltstone.streaming import ingestion
from siltstone.streaming import threads as S


@query("stream_thread_state", "SELECT conv_id, turn, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, 6) AS remembered FROM conversations")
def stream_thread_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.thread_memory(S.read_table(spark, sf_dir, "conversations"))
    return S.run_once(found, f"threads_{uuid.uuid4().hex}").select("conv_id", "turn", "remembered")


@query(
    "stream_tool_steps",
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR > ts THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g), z AS (SELECT user_id, session, count(*) AS n_calls, max(ts) AS last FROM s GROUP BY ALL)
SELECT user_id, session, n_calls FROM z WHERE last + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stream_tool_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gap, numbered by user: those that the watermark has closed."""
    found = S.run_once(S.tool_sessions(S.read_table(spark, sf_dir, "events")), f"steps_{uuid.uuid4().hex}", event_time=True)
    return found.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("start")).cast("long").alias("session"), "n_calls")


@query("stream_thread_admission", "SELECT conv_id, turn, least(coalesce(sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6)::BIGINT AS remembered FROM conversations")
def stream_thread_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that aren't admitted read a thread, and leave nothing in it."""
    turns = S.read_table(spark, sf_dir, "conversations").withColumn("admitted", F.col("role") == "user")
    return S.run_once(S.thread_memory(turns), f"admitted_{uuid.uuid4().hex}").select("conv_id", "turn", "remembered")


@query("stream_call_steps", f"WITH {STEPS}, z AS (SELECT item_id, step, min(start_ms) AS start_ms, max(start_ms + ms) + 50 AS stop_ms, count(*) AS n_calls FROM stepped GROUP BY ALL) SELECT item_id, step, n_calls FROM z WHERE stop_ms < (SELECT max(start_ms) FROM calls) - 86400000")
def stream_call_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of calls as sessions with a gap of each call's own: those that the watermark has closed, numbered by item."""
    events = S.read_table(spark, sf_dir, "events")
    calls = events.select(F.col("user_id").alias("item_id"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("start"), (F.col("value") * 36000).alias("ms"))
    found = S.run_once(S.call_steps(calls), f"calls_{uuid.uuid4().hex}", event_time=True)
    return found.select("item_id", F.row_number().over(W.partitionBy("item_id").orderBy("start")).cast("long").alias("step"), "n_calls")


TTL = 12 * 3600
_IDLE = f"""g AS (SELECT *, epoch_ms(ts) AS at_ms, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) <= {TTL * 1000} THEN 0 ELSE 1 END AS fresh, (event_type <> 'error')::INTEGER AS admitted FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS life FROM g),
r AS (SELECT *, least(coalesce(sum(admitted) OVER (PARTITION BY user_id, life ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6)::BIGINT AS remembered FROM s)"""


@query(
    "stream_timed_memory",
    f"""WITH {_IDLE}, l AS (SELECT user_id, max(at_ms) AS at_ms, max(life) AS life FROM r GROUP BY user_id)
SELECT user_id AS thread, event_id AS turn, 'turn' AS kind, remembered FROM r
UNION ALL SELECT l.user_id, NULL, 'expired', (SELECT least(sum(r.admitted), 6)::BIGINT FROM r WHERE r.user_id = l.user_id AND r.life = l.life) FROM l WHERE l.at_ms + {TTL * 1000} <= (SELECT max(at_ms) FROM r) - 86400000""",
)
def stream_timed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with a list of turns, an idle limit and timers: what each turn finds, and the threads that have expired by the watermark."""
    events = S.read_table(spark, sf_dir, "events")
    turns = events.select(F.col("user_id").alias("thread"), F.col("event_id").alias("turn"), F.col("ts").cast("timestamp").alias("at"), F.col("props").alias("text"), (F.col("event_type") != "error").alias("admitted"))
    return S.run_once(S.timed_memory(turns, TTL), f"timed_{uuid.uuid4().hex}", event_time=True, timers=True)


# ingestion

#: Pages, some of them without anything to read.
BAD = "CASE WHEN page_id % 10 = 3 THEN NULL WHEN page_id % 10 = 7 THEN '<p> </p>' ELSE html END"
CLEAN = f"clean AS (SELECT page_id, html IS NULL AS none, {STRIP} AS text FROM (SELECT page_id, {BAD} AS html FROM pages))"
PIECES = "pieces AS (SELECT page_id, i AS chunk_idx, page_id * 100000 + i AS chunk_id, substr(text, i * 462 + 1, 512) AS text FROM (SELECT page_id, text, unnest(range(0, greatest(0, ceil((length(text) - 512) / 462.0)::BIGINT) + 1)) AS i FROM clean WHERE length(text) > 0))"


def page_chunks(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, page_id, chunk_idx, text) of pages, and (page_id, reason) of those that give none."""
    clean = pages.select("page_id", F.col("html").isNull().alias("none"), T.strip_html(F.col("html")).alias("text"))
    reason = F.when(F.col("none"), "no text").when(F.col("text") == "", "nothing to read")
    cut = clean.where("not none and text <> ''").select("page_id", F.posexplode(T.fixed_chunks(F.col("text"))).alias("chunk_idx", "text"))
    cut = cut.select((F.col("page_id") * 100000 + F.col("chunk_idx")).alias("chunk_id"), "page_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "text")
    return cut, clean.select("page_id", reason.alias("reason")).where("reason is not null")


#: Pages in a file that arrives: a file is what a task reads, so it is bounded.
FILE_PAGES = 4000


def _ingested(spark: SparkSession, sf_dir: str) -> ingestion.Ingested:
    """The pages, as two batches of files that arrive one after the other; what has arrived before isn't ingested again."""
    path = place_of(spark, sf_dir, "pages", "ingested")
    held = ingestion.Ingested(spark, path)
    if held.versions.last() < 2:
        pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(BAD).alias("html"))
        files = max(1, -(-pages.count() // (2 * FILE_PAGES)))  # of each batch
        folder = f"{shared_dir(spark)}/arriving/{uuid.uuid4().hex}"
        pages.repartitionByRange(2 * files, "page_id").write.parquet(folder)
        held = ingestion.run(ingestion.arriving(spark, folder, files), path, page_chunks)
    return held


@query("ingest_chunks", f"WITH {CLEAN}, {PIECES} SELECT chunk_id, page_id, chunk_idx, text FROM pieces")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of pages that came in two batches."""
    return _ingested(spark, sf_dir).read("chunks")


@query("ingest_quarantine", f"WITH {CLEAN} SELECT page_id, CASE WHEN none THEN 'no text' ELSE 'nothing to read' END AS reason FROM clean WHERE none OR text = ''")
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).read("quarantine")


@query("ingest_search", f"WITH {CLEAN}, {PIECES}, d AS (SELECT chunk_id AS doc_id, text FROM pieces), {bm25_sql(docs='d', k=3)} SELECT query_id, rank, doc_id, score FROM ranked")
def ingest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to the index that the batches have left."""
    return _ingested(spark, sf_dir).index().top(table(spark, sf_dir, "benchmark"), 3, "item_id", "text")
