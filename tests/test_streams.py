"""Ingestion batch by batch, call steps and timed memory as streams."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.operators import corpus as C
from siltstone.operators import tools as O
from siltstone.session import shared_dir
from siltstone.streaming import ingestion
from siltstone.streaming import threads as S

PAGE = "<html><p>Item: x</p><p>The company makes things and sells them to {} people.</p></html>"


def filings(spark, *rows):
    return spark.createDataFrame(rows, "ticker string, source string, text string")


def make(rows):
    return C.ingest(rows)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    held = ingestion.Ingested(spark, str(tmp_path / "in"))
    with pytest.raises(FileNotFoundError):
        held.read()
    first = filings(spark, ("aapl", "a", PAGE.format("many")), ("bad", "b", None))
    assert held.take(first, 0, make) and not held.take(first, 0, make)
    assert held.take(filings(spark, ("msft", "m", PAGE.format("other"))), 1, make)
    assert sorted(r.chunk_id for r in held.read().collect()) == ["AAPL_10K_chunk_0", "MSFT_10K_chunk_0"]
    assert [(r.ticker, r.reason) for r in held.read("quarantine").collect()] == [("bad", "no text")]
    asked = spark.createDataFrame([(1, "other"), (2, "company")], "query_id long, query_text string")
    assert held.index().statistics()["n_docs"] == 2 and len(held.index().state["segments"]) == 2
    assert [r.doc_id for r in held.index().top(asked.where("query_id = 1"), 5).collect()] in ([], ["MSFT_10K_chunk_0"])


def test_a_batch_that_stopped_before_its_index(spark, tmp_path):
    held = ingestion.Ingested(spark, str(tmp_path / "in"))
    rows = filings(spark, ("aapl", "a", PAGE.format("many")))
    held.take(rows, 0, make, index=False)
    assert not held.take(rows, 0, make) and held.index().statistics()["n_docs"] == 1

    def broken(rows):
        return rows.select(F.raise_error(F.lit("stop")).alias("chunk_id"), "text"), rows.select("ticker")

    with pytest.raises(Exception, match="stop"):
        held.take(rows, 1, broken)
    assert held.read().count() == 1 and held.take(filings(spark, ("amzn", "z", PAGE.format("some"))), 1, make)


def test_files_that_arrive(spark, tmp_path):
    folder, path = str(tmp_path / "arriving"), str(tmp_path / "in")
    filings(spark, ("aapl", "a", PAGE.format("many"))).coalesce(1).write.parquet(folder)
    assert ingestion.run(ingestion.arriving(spark, folder), path, make).read().count() == 1
    filings(spark, ("msft", "m", PAGE.format("other")), ("void", "v", " ")).coalesce(1).write.mode("append").parquet(folder)
    held = ingestion.run(ingestion.arriving(spark, folder), path, make)
    assert held.read().count() == 2 and held.read("quarantine").count() == 1 and held.index().statistics()["n_docs"] == 2
    assert ingestion.run(ingestion.arriving(spark, folder), path, make).versions.last() == 2  # nothing new


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=seconds)


def stream(spark, tmp_path, rows, schema, files=1):
    folder = str(tmp_path / "s")
    for own in rows:
        spark.createDataFrame(own, schema).coalesce(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_call_steps_follow_the_latest_end(spark, tmp_path):
    """The boundary too: a call that begins exactly at the end of the slack joins, one a millisecond later doesn't."""
    calls = [(1, at(0), 100.0), (1, at(0.010), 5.0), (1, at(0.150), 1.0), (1, at(0.202), 1.0), (2, at(1), 1000.25), (2, at(2.050), None), (2, at(2.101), 3.0), (9, at(9000), 1.0)]
    rows = stream(spark, tmp_path, [calls], "item_id long, start timestamp, ms double")
    got = sorted((r.item_id, r.n_calls) for r in S.run_once(S.call_steps(rows, "1 second"), f"steps_{tmp_path.name}_{id(tmp_path)}", event_time=True).collect())
    batch = spark.createDataFrame([(i, p, t.timestamp() * 1000, m or 0.0) for p, (i, t, m) in enumerate(calls)], "item_id long, pos long, start_ms double, ms double")
    want = O.steps(batch.where("item_id < 9")).groupBy("item_id", "step").count()
    assert got == sorted((r.item_id, r["count"]) for r in want.collect())


def test_timed_memory(spark, tmp_path):
    schema = "thread long, turn long, at timestamp, text string, admitted boolean"
    first = [(1, 1, at(0), "a", True), (1, 2, at(5), "b", False), (1, 3, at(9), "c", True), (2, 1, at(0), "x", True)]
    later = [(1, 4, at(15), "d", True), (1, 5, at(40), "e", True), (3, 1, at(100), "z", True)]
    rows = stream(spark, tmp_path, [first, later], schema)
    out = S.run_once(S.timed_memory(rows, ttl_seconds=10, limit=2, late="20 seconds"), f"timed_{tmp_path.name}_{id(tmp_path)}", event_time=True, timers=True)
    got = sorted(((r.thread, r.turn, r.kind, r.remembered) for r in out.collect()), key=str)
    turns = [(1, 1, "turn", 0), (1, 2, "turn", 1), (1, 3, "turn", 1), (1, 4, "turn", 2), (1, 5, "turn", 0), (2, 1, "turn", 0), (3, 1, "turn", 0)]
    assert got == sorted([*turns, (1, None, "expired", 1), (2, None, "expired", 1)], key=str)
    assert shared_dir(spark)


def test_a_table_in_a_folder_of_files_is_a_stream_too(spark, tmp_path):
    from siltstone.plans import streams

    rows = [(c, t, "user" if t % 2 else "bot", "x") for c in range(5) for t in range(9)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in streams.stream_thread_state(spark, str(tmp_path)).collect())
    assert got == [(c, t, min(t, 6)) for c in range(5) for t in range(9)]
    got = sorted(tuple(r) for r in streams.stream_thread_admission(spark, str(tmp_path)).collect())
    assert got == [(c, t, t // 2) for c in range(5) for t in range(9)]


def test_pages_arrive_in_files_of_a_bounded_size(spark, tmp_path, monkeypatch):
    from siltstone.plans import streams

    monkeypatch.setattr(streams, "FILE_PAGES", 10)
    pages = [(i, "u", f"<p>page {i}</p>") for i in range(75)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    held = streams._ingested(spark, str(tmp_path))
    assert len(held._state()["batches"]) == 2
    read = sorted(r.page_id for r in held.read("chunks").collect())
    assert read == [i for i in range(75) if i % 10 not in (3, 7)]
    assert {(r.page_id, r.reason) for r in held.read("quarantine").collect()} == {(i, "no text" if i % 10 == 3 else "nothing to read") for i in range(75) if i % 10 in (3, 7)}
    arrived = [p for p in (Path(shared_dir(spark).removeprefix("file://")) / "arriving").glob("*/*.parquet")]
    assert len(arrived) == 8 and all(spark.read.parquet(str(p)).count() <= 20 for p in arrived)
