"""Operators on small tables of our own."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import facts as X
from siltstone.operators import metrics as M
from siltstone.operators import retrieval as R
from siltstone.operators import tools as O
from siltstone.operators import xbrl
from siltstone.sources import files
from siltstone.sources.versions import KeyedTable, read_table

COLUMNS = {"query_id": "q", "query_text": "text", "id_col": "doc_id", "text_col": "text"}


def test_bm25_filters_zero_scores_and_breaks_ties(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple pie"), (3, "banana bread"), (4, ""), (5, "cherry tart and cream"), (6, "plum")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "apple"), (8, "nothing here"), (9, None)], "q long, text string")
    got = [tuple(r) for r in R.bm25_top(asked, docs, 5, **COLUMNS).orderBy("query_id", "rank").select("query_id", "rank", "doc_id").collect()]
    assert got == [(7, 1, 1), (7, 2, 2)]


def test_fusion_prefers_the_first_list_on_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, doc_id string, rank long")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query_id long, doc_id string, rank long")
    got = [r.doc_id for r in R.fuse_top([(a, 1), (b, 1)], 3).orderBy("rank").collect()]
    assert got == ["y", "x", "z"]


def test_config_validates_and_a_k_of_zero_is_the_default():
    assert R.RetrievalConfig(mode="hybrid").depth() == 25 and R.RetrievalConfig().depth(0) == 5
    with pytest.raises(ValueError):
        R.RetrievalConfig(mode="magic")


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "z", 1)], "item_id long, doc_id string, rank long")
    groups = spark.createDataFrame([(1, 1, "a"), (1, 1, "c"), (1, 2, "d"), (2, 1, "q")], "item_id long, group_id long, doc_id string")
    got = {r.item_id: r for r in M.item_metrics(M.group_ranks(ranked, groups)).collect()}
    assert (got[1].mrr, got[1].hit_5, got[1].recall_5, got[1].first_hit_rank) == (0.3333, 1.0, 0.5, 3)
    assert (got[2].mrr, got[2].ndcg_5, got[2].recall_25, got[2].first_hit_rank) == (0.0, 0.0, 0.0, None)


def test_steps_follow_the_latest_end(spark):
    calls = spark.createDataFrame([(1, 0, "a", 0.0, 100.0), (1, 1, "b", 10.0, 5.0), (1, 2, "c", 150.0, 1.0), (1, 3, "d", 202.0, 1.0)], "item_id long, pos long, tool string, start_ms double, ms double")
    got = [r.step for r in O.steps(calls).orderBy("pos").collect()]
    assert got == [1, 1, 1, 2]


def test_resolution_and_lookup(spark):
    facts = spark.createDataFrame(
        [(1, "T", "us-gaap:Revenues", 5.0, "duration", 365, 2024, "", 0), (2, "T", "us-gaap:Revenues", 9.0, "duration", 90, 2024, "", 0), (3, "T", "us-gaap:Revenues", 2.0, "duration", 365, 2024, "srt:ProductOrServiceAxis=us-gaap:ServiceMember", 1),
         (4, "T", "us-gaap:NetIncomeLoss", 1.0, "duration", 365, 2024, "a=b:XMember", 1)],
        "id long, ticker string, concept string, value double, period_type string, days int, fiscal_year int, dims string, dim_count int",
    )
    filings = spark.createDataFrame([("T", 2024)], "ticker string, fiscal_year_focus int")
    asked = spark.createDataFrame([(1, "t", "total revenue", None, None), (2, "T", "revenue", None, "services"), (3, "T", "net income", None, None), (4, "T", "revenue", None, "product")], "request_id long, ticker string, concept string, fiscal_year int, segment string")
    got = {(r.request_id, r.id, r.fallback) for r in X.lookup(asked, X.resolve(asked, facts), facts, filings).collect()}
    assert got == {(1, 1, False), (2, 3, False), (3, 4, True)}  # the axis name never makes a segment match


def test_xbrl_facts_reads_every_order(spark, sf):
    from siltstone.plans import facts

    keys = [r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    got = sorted((r.filing, r.concept, r.value) for r in facts.xbrl_facts(spark, sf).collect() if r.concept.endswith("Revenues"))
    assert got == sorted((f"F{k}", "us-gaap:Revenues", 1000.0 * k) for k in keys)


def test_xbrl(spark):
    html = (
        '<html><xbrli:context id="c"><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>'
        '<xbrli:context id="i"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="x:SegAxis">x:CloudMember</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context>'
        '<xbrli:unit id="p"><xbrli:measure>iso4217:USD</xbrli:measure><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit><ix:nonNumeric name="dei:DocumentFiscalYearFocus">2023</ix:nonNumeric>'
        '<ix:nonFraction name="A" contextRef="c" unitRef="p" scale="6">(<b>1,5</b>00)</ix:nonFraction><ix:nonFraction name="A" contextRef="c" unitRef="p" scale="6">(1,500)</ix:nonFraction>'
        '<ix:nonFraction name="B" contextRef="i" unitRef="u9" format="ixt:fixed-zero">-</ix:nonFraction><ix:nonFraction name="C" contextRef="gone">5</ix:nonFraction></html>'
    )
    bad = '<xbrli:context id="c"><xbrli:period><xbrli:instant>2024</xbrli:instant></xbrli:period></xbrli:context><ix:nonFraction name="A" contextRef="c" scale="much">1</ix:nonFraction><ix:nonFraction name="B" contextRef="c">2</ix:nonFraction>'
    docs = spark.createDataFrame([("1", "T", 0, html), ("2", "T", 0, html), ("3", "E", 0, None), ("4", "T", 0, bad), (None, "N", 0, bad), ("5", "T", 1, html), ("5", "T", 0, html)], "filing string, ticker string, n int, html string")
    found = xbrl.extracted(docs, "filing", "ticker", "html", "n")
    facts = xbrl.facts(found)
    got = {(r.filing, r.concept): (r.value, r.unit, r.period_type, r.dims, r.days) for r in facts.collect()}
    two = {"A": (-1.5e9, "iso4217:USD/xbrli:shares", "duration", "", 365), "B": (0.0, "u9", "instant", "x:SegAxis=x:CloudMember", None)}
    one = {"B": (2.0, "", "instant", "", None)}
    assert got == {(f, c): v for f, held in {"1": two, "2": two, "5": two, "4": one, None: one}.items() for c, v in held.items()}
    assert facts.count() == len(got)  # neither of the two filings of a company loses a fact to the other
    filed = {r.filing: (r.ticker, r.fiscal_year_focus, r.period_end, r.n_facts, len(r.notes)) for r in xbrl.filings(found, facts).collect()}
    assert filed == {**dict.fromkeys("125", ("T", 2023, "2024-12-31", 2, 1)), "3": ("E", None, None, 0, 0), "4": ("T", None, None, 1, 0), None: ("N", None, None, 1, 0)}
    assert {(r.filing, r.reason) for r in xbrl.quarantine(found).collect()} == {("3", "document 0: no text"), ("4", "number 0 (A): scale 'much'"), (None, "number 0 (A): scale 'much'")}


def test_manifest_reuse(spark, tmp_path):
    built = []

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    path = str(tmp_path / "index")
    assert files.load_or_build(spark, path, 3, build(3)).count() == 3
    assert files.load_or_build(spark, path, 3, build(3)).count() == 3 and built == [3]
    with pytest.raises(ValueError, match="has 3 rows, 4 are expected"):
        files.load_or_build(spark, path, 4, build(3))
    assert files.load_or_build(spark, path, 3, build(3)).count() == 3 and built == [3, 3, 3]  # what went wrong wasn't kept


def test_upsert_and_caches(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(r, "chunk_id string, text string")
    files.upsert(spark, rows(("a", "1"), ("b", "1")), path, "chunk_id")
    files.upsert(spark, rows(("b", "2"), ("c", "2")), path, "chunk_id")
    got = files.upsert(spark, rows(("x", "")).limit(0), path, "chunk_id")
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    cache = str(tmp_path / "cache")
    assert files.read_cache(spark, cache, "id string, n long").count() == 0
    files.write_results(spark.createDataFrame([("q1", 3)], "id string, n long"), cache)
    (next((tmp_path / "cache").glob("data-*")) / "part-broken.json").write_text('{"id": "q2", "n": \n')
    assert [tuple(r) for r in files.read_cache(spark, cache, "id string, n long").collect()] == [("q1", 3)]
    made = files.index_chunks(spark.createDataFrame([("aapl", None, 0, "t")], "ticker string, source string, chunk_idx int, text string")).first()
    assert (made.chunk_id, made.ticker, made.source) == ("AAPL_10K_chunk_0", "AAPL", "")


def test_readers(spark, tmp_path):
    (tmp_path / "probe.json").write_text('{"conversations": [{"id": "c", "kind": "k", "turns": [{"question": "q", "ground_truth": "1", "depends_on_history": false}, {"question": "r", "depends_on_history": true}]}]}')
    assert [(r.conversation, r.turn, r.question, r.depends_on_history) for r in files.read_probe(spark, str(tmp_path / "probe.json")).collect()] == [("c", 0, "q", False), ("c", 1, "r", True)]
    (tmp_path / "gate.json").write_text('{"retrieval": {"configs": [{"label": "dense", "thresholds": {"mrr": 0.3}}]}, "judged": {"thresholds": {"faithfulness": 0.8}, "max_terminal_failures": 1}}')
    got = sorted(tuple(r) for r in files.read_gate(spark, str(tmp_path / "gate.json")).collect())
    assert got == [("dense", "mrr", 0.3, True), ("judged", "faithfulness", 0.8, True), ("judged", "terminal_failures", 1.0, False), ("judged", "unexplained_nan", 0.0, False)]
    (tmp_path / "labels.json").write_text('{"items": {"a": {"groups": [["x"]], "method": "exact"}}}')
    assert files.read_labels(spark, str(tmp_path / "labels.json"), "struct<groups:array<array<string>>,method:string>").first().label.method == "exact"
    for company, name, text in (("AAPL", "1", "old"), ("AAPL", "2", "caf\u00e9"), ("MSFT", "1", "new")):
        folder = tmp_path / "filings" / company
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.txt").write_bytes(text.encode("latin-1"))
    assert {r.ticker: r.text for r in files.newest_filings(spark, str(tmp_path / "filings")).collect()} == {"AAPL": "caf\u00e9", "MSFT": "new"}
    assert {r.text for r in files.read_texts(spark, str(tmp_path / "filings" / "MSFT")).collect()} == {"new"}
    (tmp_path / "run.json").write_text('{"result_kind": "retrieval", "run_id": "r", "benchmark_version": "v", "aggregates": {"mrr": 0.5}, "results": [{"id": "1"}]}')
    (tmp_path / "bad.json").write_text("{nonsense")
    runs = files.read_results(spark, str(tmp_path / "*.json"), "v")
    assert [r.run_id for r in runs.collect()] == ["r"] and files.records(runs).first().observations == []


def test_facts_are_stored_and_read(spark, tmp_path):
    facts = spark.createDataFrame([(1, "T", "c", 2024), (2, "U", "c", 2024)], "id long, ticker string, concept string, fiscal_year int")
    files.write_facts(facts, spark.createDataFrame([("T", 2024)], "ticker string, fiscal_year_focus int"), str(tmp_path / "facts"))
    held, filed = files.read_facts(spark, str(tmp_path / "facts"))
    assert held.where("ticker = 'U'").first().id == 2 and filed.count() == 1
    files.write_chunks(spark.createDataFrame([("T", 0, "x")], "ticker string, chunk_idx int, text string"), str(tmp_path / "chunks"))
    assert read_table(spark, str(tmp_path / "chunks")).count() == 1
    with pytest.raises(Exception, match="boom"):
        files.write_results(spark.range(1).selectExpr("cast(raise_error('boom') as string) as id"), str(tmp_path / "results"))
    assert files.read_cache(spark, str(tmp_path / "results"), "id string").collect() == []
    files.write_results(spark.createDataFrame([("q",)], "id string"), str(tmp_path / "results"))
    with pytest.raises(Exception, match="boom"):
        files.write_results(spark.range(1).selectExpr("cast(raise_error('boom') as string) as id"), str(tmp_path / "results"))
    assert len(files.read_cache(spark, str(tmp_path / "results"), "id string").collect()) == 1  # what was there stays


def test_only_the_buckets_of_new_rows_are_written(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k string, n long")
    held = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=16)
    held.put(rows(*[(f"k{i}", i) for i in range(100)]))
    before = held.versions.read()["at"]
    assert sorted(map(tuple, held.put(rows(("k5", 500), ("new", 1))).collect())) == sorted([(f"k{i}", i) for i in range(100) if i != 5] + [("k5", 500), ("new", 1)])
    after = held.versions.read()["at"]
    assert len(before) == 16 and 1 <= sum(after[b] != before[b] for b in before) <= 2
    wider = held.put(spark.createDataFrame([("k6", 6, "x")], "k string, n long, more string"))
    assert {r.k: r.more for r in wider.collect() if r.k in ("k6", "k7")} == {"k6": "x", "k7": None} and wider.count() == 101
    with pytest.raises(Exception, match="boom"):
        held.put(spark.range(1).selectExpr("'k1' as k", "cast(raise_error('boom') as bigint) as n"))
    assert held.read().count() == 101 and held.versions.vacuum() >= 0 and held.read().count() == 101


def test_redundant_calls_and_conformity(spark):
    calls = spark.createDataFrame([(1, 0, "a", '{"a":1,"b":2}', 0.0), (1, 1, "a", '{"b":2, "a":1}', 1.0), (2, 0, "b", None, 0.0), (9, 0, "z", "{}", 0.0)], "item_id long, pos long, tool string, args string, start_ms double")
    assert {r.item_id: r.redundant_calls for r in O.redundant(calls).collect()} == {1: 1, 9: 0}
    labels = spark.createDataFrame([(1, ["a"], ["a"], ["a"]), (3, ["a"], ["a"], ["a"])], "item_id long, allowed array<string>, required array<string>, first_ok array<string>")
    got = {r.item_id: (r.tool_set_ok, r.first_tool_ok, r.missing) for r in O.conformity(calls, labels).collect()}
    assert got == {1: (True, True, []), 3: (False, None, ["a"])}


def test_labels_of_items(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 8)], "item_id long")
    refs = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (4, 0), (5, 0), (6, 0)], "item_id long, ref_pos int")
    found = spark.createDataFrame([(1, 0, 10, "exact"), (1, 0, 11, "exact"), (1, 1, 12, "exact"), (2, 0, 10, "prefix"), (3, 0, 10, "exact"), (5, 0, 1, "exact")], "item_id long, ref_pos int, doc_id long, method string")
    overrides = spark.createDataFrame([(5, [[7, 8]], None, "by hand"), (6, None, True, "gone")], "item_id long, groups array<array<long>>, unlocatable boolean, note string")
    got = {r.item_id: (r.groups, r.method, r.n_references, r.note) for r in M.label_items(items, refs, found, overrides).collect()}
    assert got == {1: ([[10, 11], [12]], "exact", 2, ""), 2: ([[10]], "prefix", 1, ""), 3: ([[10]], "partial", 2, ""), 4: ([], "none", 1, ""), 5: ([[7, 8]], "manual", 1, "by hand"), 6: ([], "unlocatable", 0, "gone"), 7: ([], "none", 0, "")}


def test_sources_of_an_answer(spark):
    from siltstone.operators import verify as V

    seen = spark.createDataFrame([(1, 0, "[1] ticker=aapl  chunk_idx=5\nsome text\n\n[2] ticker=AAPL  chunk_idx=5\nagain"), (1, 1, "[1] calc=ratio\nratio = 0.5"), (2, 0, "see ticker=msft chunk_idx=9, and ticker=msft chunk_idx=9 there")], "run long, seq long, text string")
    parsed = V.parse(seen, ["run", "seq"], "text")
    got = [tuple(r) for r in V.sources(seen, parsed, "run", ["seq", "pos"], "text").orderBy("run", "pos").collect()]
    assert got == [(1, 1, "AAPL", "AAPL_10K_chunk_5", "some text"), (2, 1, "MSFT", "MSFT_10K_chunk_9", "")]
    assert {r.run: r.contexts for r in V.contexts(parsed, "run", ["seq", "pos"]).collect()} == {1: ["[AAPL 10-K, chunk 5] some text", "[AAPL 10-K, chunk 5] again", "[calc_ratio] ratio = 0.5"]}
    assert V.by_id(parsed, "run", ["seq", "pos"]).where("id like 'AAPL%'").first().text == "some text\nagain"


def test_memory_admits_and_expires(spark):
    from siltstone.operators import memory as H

    rows = spark.createDataFrame([(1, "t", 0, "a", "verified"), (2, "t", 60, "b", "refused"), (3, "t", 120, " ", "verified"), (4, "t", 180, "c", "skipped"), (5, "t", 5000, "d", "verified"), (6, "t", 5001, "e", None)], "event_id long, thread string, at long, answer string, status string")
    rows = rows.withColumn("ts", F.timestamp_seconds("at"))
    got = H.remembered(rows, "thread", "ts", H.admitted(F.col("thread"), F.col("answer"), F.col("status")))
    assert [r.remembered for r in got.orderBy("event_id").collect()] == [0, 1, 1, 1, 0, 1]


def test_percentiles_over_ranges(spark):
    import numpy as np
    from siltstone.functions import numbers as N

    rng = np.random.default_rng(0)
    data = [("a", float(x)) for x in rng.normal(size=3000).round(3)] + [("a", 0.5)] * 4000 + [("b", 1.0), ("b", None), ("c", None)]
    rows = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in N.percentiles(rows, ["g"], "v", {"near": ("nearest", 37), "p99": ("linear", 99.5), "top": ("nearest", 100)}, 6).collect()}
    a = np.sort([v for g, v in data if g == "a"])
    assert (got["a"].near, got["a"].top) == (a[round(0.37 * (len(a) - 1))], a[-1]) and abs(got["a"].p99 - np.percentile(a, 99.5)) < 1e-6
    assert got["b"].near == got["b"].p99 == 1.0 and set(got) == {"a", "b"}


def test_benchmark_checks(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("id,ticker,question,ground_truth,reference_contexts\n1,T,q,g,r\n1,T,q,g,r\n")
    with pytest.raises(ValueError, match="repeats"):
        files.read_benchmark(spark, str(path))
    path.write_text("id,question\n1,q\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_benchmark(spark, str(path))


def test_retrieve_modes(spark):
    docs = spark.createDataFrame([(i, f"word{i} shared", "AAPL" if i % 2 else "MSFT") for i in range(6)], "doc_id long, text string, ticker string")
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "doc_id long, vector array<double>")
    asked = spark.createDataFrame([(1, "word3 microsoft", [0.0, 0.9, 0.8, 0.0, 0.7, 0.0])], "query_id long, query_text string, vector array<double>")
    ids = lambda config, **how: [r.doc_id for r in R.retrieve(asked, docs, config, vectors, **how).orderBy("rank").collect()]
    assert ids(R.RetrievalConfig(mode="bm25", k=2)) == [3]
    assert ids(R.RetrievalConfig(k=2)) == [1, 2]
    assert ids(R.RetrievalConfig(k=2, ticker_filter="inferred")) == [2, 4]
    assert ids(R.RetrievalConfig(mode="hybrid", k=2)) == [3, 1]  # in both lists
    assert ids(R.RetrievalConfig(mode="hybrid", k=3, ticker_filter="inferred"))[:2] == [2, 4]
    assert ids(R.RetrievalConfig(k=1, rerank=True, fetch_k=6), scorer=R.overlap_scorer()) == [3]
    with pytest.raises(ValueError, match="scorer"):
        R.retrieve(asked, docs, R.RetrievalConfig(rerank=True), vectors)
    with pytest.raises(ValueError, match="vectors"):
        R.retrieve(asked, docs, R.RetrievalConfig())
    own = asked.withColumn("ticker", F.lit("aapl"))
    assert [r.doc_id for r in R.retrieve(own, docs, R.RetrievalConfig(k=2, ticker_filter="inferred"), vectors).orderBy("rank").collect()] == [1, 3]


def test_phrase_lookup_says_what_it_did(spark):
    facts = spark.createDataFrame(
        [(1, "T", "us-gaap:Revenues", 5e6, "x", "USD", 0, "duration", "2024-01-01", "2024-12-31", 365, 2024, "", 0), (2, "T", "us-gaap:Revenues", 2.5e6, "2.5", "USD", 6, "duration", "2024-01-01", "2024-12-31", 365, 2024, "srt:ProductOrServiceAxis=us-gaap:ServiceMember", 1)],
        "id long, ticker string, concept string, value double, raw_text string, unit string, scale int, period_type string, period_start string, period_end string, days int, fiscal_year int, dims string, dim_count int",
    )
    asked = spark.createDataFrame([(1, "t", "services revenue", None, None), (2, "T", "gibberish", None, None), (3, "T", "revenue", 1999, None)], "request_id long, ticker string, concept string, fiscal_year int, segment string")
    rows, info = X.lookup_phrase(asked, facts, spark.createDataFrame([("T", 2024)], "ticker string, fiscal_year_focus int"))
    said = {r.request_id: r for r in info.collect()}
    assert (said[1].segment, said[1].fiscal_year, said[1].fiscal_year_defaulted, said[1].years_available, said[1].n_rows) == ("services", 2024, True, [2024], 1)
    assert (said[2].resolved_by, said[2].concepts, said[2].fiscal_year, said[3].n_rows, said[3].fiscal_year) == ("none", [], None, 0, 1999)
    text = {r.request_id: r.text for r in X.observations(rows, info, asked).collect()}
    assert "[1] ticker=T  fact_id=2\n    us-gaap:Revenues | FY2024 (2024-01-01 to 2024-12-31) | $2.5 million | ProductOrService=Service | tagged \"2.5\" x10^6 USD" in text[1]
    assert text[2].startswith("No XBRL concept matches 'gibberish' for T.") and "no annual value is tagged for fiscal year 1999. The filing covers fiscal years 2024." in text[3]


def test_values_as_people_write_them(spark):
    values = [(1.2e-05, "pure"), (0.25, "pure"), (1234567.0, "pure"), (12345.678, "kg"), (1234.4, "kg"), (0.0, "pure"), (99999.6, "kg"), (1e6, "USD"), (-2.5e6, "USD"), (999.5, "usd"), (3.14159, "USD/shares"), (1234.0, "shares")]
    got = [r.x for r in spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, v double, u string").orderBy("i").select(X.formatted_value(F.col("v"), F.col("u")).alias("x")).collect()]
    assert got == ["1.2e-05 (0.0%)", "0.25 (25.0%)", "1.23457e+06", "1.235e+04 kg", "1,234 kg", "0 (0.0%)", "1e+05 kg", "$1 million", "-$2.5 million", "$1,000", "$3.14 per share", "1,234 shares"]


def test_streams_of_served_answers_are_bounded(spark):
    from siltstone.functions import messages as S

    long = {"a": "x" * 300, "b": "y"}
    rows = spark.createDataFrame([(long,), ({str(i): "z" * 190 for i in range(5)},)], "m map<string,string>").select(S.safe_args(F.col("m")).alias("s"))
    first, second = (r.s for r in rows.collect())
    assert first == '{"a":"' + "x" * 200 + '","b":"y"}' and second.startswith('{"_truncated":') and len(second) < 800


def test_ingest_sets_bad_filings_aside(spark):
    from siltstone.operators import corpus as C

    page = "<html><p>Item: x</p><p>The company makes things and sells them to people.</p><script>no</script><p>More &nbsp; text</p></html>"
    filing = f"<SEC>\n<DOCUMENT><TYPE>EX-1\n<TEXT>{page}</TEXT></DOCUMENT><DOCUMENT><TYPE>10-K\n<TEXT>{page}</TEXT></DOCUMENT>"
    rows = [("aapl", "a.txt", filing), ("msft", None, page), ("bad", "b", "<DOCUMENT><TYPE>EX-99\n<TEXT>x</TEXT></DOCUMENT>"), ("none", "n", None), ("void", "v", "  ")]
    chunks, failed = C.ingest(spark.createDataFrame(rows, "ticker string, source string, text string"))
    got = sorted((r.chunk_id, r.source, r.text) for r in chunks.collect())
    text = "The company makes things and sells them to people.\nMore   text"
    assert got == [("AAPL_10K_chunk_0", "a.txt", text), ("MSFT_10K_chunk_0", "", text)]
    assert {(r.ticker, r.reason) for r in failed.collect()} == {("bad", "no primary document"), ("none", "no text"), ("void", "nothing to read")}


def test_thread_memory_expires_and_admits(spark, tmp_path):
    import pandas as pd

    from siltstone.streaming import threads as S

    class State:
        hasTimedOut, exists, held, removed = False, False, None, False  # noqa: N815

        @property
        def get(self):
            return self.held

        def update(self, x):
            self.held, self.exists = x, True

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.ms = ms

        def remove(self):
            self.removed, self.exists = True, False

    state, step = State(), S._step(1000)
    batch = lambda *r: pd.DataFrame(r, columns=["turn", "role", "text", "admitted"])
    out = pd.concat(step((1,), iter([batch((3, "user", "c", True)), batch((1, "user", "a", True), (2, "bot", "b", False))]), state))
    assert out.turn.tolist() == [1, 2, 3] and out.remembered.tolist() == [0, 1, 1] and state.held == (["user: a", "user: c"],) and state.ms == 1000
    state.hasTimedOut = True
    assert list(step((1,), iter([]), state)) == [] and state.removed
    state.hasTimedOut = False
    assert next(iter(step((1,), iter([batch((9, "user", "z", True))]), state))).remembered.tolist() == [0]


def test_recursive_chunks_hold_the_text():
    """Chunks are short enough, stand in the text in order, leave out nothing but white space, and overlap by little."""
    import random

    from siltstone.operators import corpus as C

    random.seed(3)
    for n in (0, 1, 40, 300, 900):
        text = "".join(f"{i}" + random.choice(["word ", "longerword ", "a ", "-".join(f"{i}x{j}" for j in range(random.randint(1, 120))) + " ", "\n", "\n\n", " ends. "]) for i in range(n))
        at, covered = 0, 0
        for chunk in C.split_text(text):
            place = text.find(chunk, at)
            assert chunk == chunk.strip() and 0 < len(chunk) <= C.CHUNK_CHARS and place >= at
            assert not text[covered:place].strip() or place <= covered
            assert covered - place <= C.CHUNK_OVERLAP
            at, covered = place, max(covered, place + len(chunk))
        assert not text[covered:].strip()


def test_page_text_against_patterns():
    """A parser's text of well-formed pages, against taking out scripts and tags by hand."""
    import html
    import random
    import re

    from siltstone.operators import corpus as C

    random.seed(5)
    for _ in range(200):
        page = "".join(random.choice(["<p>", "</p>", "plain text", " &amp; more ", "<b>bold</b>", "<script>var x = '<p>';</script>", "<style>p {}</style>", "<!-- note -->", "<br/>", "\n  \n", "<ix:hidden><p>unseen</p></ix:hidden>"]) for _ in range(30))
        bare = re.sub(r"(?s)<(script|style|ix:hidden)>.*?</\1>|<!--.*?-->", "", page)
        want = [x for x in (html.unescape(t).strip() for t in re.split(r"<[^>]*>", bare)) if x]
        assert re.sub(r"\s+", "", C.html_text(page)) == re.sub(r"\s+", "", "".join(want))
    assert C.html_text(None) is None and C.html_text("") == ""


def test_plain_tags_are_read_as_the_parser_reads_them():
    """Well-formed documents tag by tag, others by the parser: the same elements."""
    import random

    from siltstone.operators import xbrl

    random.seed(8)
    plain = ["<p>", "</p>", "<b>", "</b>", " 1,5 ", "&amp;", "&#36", "&nbsp;5", "<br/>", '<xbrli:context id="c1">', "</xbrli:context>", "<xbrli:instant>2001-12-31</xbrli:instant>", '<Xbrli:Unit ID="u">', "</xbrli:unit>", "<xbrli:measure>iso4217:USD</xbrli:measure>",
             '<ix:nonFraction name="a&amp;b" contextRef="c1" unitRef="u" scale="3">', "</ix:nonFraction>", '<ix:nonFraction name="n" scale="1" SCALE="2" contextRef="c1"/>', '<ix:nonNumeric name="dei:DocumentType">', "</ix:nonNumeric >", "<xbrli:identifier>77</xbrli:identifier>"]
    odd = ["<!-- <b> -->", "<script>'<ix:nonFraction name=\"x\">'</script>", "<a b>", "<i c='d'>", "a < b", "<", "</p x>", "<?pi?>", "<style><b></style>", "a > b", "<title>&amp;<b></title>", '<a t="x>y">']

    def whole(html):
        tags = xbrl._Tags()
        tags.feed(html)
        tags.close()
        return tags

    read = []
    for i in range(600):
        html = "".join(random.choices(plain + (odd if i % 3 == 0 else []), k=25))
        one, other = xbrl._Tags(), whole(html)
        one.feed = lambda h, f=one.feed: (read.append(i), f(h))
        one.read(html)
        assert [getattr(one, c) for c in ("contexts", "units", "names", "numbers", "cik", "open")] == [getattr(other, c) for c in ("contexts", "units", "names", "numbers", "cik", "open")], html
    assert read and all(i % 3 == 0 for i in read)


def test_a_filing_goes_on_in_the_next_batch():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from siltstone.operators import xbrl

    number = '<ix:nonFraction name="a" contextRef="c" unitRef="u" scale="0">1</ix:nonFraction>'
    context = '<xbrli:context id="c"><xbrli:instant>2001-12-31</xbrli:instant></xbrli:context>'
    docs = [("x", "t", 0, number), ("x", "t", 1, context), ("y", "t", 0, None), ("z", "t", 0, context + number), ("z", "t", 1, number)]
    schema = to_arrow_schema(StructType.fromDDL(xbrl.ROW))
    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(("filing", "ticker", "part", "html"), r, strict=True)) for r in rows], pa.schema([("filing", pa.string()), ("ticker", pa.string()), ("part", pa.int32()), ("html", pa.string())]))
    for size in (1, 2, 5):
        out = [r for b in xbrl._read(iter([batch(docs[i : i + size]) for i in range(0, len(docs), size)]), schema) for r in b.to_pylist()]
        assert [(r["filing"], r["kind"], r["pos"], r["reason"]) for r in out] == [("x", "fact", 0, None), ("x", "filing", None, None), ("y", "filing", None, None), ("y", "error", 0, "document 0: no text"), ("z", "fact", 0, None), ("z", "fact", 1, None), ("z", "filing", None, None)]
    assert list(xbrl._read(iter([]), schema)) == []
