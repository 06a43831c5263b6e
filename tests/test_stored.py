"""Files written by the library's sinks and read by its sources, and stored records brought up to date."""

import uuid

import pytest

from siltstone.operators import runs as R
from siltstone.operators import verify as V
from siltstone.operators.corpus import split_text
from siltstone.plans import catalog, stored
from siltstone.session import table
from siltstone.sources import files

RECORD = "run string, id string, ground_truth string, answer string, draft_answer string, status string, observations array<string>, retrieved array<string>, labelled boolean, n_groups long, hit boolean, recall double, mrr double, first_rank int"


def test_benchmarks_keep_whole_texts(spark, tmp_path):
    rows = [("a", "T", ' "x", y\n\nz ', "\\ \t", "p || q"), ("b", None, "é", "1", None)]
    names = "id string, ticker string, question string, ground_truth string, reference_contexts string"
    files.write_benchmark(spark.createDataFrame(rows, names), str(tmp_path / "b"))
    assert sorted(map(tuple, files.read_benchmark(spark, str(tmp_path / "b")).collect())) == rows
    with pytest.raises(ValueError, match="lacks"):
        files.write_benchmark(spark.range(1), str(tmp_path / "c"))


def test_labels_lie_in_files_by_id(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "named_struct('n', id) as label")
    files.write_labels(rows, str(tmp_path / "l"), files=3)
    assert len(list((tmp_path / "l").glob("file=*"))) == 3
    assert sorted((int(r.id), r.label.n) for r in files.read_labels(spark, str(tmp_path / "l"), "struct<n:long>").collect()) == [(i, i) for i in range(40)]
    with pytest.raises(Exception, match="(?i)duplicate"):
        files.write_labels(rows.unionByName(rows), str(tmp_path / "twice"))
    files.write_labels(rows.limit(0), str(tmp_path / "none"))
    assert files.read_labels(spark, str(tmp_path / "none"), "struct<n:long>").count() == 0


def test_newest_filing_in_both_layouts(spark, tmp_path):
    for at, text in (("AAPL/10-K/0000-23-1/full-submission.txt", "old"), ("AAPL/10-K/0000-24-1/full-submission.txt", "new"), ("MSFT/1.txt", "flat"), ("MSFT/note.md", "other")):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(text)
    assert {r.ticker: r.text for r in files.newest_filings(spark, str(tmp_path)).collect()} == {"AAPL": "new", "MSFT": "flat"}


def test_directory_chunks(spark, sf):
    got = {}
    for r in catalog.queries()["directory_chunks"](spark, sf).orderBy("accession", "chunk_idx").collect():
        held = got.setdefault(r.accession, [])
        assert r.chunk_idx == len(held)
        held.append(r.chunk)
    want = {f"{r.page_id:012d}": split_text((r.html or "") + "\n") for r in table(spark, sf, "pages").collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_texts_are_files_of_their_own(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("A", 1, b"x\r\ny"), ("A", 1, b"\xff\x00z"), ("B", 2, b""), ("B", 3, None), (None, 4, "é".encode())], "ticker string, n int, content binary")
    files.write_texts(rows, str(tmp_path / "own folder"), ["ticker", "n"], "content")
    held = sorted((str(p.parent.relative_to(tmp_path / "own folder")), p.read_bytes()) for p in (tmp_path / "own folder").rglob("*.txt"))
    assert held == [("ticker=A/n=1", b"x\r\ny\n"), ("ticker=A/n=1", b"\xff\x00z\n"), ("ticker=B/n=2", b"\n"), ("ticker=B/n=3", b"\n"), ("ticker=__HIVE_DEFAULT_PARTITION__/n=4", "é\n".encode())]
    assert {p.name for p in (tmp_path / "own folder").rglob(".*")} <= {"._SUCCESS.crc"} and (tmp_path / "own folder" / "_SUCCESS").exists()
    (tmp_path / "own folder" / "empty.txt").touch()
    (tmp_path / "own folder" / "marked.txt").write_bytes(b"\xef\xbb\xbfa\r\n\n")
    source = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(str(tmp_path / "own folder"), wholetext=True).selectExpr("_metadata.file_path as path", "value as text")
    got, plain = (sorted((r.path, bytes(r.b)) for r in x.selectExpr("path", "cast(text as binary) as b").collect()) for x in (files.read_texts(spark, str(tmp_path / "own folder")), source))
    assert got == plain and len(got) == 6
    files.write_texts(rows.limit(0), str(tmp_path / "none"), ["ticker", "n"], "content")
    assert files.read_texts(spark, str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(files.Stored, "local", False)  # Spark's sink
    files.write_texts(rows.selectExpr("ticker", "n", "decode(content, 'ISO-8859-1') as text").where("n = 3"), str(tmp_path / "sink"), ["ticker", "n"], "text")
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "sink")).collect()] == ["\n"]


def test_pages_of_one_number_are_filings_of_their_own(spark, tmp_path):
    spark.createDataFrame([(7, "u", "one"), (7, "u", "two"), (8, "u", "three")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalog.queries()["filing_texts"](spark, str(tmp_path)).collect()))
    assert got == [("000000000007", "one\n"), ("000000000007", "two\n"), ("000000000008", "three\n")]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"T/{i}").mkdir(parents=True)
        (tmp_path / f"T/{i}/a.txt").write_text(str(i))
    sc, key, group = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism", uuid.uuid4().hex
    before = spark.conf.get(key)
    sc.setJobGroup(group, "listing")
    try:
        rows = files.read_texts(spark, str(tmp_path))
    finally:
        sc.setJobGroup("rest", "rest")
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism
    assert spark.conf.get(key) == before and {r.text for r in rows.collect()} == {str(i) for i in range(60)}


def test_half_written_files_are_written_again(spark, sf):
    calls, what = [], f"half-{uuid.uuid4().hex}"

    def write(rows, path):
        calls.append(path)
        rows.limit(1).write.json(path)

    at = stored._written(spark, sf, "labels", what, write)
    assert stored._written(spark, sf, "labels", what, write) == at and len(calls) == 1
    files.Stored(spark, f"{at}/_SUCCESS").delete()
    stored._written(spark, sf, "labels", what, write)
    assert len(calls) == 2 and spark.read.json(at).count() == 1


def test_runs_on_another_index_keep_their_retrieval(spark):
    said = "It was $5 million."
    rows = [(run, i, said, said, said, "verified", [said], ["b", "a", "b"], True, 7, False, 0.0, 0.0, None) for run in ("now", "old", "none", "search") for i in ("1", "2")]
    records = spark.createDataFrame(rows, RECORD)
    runs = spark.createDataFrame([("now", "generation", "v2", True), ("old", "generation", "v1", False), ("none", "generation", None, None), ("search", "retrieval", "v2", True)], "run string, result_kind string, benchmark_version string, has_aggregates boolean")
    groups = spark.createDataFrame([("1", 1, "a"), ("1", 2, "c"), ("3", 1, "a")], "item_id string, group_id int, doc_id string")
    got = {(r.run, r.id): (r.figure_exact, r.n_grounded, r.labelled, r.n_groups, r.hit, r.recall, r.mrr, r.first_rank) for r in R.recomputed(records, runs, groups, "v2").collect()}
    kept = (True, 1, True, 7, False, 0.0, 0.0, None)
    assert got == {("now", "1"): (True, 1, True, 2, True, 0.5, 0.5, 2), ("now", "2"): (True, 1, False, 0, None, None, None, None)} | {(run, i): kept for run in ("old", "none") for i in ("1", "2")}
    assert {r.run: (r.same_index, r.what) for r in R.recompute_notes(runs, "v2").collect()} == {"now": (True, R.ALL_CHECKS), "old": (False, R.FIGURES_ONLY), "none": (False, R.FIGURES_ONLY)}
    assert R.recomputed(records.limit(0), runs, groups, "v2").count() == 0


def test_checks_of_records_that_have_none_yet(spark):
    said = "It was $5 million."
    records = spark.createDataFrame([("1", said, said, None, None, None, ["a"]), ("2", said, None, None, "refused", [], None)], "id string, ground_truth string, answer string, draft_answer string, status string, observations array<string>, retrieved array<string>")
    groups = spark.createDataFrame([("1", 1, "a"), ("2", 1, "a")], "item_id string, group_id int, doc_id string")
    got = {r.id: (r.figure_exact, r.labelled, r.hit, r.mrr) for r in R.attach_deterministic(records, groups).collect()}
    assert got == {"1": (True, True, True, 1.0), "2": (False, True, False, 0.0)}
    assert "hit" not in R.attach_deterministic(records).columns


def test_old_and_new_records_take_one_shape(spark):
    one, two = "[1] ticker=AAPL  chunk_idx=3\nfirst", "=== MSFT ===\n[1] chunk_idx=4\nsecond\n\n[2] ticker=AAPL chunk_idx=3\nagain"
    rows = [("old", "fine", None, None, [one, two]), ("new", "fine", None, [two], ["stale"]), ("list", "", None, None, ["AAPL, MSFT"]), ("bare", None, "quota", None, None)]
    records = spark.createDataFrame(rows, "run string, answer string, terminal_failure string, observations array<string>, contexts array<string>")
    got = {r.run: (r.terminal_failure, r.n_observations, r.n_contexts, r.retrieved, r.contexts) for r in V.upgraded(records, "run", "need more steps").collect()}
    second = ["[MSFT 10-K, chunk 4] second", "[AAPL 10-K, chunk 3] again"]
    assert got == {
        "old": (None, 2, 3, ["AAPL_10K_chunk_3", "MSFT_10K_chunk_4"], ["[AAPL 10-K, chunk 3] first", *second]), "new": (None, 1, 2, ["MSFT_10K_chunk_4", "AAPL_10K_chunk_3"], second),
        "list": ("empty_answer", 1, 0, [], []), "bare": ("quota", 0, 0, [], []),
    }
    bare = V.upgraded(records.drop("observations", "terminal_failure"), "run", "need more steps")
    assert {r.run: r.recursion_limit_hit for r in bare.collect()} == dict.fromkeys(("old", "new", "list", "bare"), False)
