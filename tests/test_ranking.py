"""Dense ranking under filters and the index in segments, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from siltstone.operators import inverted, passages
from siltstone.operators.nearest import nearest
from siltstone.sources.versions import Conflict, Versions, read_table, write_table


def plain_nearest(asked, vectors, k, others):
    rows = set()
    for q, want, v in asked:
        if not v or any(x is None for x in v):
            continue
        found = [(-round(sum(a * b for a, b in zip(v, w, strict=True)), 9), d) for d, value, w in vectors if d is not None and w and len(w) == len(v) and None not in w and all(map(math.isfinite, w)) and (want is None or want == value) and not (others and d == q)]
        rows |= {(q, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)}
    return rows


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize("sizes", [{}, {"held": 0, "block": 4, "shard": 30}, {"held": 0}])
def test_nearest_under_filters(spark, sizes, others):
    draw = random.Random(3)
    vectors = [(i, draw.choice("ab"), [draw.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(150)]
    vectors += [(500, "a", None), (501, "a", [1.0, None, 0.0, 0.0]), (502, "a", [float("nan"), 0.0, 0.0, 0.0]), (503, "b", [1.0]), (None, "a", [9.0] * 4), (504, None, [9.0] * 4)]
    asked = [(i, draw.choice(["a", "b", "c", None]), [draw.random() for _ in range(4)]) for i in range(25)] + [(900, None, None), (901, "a", [1.0] * 4)]
    q, d = spark.createDataFrame(asked, "query_id long, wanted string, vector array<double>"), spark.createDataFrame(vectors, "doc_id long, value string, vector array<double>")
    got = {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in nearest(q, d, 3, wanted="wanted", value_col="value", others=others, **sizes).collect()}
    assert got == plain_nearest(asked, vectors, 3, others)
    assert nearest(q, d.limit(0), 3, wanted="wanted", value_col="value", **sizes).count() == nearest(q.limit(0), d, 3, **sizes).count() == 0


def test_nearest_of_other_ids(spark):
    q, d = spark.createDataFrame([("q", [1.0, 0.0])], "name string, v array<float>"), spark.createDataFrame([("x", [1.0, 5.0]), ("a", [1.0, 7.0]), ("q", [3.0, 0.0])], "name string, v array<float>")
    for held in (10, 0):
        assert [tuple(r) for r in nearest(q, d, 2, "name", "v", id_col="name", vector_col="v", others=True, held=held).orderBy("rank").collect()] == [("q", 1, "a", 1.0), ("q", 2, "x", 1.0)]


def plain_bm25(docs, asked, k):
    """Rows (query, rank, doc) by Okapi with a floor for negative frequencies."""
    terms = {d: re.findall(r"[a-z0-9]+(?:[.,][0-9]+)*", (t or "").lower()) for d, t in docs.items()}
    n, average = len(terms), sum(map(len, terms.values())) / max(1, len(terms))
    df = Counter(w for t in terms.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    rows = []
    for q, text in asked:
        scores = {}
        for d, t in terms.items():
            tf = Counter(t)
            s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in re.findall(r"[a-z0-9]+(?:[.,][0-9]+)*", (text or "").lower()) if w in tf)
            if round(s, 6) > 0:
                scores[d] = round(s, 6)
        rows += [(q, rank, d) for rank, (s, d) in enumerate(sorted((-s, d) for d, s in scores.items())[:k], 1)]
    return sorted(rows)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return {i: " ".join(draw.choices(words, [1 / (j + 1) for j in range(60)], k=draw.randint(0, 40))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 12, 4096])
def test_pruning_changes_nothing(spark, tmp_path, seed):
    docs = corpus(5, 150)
    asked = [(i, " ".join(random.Random(i).choices([f"w{j}" for j in range(70)], k=1 + i % 9))) for i in range(20)] + [(99, "w0 w0 w1"), (100, ""), (101, None), (102, "unknown")]
    index = inverted.TermIndex.open(spark, str(tmp_path / "i")).put(frame(spark, docs))
    q = spark.createDataFrame(asked, "query_id long, query_text string")
    for prune_from in (0, inverted.PRUNE_FROM):
        assert sorted((r.query_id, r.rank, r.doc_id) for r in index.top(q, 4, seed=seed, prune_from=prune_from).collect()) == plain_bm25(docs, asked, 4)


def test_an_index_in_batches(spark, tmp_path):
    path, docs = str(tmp_path / "i"), corpus(7, 60)
    asked = [(i, f"w{i} w{i + 1} w2") for i in range(12)]
    q = spark.createDataFrame(asked, "query_id long, query_text string")
    answers = lambda index: sorted((r.query_id, r.rank, r.doc_id) for r in index.top(q, 5, seed=8, prune_from=0).collect())
    index = inverted.TermIndex.open(spark, path)
    assert answers(index) == [] and index.statistics()["n_docs"] == 0
    index = index.put(frame(spark, docs))
    changed = {i: f"w{i} w3 w3" for i in range(10, 20)} | {100: "w1 w2", 101: "", 102: None}
    index = index.put(frame(spark, changed))
    docs |= changed
    assert answers(index) == plain_bm25(docs, asked, 5)
    index = index.delete(frame(spark, {3: "", 15: "", 100: "", 777: ""}))
    for i in (3, 15, 100):
        del docs[i]
    assert answers(index) == plain_bm25(docs, asked, 5) and index.statistics()["n_docs"] == len(docs)
    small = index.compact()
    assert len(small.state["segments"]) == 1 and not small.state["dead"] and answers(small) == plain_bm25(docs, asked, 5)
    again = small.put(frame(spark, {15: "w1 w1 w1"}))  # an id that was deleted comes back
    docs[15] = "w1 w1 w1"
    assert answers(again) == plain_bm25(docs, asked, 5) == answers(inverted.TermIndex.open(spark, path))
    with pytest.raises(Conflict):
        small.put(frame(spark, {5: "w9"}))  # of a version that isn't the last
    with pytest.raises(ValueError, match="repeats"):
        again.put(frame(spark, {1: "a"}).union(frame(spark, {1: "b"})))
    assert answers(inverted.TermIndex.open(spark, path)) == plain_bm25(docs, asked, 5)  # what failed left nothing
    assert Versions(spark, path).vacuum() > 0 and answers(inverted.TermIndex.open(spark, path)) == plain_bm25(docs, asked, 5)


def test_load_or_build(spark, tmp_path):
    path, docs = str(tmp_path / "i"), frame(spark, {1: "a b", 2: "b"})
    made = inverted.load_or_build(spark, path, docs, 2)
    assert inverted.load_or_build(spark, path, docs.where("false"), 2).version == made.version == 1
    with pytest.raises(ValueError, match="has 2 documents, 3 are expected"):
        inverted.load_or_build(spark, path, docs, 3)


def test_few_asked_terms_are_read_alone(spark, tmp_path):
    index = inverted.TermIndex.open(spark, str(tmp_path / "i")).put(frame(spark, corpus(2, 80)))
    q = spark.createDataFrame([(1, "w7 w30")], "query_id long, query_text string")
    plan = index.scores(q)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "In(term, [w30,w7])" in plan.replace("In(term, [w7,w30])", "In(term, [w30,w7])")


def test_tables_by_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    write_table(spark.createDataFrame([(1, "a"), (2, "b")], "n long, k string"), path, "k")
    held = read_table(spark, path)
    with pytest.raises(Exception, match="boom|UDF|error"):
        write_table(spark.range(3).selectExpr("raise_error('boom') as n", "'c' as k"), path)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, read_table(spark, path).collect())) == [(1, "a"), (2, "b")]
    assert [tuple(r) for r in write_table(held.where("n = 2"), path).collect()] == [(2, "b")]  # reads what it replaces
    assert sorted(map(tuple, held.collect())) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("block_chars", [passages.BLOCK_CHARS, 300])
def test_located(spark, block_chars):
    import random

    random.seed(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    docs = [(i, " ".join(random.choices(words, k=200))) for i in range(30)]
    refs = [(j, docs[j][1][a : a + n]) for j, (a, n) in enumerate([(0, 80), (3, 90), (17, 25), (40, 61), (5, 8), (0, 400)])] + [(90, docs[9][1][10:75] + " never seen"), (91, ""), (92, "alpha beta gamma delta eps nowhere at all"), (93, None), (94, "ta"), (95, "Beta  GAMMA"), (96, "beta gamma"), (97, "zetax"), (98, docs[9][1][10:75] + " other end")]
    docs += [(40, None), (41, ""), (42, "alpha beta gamma delta eps no"), (43, "A" * 100_000 + "lpha beta gamma")]
    got = {tuple(r) for r in passages.located(spark.createDataFrame(refs, "rid long, t string"), spark.createDataFrame(docs, "did long, t string"), "rid", "t", "did", "t", block_chars=block_chars).collect()}
    norm = lambda t: " ".join((t or "").split()).lower()
    want = set()
    for rid, t in refs:
        t = norm(t)
        exact = {(rid, d, "exact") for d, x in docs if t and t in norm(x)}
        want |= exact or {(rid, d, "prefix") for d, x in docs if len(t[:60]) >= 20 and t[:60] in norm(x)}
    assert got == want and len({r for r, *_ in want}) >= 7


def test_no_passages(spark):
    none = spark.createDataFrame([(1, " ")], "rid long, t string")
    assert passages.located(none, spark.createDataFrame([("x", "a")], "did string, t string"), "rid", "t", "did", "t").count() == 0


def test_scores_are_summed_where_documents_stand(spark, tmp_path):
    """No pair of a question and a document is shuffled: each batch of documents gives its best, for every value or for a wanted one."""
    docs = corpus(9, 300) | {i: "w1 w5 w9" for i in range(300, 340)}
    asked = [(i, f"w{i} w{i + 1} w3 w3", ["a", "b", None][i % 3]) for i in range(30)]
    q, d = spark.createDataFrame(asked, "query_id long, query_text string, own string"), frame(spark, docs)
    index = inverted.TermIndex.open(spark, str(tmp_path / "i")).put(d, by_term=False)
    found = index.top(q, 3, prune_from=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.index("Exchange hash") < plan.index("MapInArrow")
    everything = plain_bm25(docs, [a[:2] for a in asked], len(docs))
    rows = lambda df, *more: sorted(tuple(r) for r in df.select("query_id", *more, "rank", "doc_id").collect())
    assert rows(found) == [r for r in everything if r[1] <= 3]
    value = {i: None if i % 10 == 9 else "ab"[i % 2] for i in docs}
    values = spark.createDataFrame([(i, v) for i, v in value.items() if i % 10 != 8], "doc_id long, value string")

    def best(fits, each):
        kept, seen = [], {}
        for q_id, _, doc in everything:
            if doc % 10 != 8 and fits(q_id, doc):
                key = (q_id, *([value[doc]] if each else []))
                seen[key] = seen.get(key, 0) + 1
                kept += [(*key, seen[key], doc)] if seen[key] <= 3 else []
        return kept

    own = {a[0]: a[2] for a in asked}
    assert rows(index.top(q, 3, values=values, wanted="own")) == sorted(best(lambda a, doc: own[a] is None or own[a] == value[doc], False))
    assert {(r.query_id, r.value, r.rank, r.doc_id) for r in index.top(q, 3, values=values).collect()} == set(best(lambda a, doc: True, True))
    # postings by term, where a segment has none, are those of its documents
    assert sorted((r.query_id, r.doc_id) for r in index.scores(q).collect()) == sorted((a, doc) for a, _, doc in everything)


def test_questions_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "ASKED_ROWS", 7)
    docs, asked = corpus(4, 90), [(i, f"w{i} w{i + 1} w2") for i in range(15)]
    index = inverted.TermIndex.open(spark, str(tmp_path / "i")).put(frame(spark, docs))
    got = index.top(spark.createDataFrame(asked, "query_id long, query_text string"), 4, prune_from=0)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got.collect()) == plain_bm25(docs, asked, 4)


def test_terms_are_counted_in_arrow(spark, tmp_path, monkeypatch):
    """A document's tokens are counted outside of interpreted expressions, a slice at a time, and are those of the token expression."""
    from siltstone.functions import text as T

    monkeypatch.setattr(inverted, "COUNTED_ROWS", 2)
    texts = ["A a, 1,000.5 b1.5.", None, "", "\u0130stanbul \u212aelvin caf\u00e9 x\u0660 1.a", "w " * 3000, "1,2.3,,4", "\n\t--"]
    docs = frame(spark, dict(enumerate(texts)))
    index = inverted.TermIndex.open(spark, str(tmp_path / "i")).put(docs)
    got = {r.doc_id: (r.dl, {t.term: t.tf for t in r.terms}) for r in index.documents().collect()}
    assert got == {r.doc_id: (len(r.t), dict(Counter(r.t))) for r in docs.select("doc_id", T.tokens(docs.text).alias("t")).collect()}


def test_kept_columns_filter_without_a_shuffle_of_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = corpus(9, 120)
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 10 != 9, F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")))
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w3", ["a", "b", None][i % 3]) for i in range(12)], "query_id long, query_text string, own string")
    first = inverted.TermIndex.open(spark, str(tmp_path / "i")).put(docs.where("doc_id < 80"), by_term=False, keep=["lang"])
    made = first.put(docs.where("doc_id >= 70"), by_term=False, keep=["lang"])
    values = docs.select("doc_id", F.col("lang").alias("value"))
    rows = lambda df, *more: sorted((tuple(r) for r in df.select("query_id", *more, "rank", "doc_id", "score").collect()), key=str)
    small = made.compact()
    for index in (made, small):
        assert rows(index.top(asked, 3, values=F.col("own_lang"), wanted="own")) == rows(index.top(asked, 3, values=values, wanted="own")) != []
        assert rows(index.top(asked, 3, values=F.col("own_lang")), "value") == rows(index.top(asked, 3, values=values), "value") != []
    plan = small.top(asked, 3, values=F.col("own_lang"), wanted="own")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.index("Exchange hash") < plan.index("MapInArrow")
    none = inverted.TermIndex.open(spark, str(tmp_path / "none")).top(asked, 3, values=F.col("own_lang"))
    assert none.columns == ["query_id", "value", "rank", "doc_id", "score"] and none.count() == 0
