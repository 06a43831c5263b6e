"""The audit of filters against a plain count, order by order."""

from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import filter_audit, queries

SPACE = " \t\n\x0b\x0c\r"


def plain_words(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain(docs, labels):
    """Rows (part, order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (doc_id, text, part)."""
    known = {}
    for i, q, t in labels:
        a, b = known.get(i, (0, 0))
        known[i] = (max(a, q or 0), max(b, t or 0))
    docs = [(i, t or "", p or "") for i, t, p in docs]
    failed = []
    for i, t, _ in docs:
        w = plain_words(t)
        e = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), e]
        failed.append({x for x, f in zip("ABCDE", fails, strict=True) if f})
    rows = {}
    for part in {p for _, _, p in docs}:
        own = [(i, f) for (i, _, p), f in zip(docs, failed, strict=True) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [i for i, f in left if x in f]
                rows[part, order, step] = [len(left) - len(gone), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own)]
                rows[part, order, step] += [sum(i is not None and known.get(i, (0, 0))[k] == 1 for i in gone) for k in (0, 1)]
                shapley[x] += len(gone)
                left = [(i, f) for i, f in left if x not in f]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                rows[part, order, step].append(shapley[x])
    return rows


def got(frame):
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in frame.collect()}


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(i, t, p, "x", 1, 2, 3, 4) for i, t, p in docs], "doc_id long, text string, lang string, part string, n long, high long, fails int, spread long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_every_order(spark):
    rng = np.random.default_rng(5)
    docs = []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, rng.choice([30, 100, 2000]), rng.choice([20, 99, 100, 130]))]
        text = " ".join(words)
        docs.append((i, text.upper() if rng.random() < 0.3 else text + " #" * (rng.random() < 0.2), rng.choice(["en", "de"])))
    docs += [(200 + i, docs[int(rng.integers(0, 40))][1], rng.choice(["en", "de"])) for i in range(40)]
    docs += [(300, None, None), (301, "", "en"), (None, "", "fr"), (None, docs[0][1], "fr"), (301, "", "en"), (302, "é" * 9 + "A", "fr"), (303, "é" * 8 + "A", "fr"), (304, "\t\n ", ""), (7, docs[7][1], "en")]
    docs += [(1000 + i, "same for many", "en") for i in range(60)] + [(2000, "ein " * 50_000 + "&", "de")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 200, 2)] + [(4, 1, 1), (None, 1, 1), (300, None, 1)]
    docs_frame, labels_frame = frames(spark, docs, [(i, q, None if t is None else int(t)) for i, q, t in labels])
    assert got(filter_audit.audit(filter_audit.failures(docs_frame, labels_frame))) == plain(docs, labels)


def test_empty_tables(spark):
    docs, labels = frames(spark, [], [])
    assert got(filter_audit.audit(filter_audit.failures(docs, labels))) == {}
    some, _ = frames(spark, [(1, "a", None)], [])
    assert got(filter_audit.audit(filter_audit.failures(some, labels))) == plain([(1, "a", None)], [])


@pytest.mark.parametrize("texts", [["", "", ""], ["a"], ["", " a b  a ", "", "b"], ["x" * 2000 + " " + "x" * 2000 + " " + "x" * 1999 + "y x"], ["abcdefgh abcdefg abcdefgh abcdefghi abcdefghi " * 3, "é è é\x0bè"]])
def test_words_and_distinct_words(texts):
    for column in (pa.array(texts), pa.array(["skipped ", *texts, None])[1:]):
        texts_ = filter_audit.Texts(column)
        begin, end, of = texts_.words()
        want = [plain_words(t or "") for t in column.to_pylist()]
        assert [texts_.data[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)] == [w for own in want for w in own]
        with np.errstate(over="ignore"):
            assert filter_audit.distinct_words(texts_, begin, end, of).tolist() == [len(set(w)) for w in want]


def test_hashes_that_collide(monkeypatch):
    """Neighbours are verified: with hashes that are all alike the words themselves are counted."""
    monkeypatch.setattr(filter_audit, "mix", lambda x: np.zeros_like(x))
    texts = filter_audit.Texts(pa.array(["aa bb aa cc", "dd dd", "ee", "y" * 600 + " " + "z" * 600]))
    assert filter_audit.distinct_words(texts, *texts.words()).tolist() == [3, 1, 1, 2]


def test_the_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    frame = queries.QUERIES["op13_filter_audit"](spark, sf)
    assert frame.count() == 600 * len({r[2] for r in docs})
    assert got(frame) == plain(docs, labels)
