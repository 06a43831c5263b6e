"""Every query of this package by its name, on small tables with nulls, repeated rows, odd texts and columns of clashing names."""

import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import language, licenses, packing, queries, toxicity

WORDS = ["lar", "monado", "tekine", "vasous", "pilter", "droill", "ganand", "selado", "trash", "worthless", "haus", "baum", "fenster"]
MIT = licenses.TEMPLATES["MIT"][0]
ROWS = 60
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, part string, size long, block string, print int"


def corpus():
    draw = random.Random(11)
    rows = []
    for i in range(ROWS):
        lang = ["en", "de"][i % 2]
        own = WORDS[:8] if lang == "en" else WORDS[8:]
        text = " ".join(draw.choice(own + WORDS[i % 5 : i % 5 + 2]) for _ in range(draw.randint(5, 60)))
        rows.append((i, text, lang, f"s{i % 3}"))
    whole = rows[7][1]
    rows += [(100, whole, "en", "s0"), (101, whole + " more", "en", None), (7, whole, "de", "s1"), (102, None, None, None), (103, "", "en", "s1"), (104, " \t\n", None, "s2"), (None, "no id here at all", "en", "s0"), (None, None, None, None)]
    rows += [(105, MIT, "en", "s0"), (106, "key AKIA" + "B7" * 10 + ' password: "hunter2222" ' + "0123456789abcdef" * 2, "en", "s0"), (107, "word " * 30_000, "de", "s1"), (108, "x" * 20_000, None, "s2")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contracts"))
    rows = [(*r, len(r[1] or ""), 1, "k", "p", 2, "b", 3) for r in corpus()]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(ROWS)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    draw = random.Random(2)
    vectors = [(i, [draw.gauss(0, 1) for _ in range(8)], 0) for i in range(80)] + [(200, None, 0), (220, [0.0] * 8, 0), (None, [1.0] * 8, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


COLUMNS = {
    "op1_ngram_join": {"doc_id", "n_shingles", "component_id"}, "op2_neighbours": {"query_id", "rank", "vec_id", "score"}, "op3_line_dedup": set(), "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op6_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op7_licenses": set(),
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op9_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op10_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}, "op11_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op12_simhash": {"doc_id", "fingerprint", "component_id"}, "op13_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
}
A_ROW_EACH = ["op1_ngram_join", "op4_language", "op6_toxicity", "op9_secrets", "op10_exact_dedup", "op11_alignment", "op12_simhash"]


def test_all_queries_are_known():
    assert set(COLUMNS) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, folder, name):
    found = queries.QUERIES[name](spark, folder)
    assert COLUMNS[name] <= set(found.columns)
    rows = found.collect()
    if name in A_ROW_EACH:
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
        assert ids == sorted((i is None, i or 0) for i, *_ in corpus())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def held(doc_id, n, k):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == k


def test_ngram_join_by_its_name(spark, folder):
    docs = corpus()
    sets = []
    for _, text, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    top = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    least = {}
    for t, (i, *_) in zip(top, docs, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op1_ngram_join"](spark, folder).collect()), key=str)
    assert got == sorted(((i, len(s), least.get(t)) for (i, *_), s, t in zip(docs, sets, top, strict=True)), key=str)


def test_language_and_toxicity_by_their_names(spark, folder):
    known = {"en", "de", "und"}
    for r in queries.QUERIES["op4_language"](spark, folder).collect():
        assert r.held_out == held(r.doc_id, 4, 2) or r.doc_id is None
        assert r.lang_pred in known and 0 <= r.score <= 1
    texts = {i: t for i, t, *_ in corpus()}
    said = {r.doc_id: r.lang_pred for r in queries.QUERIES["op4_language"](spark, folder).collect()}
    assert all((said[i] == "und") == (not re.search(r"[^\W\d_]", texts[i] or "")) for i in said if i is not None)
    for r in queries.QUERIES["op6_toxicity"](spark, folder).collect():
        assert (r.held_out == held(r.doc_id, 3, 1) or r.doc_id is None) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_mixing_by_its_name(spark, folder):
    rows = queries.QUERIES["op5_mixing"](spark, folder).collect()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in corpus())
    assert sorted(r.size for r in rows) == sizes
    assert all(0 <= r.taken <= 2 * r.size and 0 <= r.target <= 2 * r.source_size + 1e-6 for r in rows)


def test_packing_by_its_name(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i is None, i or 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in corpus())
    rows = queries.QUERIES["op8_packing"](spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n for *_, n in want)
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048


def test_secrets_and_licences_by_their_names(spark, folder):
    row = next(r for r in queries.QUERIES["op9_secrets"](spark, folder).collect() if r.doc_id == 106)
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)
    assert {(r.doc_id, r.license) for r in queries.QUERIES["op7_licenses"](spark, folder).collect()} == {(105, "MIT")}


def test_ids_that_are_text(spark):
    rows = spark.createDataFrame([("a-1", "monado tekine vasous"), (None, MIT), ("b", None)], "name string, body string")
    model = language.train(["monado tekine", "haus baum"] * 20, ["en", "de"] * 20)
    assert {r.doc_id for r in language.identify(rows, model, "name", "body").collect()} == {"a-1", None, "b"}
    assert {(r.doc_id, r.license) for r in licenses.scan(rows, "name", "body").collect()} == {(None, "MIT")}
    assert {r.doc_id for r in packing.pack(rows, packing.tokenizer_path(), "name", "body").collect()} == {"a-1", None, "b"}
    docs = spark.createDataFrame([(i, "trash worthless" if i % 3 == 0 else "haus baum fenster") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    assert {r.doc_id for r in toxicity.score(rows, toxicity.fitted(docs, labels), "name", "body").collect()} == {"a-1", None, "b"}
