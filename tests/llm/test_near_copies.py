"""SimHash by tiles against all pairs compared one by one."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import queries, simhash_tiles

SCHEMA = "doc_id long, text string, id long, print long, home long, guest string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_print(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest number of each one's group, all pairs compared."""
    top = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return top


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "g") for i, t in rows], SCHEMA)


def test_fingerprints():
    for text in (None, "", " \t\n", "one", "One TWO three", "a b c d", "a b c d e f " * 40, "ÄÖ İx\x0b\x1cy \xa0z", "x" * 50_000, "Ab\x00c D e f g"):
        assert simhash_tiles.fingerprint(text) == plain_print(text)


def test_fingerprints_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(3000))
    whole = simhash_tiles.fingerprint(text)
    monkeypatch.setattr(simhash_tiles, "SLICE", 64)
    assert simhash_tiles.fingerprint(text) == whole == plain_print(text)


def near_prints(seed, n):
    """Random fingerprints, chains of some that differ in one to five bits, and a dense group."""
    rng = np.random.default_rng(seed)
    x = [int(v) for v in rng.integers(0, 1 << 63, n // 2)]
    while len(x) < n:
        base = x[rng.integers(len(x))] if rng.random() < 0.6 else x[0]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            base ^= 1 << int(b)
        x.append(base)
    return list(dict.fromkeys(x))


@pytest.mark.parametrize("tile", [1 << 16, 16])
def test_links_join_all_within_the_radius(spark, tile):
    prints = near_prints(3, 700)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_tiles.links(frame, tile=tile).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in found)
    top = {p: p for p in prints}
    for a, b in found:
        if top[a] != top[b]:
            old, new = top[a], top[b]
            top = {p: new if t == old else t for p, t in top.items()}
    want = plain_components(prints)
    number = {}
    assert [number.setdefault(top[p], i) for i, p in enumerate(prints)] == want


def test_a_dense_group_gives_a_forest(spark):
    """All 2,016 pairs of 64 fingerprints one bit away from one are within the radius: 64 links say so in one tile."""
    frame = spark.createDataFrame([((0x0F0F0F0F0F0F0F0F ^ (1 << b)) - ((1 << 64) if b == 63 else 0),) for b in range(64)], "print long")
    assert 63 <= simhash_tiles.links(frame).count() <= 4 * 64


def test_near_copies(spark):
    words = [f"word{i % 91}x{i % 17}" for i in range(400)]
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (5, 100, 300)]
    rows = [(9, " ".join(words)), *[(20 + i, t) for i, t in enumerate(near)], (3, None), (4, ""), (None, "  "), (5, "one"), (5, "one"), (6, "ONE"), (None, "alone here"), (7, "y " * 30_000)]
    rows += [(1000 + i, "hot text of many") for i in range(80)]
    got = [(r.doc_id, r.print % (1 << 64), r.component_id) for r in simhash_tiles.near_copies(table(spark, rows)).collect()]
    prints = [plain_print(t) for _, t in rows]
    top = plain_components(prints)
    ids = {}
    for t, (i, _) in zip(top, rows, strict=True):
        if i is not None:
            ids[t] = min(i, ids.get(t, i))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted([(i, p, ids.get(t)) for t, p, (i, _) in zip(top, prints, rows, strict=True)], key=key)
    assert {ids[top[i]] for i in range(4)} == {9}  # the near copies are one group
    assert simhash_tiles.near_copies(table(spark, [])).count() == 0


def test_string_ids(spark):
    rows = spark.createDataFrame([("b", "x y"), ("a", "X  y"), ("c", "z")], "name string, body string")
    assert {tuple(r)[::2] for r in simhash_tiles.near_copies(rows, "name", "body").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_the_query(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op12_simhash"](spark, sf).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect())
    prints = [plain_print(t) for _, t in docs]
    top = plain_components(prints)
    assert got == {i: (f"{p:016x}", docs[t][0]) for (i, _), p, t in zip(docs, prints, top, strict=True)}


def test_batches_of_workers_are_small(monkeypatch):
    """What a worker hands over at once stays within some MB, of which Spark holds several copies outside its heap; nothing of it is lost."""
    from types import SimpleNamespace

    import pyarrow as pa

    from siltstone.llm import common, ngram_join, packing

    assert common.BATCH_BYTES <= 4 << 20 and ngram_join.FLUSH_BYTES <= 4 << 20
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 1 << 24, 20_000).tolist()) for _ in range(30)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packed = list(packing._pack(iter([docs]), pa.int64(), packing.tokenizer_path(), 2048, 1, False))
    assert len(packed) > 1 and max(b.nbytes for b in packed) < 4 << 20
    tokens = {d: n for b in packed for d, n in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)}
    assert sum(n for b in packed for n in b.column(2).to_pylist()) == sum(tokens.values()) and len(tokens) == 30


def test_a_worker_keeps_one_encoding_unless_white_space_runs_long():
    """The encoding of whole pieces is made for a long run of white space only; ids stay those of the vocabulary's own library."""
    from tokenizers import Tokenizer

    from siltstone.llm import packing

    path = packing.tokenizer_path()
    encode, own = packing.Encoder(path), Tokenizer.from_file(path)
    for text, made in (("hello world  \t x", False), ("a" + " " * 3000 + "b" + "\n" * 1500 + "c  d", True), ("again", True)):
        assert np.frombuffer(encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
        assert ("piece" in vars(encode)) == made
