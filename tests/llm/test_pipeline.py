"""Each stage of the pipeline against a brute-force version, and what all of them do with odd tables."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from siltstone.llm import line_dedup, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, _row long, root long"
WORDS = [f"{a}{b}" for a in ("lar", "mon", "tek", "vas", "pil", "dro", "gan", "sel") for b in ("ado", "ine", "ous", "ter", "ill", "and")]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def table(spark, rows):
    """Documents (doc_id, text[, source]) beside columns whose names the stages use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "k", 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with labels: every third of the first 600 documents is toxic."""
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def told(i):
    return prose(i, 30) + (" zorkwad" if i % 3 == 0 else "") + " " + prose(10_000 + i, 10)


def test_toxic_documents_go_and_clean_ones_stay(spark, labelled):
    rows = [(i, told(i)) for i in range(700)] + [(9000, None), (9001, ""), (9002, prose(5, 40_000)), (9003, prose(6, 9) + " zorkwad"), (9004, "zorkwad"), (9004, "zorkwad"), (9005, prose(6, 9))]
    docs = table(spark, rows)
    out = P.drop_toxic(spark, docs, labelled)
    assert out.columns == docs.columns
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1]  # never learnt from
    kept = {r.doc_id for r in out.collect()}
    # brute force: each text on its own, by the words that the machine weighs
    model = toxicity.fitted(docs, spark.read.parquet(f"{labelled}/labels.parquet"))
    for i, text in rows:
        ws = sorted(toxicity.tokens(text or ""))
        v = model.decide(ws) if ws else np.zeros((0, 2))
        score = model.score(np.array([max([model.word.bias, *v[:, 0]])]), np.array([v[:, 1].sum()]), np.array([len(ws)]))[0]
        assert (i in kept) == (score < toxicity.THRESHOLD), i
    assert {i for i in held if i % 3 == 0} & kept == set() and {i for i in held if i % 3} <= kept
    assert {9000, 9001, 9002, 9005} <= kept and not {9003, 9004} & kept


def test_lines_against_brute_force(spark, labelled):
    rng = np.random.default_rng(1)
    pool = [prose(i, int(rng.integers(6, 25))) for i in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(int(rng.integers(1, 5))):
            line = pool[int(rng.integers(0, 25))]
            if rng.random() < 0.5:
                ws = line.split()
                ws[int(rng.integers(0, len(ws)))] = f"q{rng.integers(999)}"
                line = " ".join(ws) + ("!" if rng.random() < 0.3 else "")
            lines.append(line.upper() if rng.random() < 0.1 else line)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "ok\nok"), (104, prose(77, 20_000)), (105, pool[0]), (105, pool[0])]
    out = P.drop_repeated_lines(spark, table(spark, rows), labelled)
    assert out.columns == table(spark, []).columns
    # brute force: connected groups of similar lines, the first of each stays
    norm = lambda s: re.sub(" {2,}", " ", re.sub(line_dedup.MARKS, " ", s.lower())).strip()
    seen = sorted({(i, j, line) for i, t in rows if t is not None for j, line in enumerate(t.split("\n"))})
    normal = [norm(x[2]) for x in seen]
    able = [m.count(" ") >= 2 or len(m) >= 6 for m in normal]
    root = list(range(len(seen)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(seen)):
        for b in range(a):
            if able[a] and able[b] and (seen[a][2] == seen[b][2] or line_dedup.similar(normal[a], normal[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    drop = {seen[k][:2] for k in range(len(seen)) if find(k) != k}
    want = []
    for i, t in rows:
        left = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in drop)
        if t is None or left == t or left.strip():
            want.append((i, left))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_near_copies_against_brute_force(spark, labelled):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        base = prose(300 + g, int(rng.integers(3, 120))).split()
        for _ in range(3):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"z{rng.integers(0, 99)}"
            rows.append((int(rng.integers(0, 60)), " ".join(copy)))  # ids repeat
    rows += [(200, None), (201, ""), (202, " "), (203, "one"), (204, "ONE"), (205, prose(9, 30_000)), (None, "one")]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    distinct = sorted({(i is None, i or 0, t or "") for i, t in rows})
    sets = [shingles(t) for _, _, t in distinct]
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(distinct)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for k, (last, i, t) in enumerate(distinct):
        if sets[k]:
            groups.setdefault(find(k), []).append((last, i, t))
    out = P.drop_near_copies(spark, table(spark, rows), labelled)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    assert out.columns == table(spark, []).columns
    assert [x for x in got if not x[2].strip()] == [(False, 200, ""), (False, 201, ""), (False, 202, " ")]
    kept = [x for x in got if x[2].strip()]
    for members in groups.values():
        mine = {x for x in kept if x in members}
        assert len(mine) == 1 and min(x[:2] for x in members) == next(iter(mine))[:2]


def test_mix_against_its_plan(spark, labelled):
    rows = [(i, prose(i, 1 + i % 30), ("a", "b", None)[i % 3]) for i in range(300)] + [(500, None, "a"), (501, "", None), (502, prose(3, 20_000), "b"), (7, "repeat me", "a"), (7, "repeat me", "a")]
    out = P.mix_sources(spark, table(spark, rows), labelled).toPandas()
    size = lambda t: len((t or "").split())
    times = out.groupby(["doc_id", out.text.fillna("-")]).size()
    assert times[500, "-"] == 1 and times[501, ""] == 1
    assert all(n <= (4 if i == 7 else 2) for (i, _), n in times.items())
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    weight, left, free, want = {"a": 5, "b": 2, None: 1}, 1.5 * sum(total.values()), {"a", "b", None}, {}
    while True:
        level = left / sum(weight[s] for s in free)
        if not (over := {s for s in free if level * weight[s] >= 2 * total[s]}):
            break
        want |= {s: 2 * total[s] for s in over}
        left, free = left - sum(2 * total[s] for s in over), free - over
    want |= {s: level * weight[s] for s in free}
    got = {s: sum(size(t) for t, x in zip(out.text, out.source.where(out.source.notna(), None), strict=True) if x == s) for s in want}
    largest = {s: max(size(t) for _, t, x in rows if x == s) for s in want}
    assert all(abs(got[s] - want[s]) <= largest[s] for s in want)


def test_pack_against_the_tokenizer(spark, labelled):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = [(0, None), (1, ""), (2, "a <|endoftext|> b"), (3, prose(1, 9000)), (None, "x"), (4, "same"), (4, "same")] + [(10 + i, prose(i, i)) for i in range(50)]
    out = P.pack_sequences(spark, table(spark, rows), labelled).collect()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    assert sum(r.length for r in out) == sum(map(len, ids))
    for (i, _), want in zip(rows, ids, strict=True):
        if i != 4:
            own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
            assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) for r in out)


def test_stages_of_an_empty_table(spark, labelled):
    docs = table(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, docs, labelled).count() == 0


def test_the_whole_pipeline(spark, sf):
    out = P.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() > 0 and out.join(docs, "doc_id", "left_anti").isEmpty()
