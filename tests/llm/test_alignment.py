"""Alignment against both tokenizers' own libraries, token by token."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siltstone.llm import alignment, queries

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, block string, pair int, texts long, held long, a string, b int"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  two  spaces   three  ", "a\nb \n c\n\n d", "tab\tand\x0bother\x0c white\r\nspace ", "\n", " \n ", "x\x1c y\x1d z\x85 w", "no break 　wide  em",
    "naïve café Ünïcödé ß", "日本語のテキスト。 空白なし", "emoji 😀👩‍👩‍👧 flags 🇩🇪", "<|endoftext|> <s></s> <unk> <0x0A> <pad>", "mark ▁ here", "▁", "a▁b", "nul \x00 byte", "ﬁ ligature Ａ wide ①",
    "don't I'll we've 'S 's", "1234567 3.14 1,000,000", "x" * 3000, "-" * 500 + " " + "=" * 300, " " * 3000 + "end", "end" + " " * 2500, "\n" * 1500 + "x", "a" + " \t" * 900 + "b", "é combining ​zero", "﻿bom � replacement",
]


@pytest.fixture(scope="module")
def own_libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def bytes_of_a(token):
    return bytes(BYTE[c] for c in token)


def plain(texts, libraries):
    """Rows (n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups)."""
    a, b = libraries
    made = []
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            parts_a = [bytes_of_a(a.id_to_token(i)) for i in ids_a]
            parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(parts_a) == whole == b"".join(parts_b):
                ends_b, at, j = [], 0, 0
                for p in parts_b:
                    at += len(p)
                    ends_b.append(at)
                both, at = set(ends_b), 0
                own_a = []
                for i, p in zip(ids_a, parts_a, strict=True):
                    own_a.append((i, at, at + len(p)))
                    at += len(p)
                    if at in both:
                        own_b = []
                        while j < len(ids_b) and ends_b[j] <= at:
                            own_b.append((ids_b[j], ends_b[j] - len(parts_b[j]), ends_b[j]))
                            j += 1
                        groups.append((own_a, own_b))
                        own_a = []
        made.append(groups)
    held, best = Counter(), defaultdict(int)
    for groups in made:
        held.update({(x[0], y[0]) for p, q in groups for x in p for y in q})
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for groups in made:
        links = [(x, y) for p, q in groups for x in p for y in q]
        overlaps = sum(x[1] < y[2] and y[1] < x[2] for x, y in links)
        counts = [held[x[0], y[0]] for x, y in links]
        text = ";".join(",".join(str(x[0]) for x in p) + "|" + ",".join(str(y[0]) for y in q) for p, q in groups)
        rows.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), overlaps, sum(n == best[x[0]] for n, (x, _) in zip(counts, links, strict=True)), sum(counts), text))
    return rows


def table(spark, texts):
    return spark.createDataFrame([(i, t, "i", "k", 1, 2, 3, "a", 4) for i, t in enumerate(texts)], SCHEMA).repartition(3, "doc_id")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("chars", [alignment.BLOCK_CHARS, 50])
def test_odd_texts(spark, own_libraries, chars):
    texts = [*ODD, *["a hot text of many copies"] * 30, "The " * 400 + "end"]
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.alignment(table(spark, texts), A_PATH, B_PATH, chars=chars).collect()}
    want = plain(texts, own_libraries)
    assert [(texts[i], got[i]) for i in range(len(texts))] == list(zip(texts, want, strict=True))
    assert alignment.alignment(table(spark, []), A_PATH, B_PATH).count() == 0


def test_segments_are_encoded_like_whole_texts(own_libraries):
    """Each tokenizer begins anew at a cut: ids of segments are the ids of the text."""
    a, size, b, _ = alignment.vocabularies(A_PATH, B_PATH)
    for text in ODD:
        if text and alignment.MARK not in text:
            own = alignment.segments(text)
            assert "".join(" " + s for s in own) == " " + text
            assert b"".join(a.plain(" " + s) for s in own) == b"".join(i.to_bytes(4, "little") for i in own_libraries[0].encode(" " + text, add_special_tokens=False).ids)
            assert [i for ids in b(own) for i in ids] == own_libraries[1].encode(text)


def test_slices_change_nothing(spark, monkeypatch):
    texts = [t for t in ODD if t] * 2
    keys = list(dict.fromkeys(s for t in texts if alignment.MARK not in t for s in alignment.segments(t)))
    whole = alignment.Aligned(keys, A_PATH, B_PATH)
    monkeypatch.setattr(alignment, "SLICE", 7)
    cut = alignment.Aligned(keys, A_PATH, B_PATH)
    order = [x.links[:, [*sorted(range(x.links.shape[1]), key=lambda i: tuple(x.links[:, i]))]].tolist() for x in (whole, cut)]  # noqa: B023
    assert (whole.counts == cut.counts).all() and whole.text == cut.text and order[0] == order[1]


def test_pair_counts_and_ids(spark):
    rows = spark.createDataFrame([("x", "one two"), ("y", "one two one"), (None, "two"), ("x", "one")], "name string, body string")
    blocks = alignment.align(rows, A_PATH, B_PATH, "name", "body")
    assert sorted(r.texts for r in alignment.pair_counts(blocks).collect()) == [3, 3]
    got = sorted((r.doc_id or "", r.n_a, r.count_sum) for r in alignment.alignment(rows, A_PATH, B_PATH, "name", "body").collect())
    assert got == [("", 1, 3), ("x", 1, 3), ("x", 2, 6), ("y", 3, 9)]


def test_the_query(spark, sf, own_libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in [*COLUMNS[:-1], "groups_sha256"]) for r in queries.QUERIES["op11_alignment"](spark, sf).collect()}
    want = plain([r.text for r in docs], own_libraries)
    assert got == {r.doc_id: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for r, w in zip(docs, want, strict=True)}
