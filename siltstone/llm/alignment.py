"""Alignment of two tokenizers over the same texts: groups of tokens that cover the same bytes, and how often tokens are linked.

A is a byte-level vocabulary, which reads a space and the text; B a vocabulary of pieces, which adds the space itself.

1. Both begin anew at a space that follows anything but white space, so texts are cut there into segments, and of equal
   segments of a block of texts one is encoded. The block's different segments stand end to end on one axis of bytes.
2. DuckDB aligns them in the task that holds the block, on tables of token intervals: an ASOF join finds the token of B that
   covers the first byte of each token of A; where both begin there a group does; window sums of these beginnings number the
   groups, a second ASOF join gives B's tokens theirs, and a range join inside groups says which linked tokens overlap.
3. A block gives each of its texts as numbers of the block's id pairs, and each pair with the number of the block's texts that
   hold it. These partial counts are merged in Spark and come back to the blocks that have the pair: a pair is one row of a
   block, however often it stands there.
4. Each block's texts add up the counts of what they hold.

A block is BLOCK_CHARS characters of text at every size of the table; a longer text is a block of its own. Its different
segments go to DuckDB SLICE tokens at a time, so that memory depends on neither.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, packing

BLOCK_CHARS, SLICE, LINKS_AT_ONCE = 4 << 20, 1 << 19, 1 << 19
MARK = "▁"  # the space of B; a text that holds one can't be told from a text with a space
ODD = re.compile(r"\s ")  # in a space and a text: some space is no cut
SIGNS = (",", "|", ";", "")
RUN = 2000  # segments that A encodes as one text
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]

#: On tables a and b (seg, place, id, first, last): intervals of tokens in order of their bytes.
GROUPED = """
CREATE OR REPLACE TEMP TABLE ga AS
SELECT a.seg, a.place, a.id, a.first, a.last, sum((a.first = b.first)::INT) OVER (ORDER BY a.first ROWS UNBOUNDED PRECEDING) - 1 AS grp
FROM a ASOF JOIN b ON a.first >= b.first;
CREATE OR REPLACE TEMP TABLE gb AS
SELECT b.place, b.id, b.first, b.last, g.grp
FROM b ASOF JOIN (SELECT grp, min(first) AS first FROM ga GROUP BY grp) g ON b.first >= g.first;
CREATE OR REPLACE TEMP TABLE linked AS
SELECT a.seg, a.id AS a, b.id AS b, a.first < b.last AND b.first < a.last AS overlap FROM ga a JOIN gb b ON a.grp = b.grp;
"""
GROUPS_OF = "SELECT grp::BIGINT AS grp FROM {} ORDER BY place"
LINKS = "SELECT seg, a, b, count(*) AS times, count(*) FILTER (overlap) AS overlaps FROM linked GROUP BY seg, a, b ORDER BY seg"


class Pieces:
    """B: ids of texts, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.space = self.model.piece_to_id(MARK)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [ids or [self.space] for ids in self.model.encode(texts, num_threads=1)]  # an empty text leaves the space that is added


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> tuple[packing.Encoder, np.ndarray, Pieces, np.ndarray]:
    """(A, the number of bytes that each id of A has, B, ids as text with each of the SIGNS that may follow)."""
    a, b = packing.encoder(a_path), Pieces(b_path)
    size = np.zeros(a.encoding.max_token_value + 1, np.int64)
    for token in a.encoding.token_byte_values():
        size[a.encoding.encode_single_token(token)] = len(token)
    text = np.array([[f"{i}{sign}" for i in range(max(len(size), len(b.bytes)))] for sign in SIGNS], dtype=object)
    return a, size, b, text


def segments(text: str) -> list[str]:
    """The segments of a space and ``text``, each without the space that it begins with."""
    parts = text.split(" ")
    if not ODD.search(" " + text):
        return parts
    out = parts[:1]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


def runs(keys: list[str]) -> Iterator[tuple[int, int]]:
    """(first, last) of segments that A may encode as one text: what ends in white space, or is nothing but its space, ends a run."""
    first = 0
    for i, k in enumerate(keys):
        if not k or k[-1].isspace() or i + 1 - first == RUN:
            yield first, i + 1
            first = i + 1
    if first < len(keys):
        yield first, len(keys)


class Aligned:
    """What different segments have: counts (a row a segment, columns COUNTS), groups as text, and links as (segment, pair key, times), sorted."""

    def __init__(self, keys: list[str], a_path: str, b_path: str) -> None:
        a, size_a, b, text_of = vocabularies(a_path, b_path)
        self.bad = np.zeros(len(keys), bool)
        ids_a, ids_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n_a, n_b = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for p, q in runs(keys):
            run = keys[p:q]
            whole = " " + " ".join(run)
            stops = np.cumsum([len(k.encode()) + 1 for k in run])
            made = np.frombuffer(a.plain(whole), dtype="<u4").astype(np.int64)
            ids_a.append(made)
            n_a[p:q] = np.diff(np.searchsorted(np.cumsum(size_a[made]), stops, side="right"), prepend=0)
            each = b(run)
            n_b[p:q] = [len(ids) for ids in each]
            flat = list(chain.from_iterable(each))
            if b"".join(map(b.bytes.__getitem__, flat)) != whole.encode():
                self.bad[p:q] = [(" " + k).encode() != b"".join(map(b.bytes.__getitem__, ids)) for k, ids in zip(run, each, strict=True)]
            ids_b.append(np.array(flat, dtype=np.int64))
        # ids of all segments end to end, and where each one's begin
        ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
        up_a, up_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        self.counts = np.zeros((len(keys), len(COUNTS)), np.int64)
        self.text = [""] * len(keys)
        links = [np.zeros((3, 0), np.int64)]
        good = np.flatnonzero(~self.bad)
        ends = np.cumsum(np.maximum(np.diff(up_a), np.diff(up_b))[good])
        at = 0
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            while at < len(good):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
                own = good[at:to]
                sides = []
                for ids, up, size in ((ids_a, up_a, size_a), (ids_b, up_b, b.size)):
                    many = up[own + 1] - up[own]
                    seg = np.repeat(np.arange(len(own)), many)
                    sides.append((ids[np.arange(len(seg)) + np.repeat(up[own] - np.cumsum(many) + many, many)], seg, size))
                links.append(self._slice(con, own, sides, text_of))
                at = to
        self.links = np.concatenate(links, axis=1)

    def _slice(self, con: duckdb.DuckDBPyConnection, own: np.ndarray, sides: list[tuple], text_of: np.ndarray) -> np.ndarray:
        for name, (ids, seg, size) in zip("ab", sides, strict=True):
            last = np.cumsum(size[ids])
            con.register(name, pa.table({"seg": seg, "place": np.arange(len(ids)), "id": ids, "first": last - size[ids], "last": last}))
        con.execute(GROUPED)
        (ids_a, seg_a, _), (ids_b, seg_b, size_b) = sides
        grp_a, grp_b = (con.sql(GROUPS_OF.format(t)).to_arrow_table()["grp"].to_numpy() for t in ("ga", "gb"))
        held = con.sql(LINKS).to_arrow_table()
        seg, x, y, times, overlaps = (held[c].to_numpy() for c in ("seg", "a", "b", "times", "overlaps"))
        for name in ("a", "b"):
            con.unregister(name)
        new = np.diff(grp_a, prepend=-1) > 0  # first tokens of groups
        n = len(own)
        self.counts[own] = np.stack([np.bincount(seg_a, minlength=n), np.bincount(seg_b, minlength=n), np.bincount(seg_a[new], minlength=n), np.bincount(seg, times, n), np.bincount(seg, overlaps, n)], axis=1)
        # groups in order, A's ids before B's: each id with the sign that follows it
        n_group = int(grp_a[-1]) + 1
        up_a, up_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_group))]) for g in (grp_a, grp_b))
        written = np.empty(len(ids_a) + len(ids_b), dtype=object)
        at_a, at_b = np.arange(len(ids_a)) + up_b[grp_a], np.arange(len(ids_b)) + up_a[grp_b + 1]
        sign_a = np.where(np.diff(grp_a, append=n_group) > 0, 1, 0)
        sign_b = np.where(np.diff(grp_b, append=n_group) > 0, np.where(np.diff(seg_b, append=n) > 0, 3, 2), 0)
        written[at_a], written[at_b] = text_of[sign_a, ids_a], text_of[sign_b, ids_b]
        written = written.tolist()
        stop = np.cumsum(self.counts[own, 0] + self.counts[own, 1]).tolist()
        for i, p, q in zip(own.tolist(), [0, *stop], stop, strict=False):
            self.text[i] = "".join(written[p:q])
        return np.stack([own[seg], x * len(size_b) + y, times])


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes each as hold all of them."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return width, x.astype(f"<u{width}").tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, a_path: str, b_path: str, chars: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """A row for each text (pair is null) and for each id pair of a block: see align()."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 24
    held: list[tuple] = []
    n_b = len(vocabularies(a_path, b_path)[2].bytes)
    names = ["block", "pair", "id", *COUNTS, "groups", "held", "a", "b", "texts"]
    types = [pa.int64(), pa.int64(), id_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal block
        known: dict[str, int] = {}
        texts = [t or "" for _, t in held]
        own = [np.array([known.setdefault(k, len(known)) for k in segments(t)] if t and MARK not in t else [], dtype=np.int64) for t in texts]
        del texts
        segs = Aligned(list(known), a_path, b_path)
        known.clear()
        if segs.bad.any():
            own = [o[:0] if segs.bad[o].any() else o for o in own]
        flat = np.concatenate(own)
        end = np.cumsum([len(o) for o in own])
        up = np.concatenate([np.zeros((1, len(COUNTS)), np.int64), np.cumsum(segs.counts[flat], axis=0)])
        counts = np.diff(up[np.concatenate([[0], end])], axis=0)
        joined = (";".join(map(segs.text.__getitem__, o.tolist())) for o in own)
        groups = list(joined) if whole else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in joined]
        # the links of each text, equal ones added up; of so many texts at once that memory is bounded
        keys, pair_of = np.unique(segs.links[1], return_inverse=True)
        first = np.searchsorted(segs.links[0], np.arange(len(segs.text) + 1))
        times_of, n_keys = segs.links[2], max(1, len(keys))
        n_links = np.concatenate([[0], np.cumsum(np.diff(first)[flat])])[np.concatenate([[0], end])]
        start = np.concatenate([[0], end])
        packed, held_by, a = [], np.zeros(n_keys, np.int64), 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(n_links, n_links[a] + LINKS_AT_ONCE, side="right")) - 1)
            segs_of = flat[start[a] : start[b]]
            many = np.diff(first)[segs_of]
            of = np.repeat(np.repeat(np.arange(b - a), np.diff(start[a : b + 1])), many)
            at = np.arange(len(of)) + np.repeat(first[segs_of] - np.cumsum(many) + many, many)
            joint = of * n_keys + pair_of[at]
            order = np.argsort(joint)
            joint = joint[order]
            new = np.flatnonzero(np.diff(joint, prepend=-1))
            times = np.add.reduceat(times_of[at[order]], new) if len(new) else np.zeros(0, np.int64)
            of, pair = joint[new] // n_keys, joint[new] % n_keys
            held_by += np.bincount(pair, minlength=n_keys)
            cut = np.searchsorted(of, np.arange(b - a + 1))
            for p, q in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                (w, steps), (v, own_times) = _narrow(np.diff(pair[p:q], prepend=0)), _narrow(times[p:q])
                packed.append(bytes([w, v]) + steps + own_times)
            a = b
        n, none = len(own), pa.nulls
        columns = [pa.array(np.full(n, block)), none(n, types[1]), pa.array([i for i, _ in held], id_type), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(groups, pa.string()), pa.array(packed, pa.binary()), *[none(n, pa.int64())] * 3]
        for a in range(0, n, 1000):
            yield pa.RecordBatch.from_arrays([c[a : a + 1000] for c in columns], names=names)
        m = len(keys)
        columns = [pa.array(np.full(m, block)), pa.array(np.arange(m)), none(m, id_type), *[none(m, t) for t in types[3:10]], pa.array(keys // n_b), pa.array(keys % n_b), pa.array(held_by[:m])]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        held.clear()
        block += 1

    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py()
            if held and size + len(t or "") > chars:
                yield from settle()
                size = 0
            held.append((i, t))
            size += len(t or "")
    if held:
        yield from settle()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with what their links add up to; rows (block, pair, id, COUNTS, groups, held, count, best) come sorted by block, pairs first, in order."""
    block, count, best, fresh = None, [], [], False
    for batch in batches:
        blocks, pairs = batch.column(0).to_numpy(), ~np.asarray(batch.column(1).is_null())
        counted, is_best = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (pairs[1:] != pairs[:-1])]))
        for p, q in zip(edges.tolist(), [*edges[1:].tolist(), len(batch)], strict=True):
            if blocks[p] != block:
                block, count, best, fresh = blocks[p], [np.zeros(0, np.int64)], [np.zeros(0, bool)], True
            if pairs[p]:
                count.append(counted.slice(p, q - p).to_numpy())
                best.append(is_best.slice(p, q - p).to_numpy(zero_copy_only=False).astype(bool))
                continue
            if fresh:
                counts, tops, fresh = np.concatenate(count), np.concatenate(best), False
            n_best, total = np.zeros(q - p, np.int64), np.zeros(q - p, np.int64)
            for k, packed in enumerate(batch.column("held").slice(p, q - p).to_pylist()):
                w, v = packed[0], packed[1]
                n = (len(packed) - 2) // (w + v)
                pair = np.cumsum(np.frombuffer(packed, f"<u{w}", n, 2), dtype=np.int64)
                times = np.frombuffer(packed, f"<u{v}", n, 2 + w * n).astype(np.int64)
                n_best[k], total[k] = times[tops[pair]].sum(), (times * counts[pair]).sum()
            rows = batch.slice(p, q - p)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("id", *COUNTS)], pa.array(n_best), pa.array(total), rows.column("groups")], names=["id", *COUNTS, "n_best", "count_sum", "groups"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, texts, best) of the blocks of align(): how many texts hold an id pair linked, and whether no pair of the same id of A is in more."""
    counts = blocks.where("pair is not null").groupBy("a", "b").agg(F.sum("texts").alias("texts"))
    return counts.withColumn("best", F.col("texts") == F.max("texts").over(W.partitionBy("a")))  # as many rows as B has ids, at most


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True, chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of aligned texts, stored: rows of texts (block, id, counts, groups, held) and rows of the id pairs of a block (block, pair, a, b, texts).

    ``groups`` is written like ``a1,a2|b1;a3|b2,b3``, or as its SHA-256 where ``whole`` is false.
    """
    spark = docs.sparkSession
    common.python_ready(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType
    arrow_type = to_arrow_type(id_type)
    schema = f"block long, pair long, id {id_type.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, groups string, held binary, a long, b long, texts long"
    return common.stored(rows.mapInArrow(common.in_arrow(lambda b: _blocks(b, arrow_type, a_path, b_path, chars, whole)), schema), "aligned")


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True, chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups) for each row.

    Null and empty texts, and those that B can't give back byte by byte (that hold its mark for a space), have no tokens: zeros,
    and '' for groups. Rows that repeat an id are texts of their own; ids of any type stay as they are, nulls too. An empty table gives an
    empty result; texts of any length are read whole (one without any space is one segment, which a task has to hold); other columns are ignored.
    """
    blocks = align(docs, a_path, b_path, id_col, text_col, whole, chars)
    counts = pair_counts(blocks)
    asked = blocks.where("pair is not null").select("block", "pair", "a", "b").join(counts, ["a", "b"]).select("block", "pair", "texts", "best")
    texts = blocks.where("pair is null").select("block", "pair", "id", *COUNTS, "groups", "held")
    both = texts.unionByName(asked, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    id_type = texts.schema["id"].dataType.simpleString()
    found = both.mapInArrow(common.in_arrow(_summed), f"id {id_type}, {', '.join(f'{c} long' for c in [*COUNTS, 'n_best', 'count_sum'])}, groups string")
    return found.withColumnRenamed("id", "doc_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), whole=False)
    return found.withColumnRenamed("groups", "groups_sha256")
