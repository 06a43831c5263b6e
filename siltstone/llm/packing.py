"""Harmonic packing of tokenised documents into sequences of one capacity.

A document's ids (and the separator) are cut into full sequences, then into powers of two down to SMALL, then one rest.
Lengths fall into reciprocal-capacity classes: class k takes lengths in (capacity / (k + 1), capacity / k], and a bin of
class k holds k pieces, so it never overflows whatever they are. Full and power-of-two classes (1, 2, 4, ...) fill their
bins to the last id. Every task fills bins of its own from the rows that it reads: no shuffle, no shared state, and a
lost task repeats to the same ids. What a task has left in open bins (under one bin for each class) goes first-fit by decreasing
length into its last sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

CAPACITY = 2048
SMALL = 128
SEPARATOR = 1
#: How a byte-level vocabulary of this family cuts text into pieces, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id {id}, start long, length long, {ids}, doc_tokens long, sequence_id long, offset long"
FLUSH_BYTES = 2 << 20
LONG_RUN = re.compile(r"[^\S\x1C-\x1F]{1000,}")


class Encoder:
    """Ids as little-endian 32-bit integers, as the vocabulary's own library gives them without special tokens added.

    An added token's string in a text is that token; what lies between such strings is encoded part by part.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def piece(self) -> tiktoken.Encoding:
        """Takes a text as one piece; made for the first long run of white space, as workers keep what they have made."""
        return tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.cut is None or not any(token in text for token in self.added):
            return self.plain(text)
        return b"".join(self.added[part] if part in self.added else self.plain(part) for part in self.cut.split(text) if part)

    def plain(self, text: str) -> bytes:
        """Ids of a text whose strings of added tokens are text like any other."""
        if not LONG_RUN.search(text):
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        # a run of white space is one piece but for its last character, which goes with what follows; said here, as the
        # pattern's look-ahead can't step back over runs of any length
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids = self.piece.encode_to_numpy(text[run.start() : stop], disallowed_special=()).astype("<u4")
            out += [self.plain(text[at : run.start()]), ids.tobytes()]
            at = stop
        return b"".join([*out, self.plain(text[at:])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(length: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Lengths of a document's pieces: full ones, powers of two, and a rest under ``small``."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest >= small:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


def _first_fit(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    bins: list[list] = []
    room: list[int] = []
    for p in sorted(pieces, key=lambda p: -p[2]):
        at = next((i for i, r in enumerate(room) if r >= p[2]), None)
        if at is None:
            bins.append([])
            room.append(capacity)
            at = len(bins) - 1
        bins[at].append(p)
        room[at] -= p[2]
    return bins


def _pack(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, path: str, capacity: int, separator: int | None, digest: bool) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), b"" if separator is None else separator.to_bytes(4, "little")
    sequence = TaskContext.get().partitionId() << 40
    classes: dict[int, list] = defaultdict(list)
    ready: list[tuple] = []
    size = 0
    ids_type = pa.int64() if digest else pa.binary()
    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
    types = [id_type, pa.int64(), pa.int64(), ids_type, pa.int64(), pa.int64(), pa.int64()]

    def close(pieces: list[tuple]) -> None:
        nonlocal sequence, size
        offset = 0
        for p in pieces:
            ready.append((*p, sequence, offset))
            offset += p[2]
        size += 4 * offset
        sequence += 1

    def flush() -> pa.RecordBatch:
        nonlocal size
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], names=names)
        ready.clear()
        size = 0
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = memoryview(encode(text.as_py() or "") + end)
            tokens, start = len(ids) // 4, 0
            for length in cuts(tokens, capacity):
                k = capacity // length
                bin_ = classes[k]
                own = ids[4 * start : 4 * (start + length)]
                bin_.append((doc_id, start, length, zlib.crc32(own) if digest else own.tobytes(), tokens))
                start += length
                if len(bin_) == k:
                    close(bin_)
                    classes[k] = []
            if size >= FLUSH_BYTES:
                yield flush()
    for pieces in _first_fit([p for c in classes.values() for p in c], capacity):
        close(pieces)
    if ready:
        yield flush()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int | None = SEPARATOR, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    With ``digest`` the ids' crc32 (ids_crc32) comes in place of the ids, so they never leave the task. Null texts are
    empty: a document of the separator alone (without a separator, no piece). Rows that repeat an id are
    documents of their own; ids of any type stay as they are, nulls too. An empty table gives an
    empty result; texts of any length are packed whole. Other columns are ignored.
    """
    common.python_ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    schema = SCHEMA.format(id=id_type.simpleString(), ids="ids_crc32 long" if digest else "ids binary")
    return rows.mapInArrow(common.in_arrow(lambda batches: _pack(batches, arrow_type, path, capacity, separator, digest)), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path(), digest=True)
