"""SimHash near-dedup by tiled exact comparison: no pair of fingerprints within the radius is missed.

1. A document's fingerprint has a bit for each bit that is set in over half of the hashes of its shingles, repeats included.
   Equal fingerprints are one from here on, however many documents have them.
2. Two fingerprints differ in at least as many bits as the population counts of their parts do, added up. Fingerprints are
   dealt to tiles by the counts of their two halves (and by a hash where those have more than TILE): a tile meets
   only the tiles whose counts lie within the radius. One of the two is sent to the other, as one packed row.
3. In a task a tile and what it meets are ordered by the counts of their quarters, and blocks whose counts differ beyond
   the radius are skipped again. The rest is compared whole: exclusive-or and a bit count over blocks of BLOCK pairs.
4. A task gives a spanning forest of the links that it finds, never all pairs of a group; components() does the rest.

Every fingerprint meets those of about 40 neighbouring tiles' worth of counts, half of them by being sent: 20 copies of 8 bytes where tiles are
not full. Comparisons grow with the square of the number of different fingerprints, about an eighth of which are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

RADIUS, SHINGLE, SEED = 4, 4, 42
TILE, BLOCK = 1 << 16, 1 << 20
SLICE = 1 << 14  # hashes whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, and words end at ASCII space
    if not words:
        return 0
    whole = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(begins[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SLICE):
        part = hashes[a : a + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["id", "print"])


def _quarters(x: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters, a row for each fingerprint."""
    return np.bitwise_count(x[:, None] >> np.array([48, 32, 16, 0], np.uint64) & np.uint64(0xFFFF)).astype(np.int16)


class Side:
    """Fingerprints in order of their quarters' counts: ``counts`` has those of each run of equal ones, ``cut`` where it begins."""

    def __init__(self, x: np.ndarray) -> None:
        q = _quarters(x)
        order = np.lexsort(q.T)
        self.x, q = x[order], q[order]
        first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]).any(axis=1)]))
        self.counts, self.size, self.cut = q[first], np.diff(first, append=len(x)), first


def meetings(own: Side, guest: Side, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs within the radius, block by block; of one side with itself those with i < j."""
    for k in range(len(own.cut)):
        near = np.abs(guest.counts - own.counts[k]).sum(axis=1) <= radius
        if own is guest:
            near[:k] = False
        if not near.any():
            continue
        others = np.flatnonzero(np.repeat(near, guest.size))
        against = guest.x[others]
        a, b = int(own.cut[k]), int(own.cut[k] + own.size[k])
        step = max(1, BLOCK // len(others))
        for c in range(a, b, step):
            for g in range(0, len(others), BLOCK):
                i, j = np.nonzero(np.bitwise_count(own.x[c : min(b, c + step), None] ^ against[None, g : g + BLOCK]) <= radius)
                i, j = i + c, others[j + g]
                if own is guest:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j


class Forest:
    """Groups of numbers that have met so far."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        """Which of the links (i, j) join groups that no link before them has joined."""
        a, b = self.top[i], self.top[j]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return []
        _, first = np.unique(np.minimum(a, b)[open_] * len(self.top) + np.maximum(a, b)[open_], return_index=True)
        up: dict[int, int] = {}

        def find(r: int) -> int:
            while (above := up.get(r, r)) != r:
                up[r] = up.get(above, above)
                r = above
            return r

        used = []
        for at in open_[first].tolist():
            x, y = find(int(a[at])), find(int(b[at]))
            if x != y:
                up[max(x, y)] = min(x, y)
                used.append(at)
        moved = np.arange(len(self.top))
        for r in list(up):
            moved[r] = find(r)
        self.top = moved[self.top]
        return used


def _met(batches: Iterator[pa.RecordBatch], radius: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (home, guest, prints), which come sorted: a home's own fingerprints first."""
    home, own, own_top, waiting = None, None, None, []

    def links(guest: Side | None) -> Iterator[pa.RecordBatch]:
        nonlocal own_top
        n = len(own.x)
        groups = Forest(n + (0 if guest is None else len(guest.x)))
        groups.top[:n] = own_top
        for i, j in meetings(own, own if guest is None else guest, radius):
            used = groups.join(i, j if guest is None else j + n)
            if used:
                a, b = own.x[i[used]], (own if guest is None else guest).x[j[used]]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        own_top = groups.top[:n].copy()  # the smallest number of a group stands for it: one of the home's own

    def settle() -> Iterator[pa.RecordBatch]:
        if waiting:
            yield from links(Side(np.concatenate(waiting)))
            waiting.clear()

    for batch in batches:
        prints = batch.column(2)
        for k, (h, guest) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            x = prints[k].values.to_numpy().view(np.uint64)
            if h != home:
                yield from settle()
                assert not guest  # a home's own row is there whenever others are sent to it
                home, own, own_top = h, Side(x), np.arange(len(x))
                yield from links(None)
            else:
                waiting.append(x)
                if sum(map(len, waiting)) >= tile:
                    yield from settle()
    yield from settle()


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between the different fingerprints of ``prints`` (column print) that join all that are within the radius, step by step."""
    common.python_ready(prints.sparkSession)
    half = [F.bit_count(F.shiftrightunsigned("print", 32)), F.bit_count(F.col("print").bitwiseAND(F.lit((1 << 32) - 1)))]
    rows = prints.select("print", half[0].cast("int").alias("p"), half[1].cast("int").alias("q"))
    cells = rows.groupBy("p", "q").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # 33 * 33 rows at most: a bound for broadcasts
    cells = common.stored(cells, "cells")
    dealt = rows.join(F.broadcast(cells), ["p", "q"]).withColumn("s", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    tiles = dealt.groupBy("p", "q", "s").agg(F.collect_list("print").alias("prints"))
    reach = range(-radius, radius + 1)
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in product(reach, reach) if abs(x) + abs(y) <= radius])
    near = cells.select(F.col("p").alias("hp"), F.col("q").alias("hq"), F.col("parts").alias("n"))
    sent = tiles.withColumn("step", F.explode(steps)).join(F.broadcast(near), (F.col("hp") == F.col("p") + F.col("step.x")) & (F.col("hq") == F.col("q") + F.col("step.y")))
    sent = sent.withColumn("hs", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place, home = F.struct("p", "q", "s"), F.struct(F.col("hp").alias("p"), F.col("hq").alias("q"), F.col("hs").alias("s"))
    sent = sent.where(home >= place).select(((F.col("hp") * 33 + F.col("hq")).cast("long") * (1 << 40) + F.col("hs")).alias("home"), (home != place).alias("guest"), "prints")
    sent = sent.repartition("home").sortWithinPartitions("home", "guest")
    return sent.mapInArrow(common.in_arrow(lambda b: _met(b, radius, tile)), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, print, component_id) for each row: print is the fingerprint's 64 bits as a long, component_id the smallest id reachable by links.

    Null, empty and blank texts have the fingerprint 0, which links like any other. Rows that repeat an id are rows of their own
    that answer to one name; a row without an id has the smallest id that it links with, if any. Ids are of any type that has an
    order. An empty table gives an empty result; texts of any length are read whole; other columns are ignored.
    """
    common.python_ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    made = common.stored(rows.mapInArrow(common.in_arrow(lambda b: _fingerprints(b, shingle)), f"id {id_type}, print long"), "prints")
    one = common.stored(made.groupBy("print").agg(F.min("id").alias("first")), "different")
    found = graph.components(links(one.select("print"), radius, tile))
    rooted = one.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    rooted = common.stored(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    names = rooted.join(names, "root").select("print", "component_id")
    return made.join(names, "print").select(F.col("id").alias("doc_id"), "print", "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
