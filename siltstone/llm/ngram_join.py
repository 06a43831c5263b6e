"""N-gram Jaccard join, exact: a partition of the universe with pigeonhole signatures.

A document's set holds 64-bit hashes of its distinct word shingles. Sizes fall into bands; a band fixes how many elements two sets that link may
differ in (bound H), and cuts the universe, by hash, into segments, SPARE for each of H + 1. What a set holds of a segment is its
subset there, and each subset that isn't empty is indexed. Sets that link differ in at most H segments, so

* a set with more than H subsets shares all but H of them, at least, with each set that it links with;
* sparse sets, with H subsets or fewer, post one-deletion neighbourhoods of their subsets too: if no subset that two of them both have differs in
  one element at most, they have H subsets or fewer together;
* for that case sets with H / 2 subsets or fewer look up the elements of their prefix (in hash order), which all sparse sets index: linked
  sets share one. Where H <= 2 there is one segment, and neighbourhoods go H deep.

So every link is found, but for equal 64-bit hashes of different shingles or sets.

Allocation by cost: subsets that no other set has cost nothing and exclude. A set is a candidate only while the subsets that it
shares with any other are as many as a link needs; and of these it looks up the cheapest only (by the length of their postings), leaving out as
many as a link needs less one. That is settled on counts before any pair exists, so a passage in a
third of all documents makes no candidates. What is left forms clusters; a cluster goes to tasks in blocks of bounded size, each pair
of blocks one task, where sizes, a byte for each fine segment (differing bytes bound the difference from below) and union-find
settle most pairs, and the sets themselves decide the others. Only the links that join something are given out.

Signatures travel as packed arrays, a few large rows for each task and bucket. Equal sets share a key and cost one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, graph

SHINGLE, JACCARD = 5, (80, 100)
GROWTH, SPARE, DEEP = 1.6, 1.15, 2
BUCKET_BYTES, BLOCK_BYTES, BLOCK_ROWS, FLUSH_BYTES = 12 << 20, 4 << 20, 512, 4 << 20
ENTRY = np.dtype([("sig", "<u4"), ("key", "<u8"), ("band", "u1"), ("need", "u1")])
U = np.uint64
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of shingle hashes of texts, many texts at a time, by array operations over their bytes."""

    def __init__(self, n: int = 1) -> None:
        self.n = n
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word of a text, A-Z in lower case; words end at ASCII white space."""
        data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        if not len(data):
            return np.zeros(0, dtype=np.uint64)
        self._grow(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        begin, end = edge[::2], edge[1::2]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[: len(data)], dtype=np.uint64)])
        return mix((run[end] - run[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes of many lines at once, the line of each word and its bytes. Lines hold no line feed."""
        data = _LOWER[np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass"), dtype=np.uint8)]
        self._grow(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        begin, end = edge[::2], edge[1::2]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[: len(data)], dtype=np.uint64)])
        hashes = mix((run[end] - run[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        return hashes, np.searchsorted(np.flatnonzero(data == 10), begin), end - begin

    def sets(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the distinct shingles; all words as one if they are fewer than a shingle's."""
        w = self.words(text or "")
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = mix(h * U(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k])
        return np.unique(h)


class Bands:
    """Size bands [low, high) of the smaller set of a pair, the larger sets that it can link with, and their bound."""

    def __init__(self, jaccard: tuple[int, int] = JACCARD) -> None:
        self.share, self.of = jaccard
        self.lows = [1]

    def bound(self, total: int) -> int:
        """The most elements that two sets of ``total`` elements together can differ in and link."""
        return (self.of - self.share) * total // (self.of + self.share)

    def band(self, b: int) -> tuple[int, int, int]:
        """(largest partner, H, segments) of a band."""
        while len(self.lows) < b + 2:
            self.lows.append(max(self.lows[-1] + 1, int(np.ceil(self.lows[-1] * GROWTH))))
        top = self.lows[b + 1] - 1
        partner = top * self.of // self.share
        h = self.bound(top + partner)
        return partner, h, 1 if h <= DEEP else int(np.ceil(SPARE * (h + 1)))

    def of_size(self, n: int) -> list[int]:
        """Bands that a set of ``n`` takes part in: its own, and earlier ones as the larger of a pair."""
        b = 0
        while self.band(b) and self.lows[b + 1] <= n:
            b += 1
        out = [b]
        while b > 0:
            b -= 1
            if self.band(b)[0] < n:
                break
            out.append(b)
        return out


def _salt(band: int, kind: int) -> np.uint64:
    return mix(np.array([band * 4 + kind + 1], dtype=np.uint64))[0]


def signatures(s: np.ndarray, bands: Bands) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, need, signatures): of all subsets that aren't empty, and for sparse sets of their neighbourhoods and prefix.

    ``need`` is how many shared signatures a link takes at least; 0 for signatures that are there to be looked up only.
    """
    for band in bands.of_size(len(s)):
        _, h, m = bands.band(band)
        if m == 1:
            level, every = {(): np.sum(s, dtype=np.uint64)}, []
            for _ in range(h + 1):
                every += list(level.values())
                level = {(*gone, i): total - s[i] for gone, total in level.items() for i in range(gone[-1] + 1 if gone else 0, len(s))}
            yield band, 1, np.unique(mix(np.array(every, dtype=np.uint64) ^ _salt(band, 0)))
            continue
        seg = ((mix(s ^ _salt(band, 1)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        sums, sizes = np.zeros(m, dtype=np.uint64), np.bincount(seg, minlength=m)
        np.add.at(sums, seg, s)
        full = np.flatnonzero(sizes)
        place = mix(np.arange(m, dtype=np.uint64) + _salt(band, 2))
        yield band, max(1, min(255, len(full) - h)), mix(sums[full] ^ place[full])
        if len(full) <= h:  # both sets of a pair may be sparse: subsets and their one-deletions meet here
            apart = _salt(band, 3)
            less = s[sizes[seg] > 1]
            yield band, 1, np.unique(np.concatenate([mix(sums[full] ^ place[full] ^ apart), mix((sums[seg[sizes[seg] > 1]] - less) ^ place[seg[sizes[seg] > 1]] ^ apart)]))
            prefix = s[: len(s) - -(-bands.share * len(s) // bands.of) + 1]
            yield band, int(2 * len(full) <= h), mix(prefix ^ _salt(band, 3) ^ U(1))


def _entries(batches: Iterator[pa.RecordBatch], buckets: int, jaccard: tuple[int, int], shingle: int) -> Iterator[pa.RecordBatch]:
    """Per document a row (doc_id, n, key), dealt to any bucket; per bucket rows of packed signatures."""
    shingler, bands = Shingler(shingle), Bands(jaccard)
    seen: set[int] = set()
    held: list[np.ndarray] = []
    where: list[np.ndarray] = []
    size = 0

    id_type = pa.null()

    def row(doc_ids: pa.Array, n: pa.Array, keys: pa.Array, bucket: pa.Array, packed: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, n, keys, bucket, packed], names=["doc_id", "n", "key", "bucket", "packed"])

    def flush() -> pa.RecordBatch:
        entries, bucket = np.concatenate(held), np.concatenate(where)
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        packed = [entries[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        held.clear()
        where.clear()
        none = pa.nulls(len(packed), pa.int64())
        return row(pa.nulls(len(packed), id_type), none, none, pa.array(bucket[cut[:-1]].astype(np.int32), pa.int32()), pa.array(packed, pa.binary()))

    with np.errstate(over="ignore"):
        for batch in batches:
            id_type = batch.column(0).type
            ns, keys = [], []
            for text in batch.column(1).to_pylist():
                s = shingler.sets(text)
                ns.append(len(s))
                if not len(s):
                    keys.append(None)
                    continue
                key = int(mix(np.array([np.sum(mix(s ^ U(len(s))), dtype=np.uint64)]))[0])
                keys.append(key - (1 << 64) if key >> 63 else key)
                if key in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(key)
                for band, need, sigs in signatures(s, bands):
                    e = np.empty(len(sigs), dtype=ENTRY)
                    e["sig"], e["key"], e["band"], e["need"] = sigs & U(0xFFFFFFFF), key, band, need
                    held.append(e)
                    where.append(((sigs >> U(32)) * U(buckets) >> U(32)).astype(np.int32))
                    size += e.nbytes
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
            dealt = pa.array([i % buckets for i in range(len(ns))], pa.int32())
            yield row(batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), dealt, pa.nulls(len(ns), pa.binary()))
        if held:
            yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' rows as they came, and entries of the signatures that two keys or more have: (key, run, band, need, cost)."""
    names = ["doc_id", "n", "key", "run", "band", "need", "cost"]
    types = [pa.null(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    buckets: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        doc_id, n, key, bucket, packed = batch.columns
        types[0] = doc_id.type
        whole = packed.is_null()
        docs = [c.filter(whole) for c in (doc_id, n, key)]
        yield pa.RecordBatch.from_arrays([*docs, *(pa.nulls(len(docs[0]), t) for t in types[3:])], names=names)
        for b, p in zip(bucket.to_pylist(), packed.to_pylist(), strict=True):
            if p is not None:
                buckets[b].append(p)
    for b in list(buckets):
        e = np.frombuffer(b"".join(buckets.pop(b)), dtype=ENTRY)
        e = e[np.argsort(e["sig"])]
        begin = np.flatnonzero(np.diff(e["sig"].astype(np.int64), prepend=-1))
        # a run is worth something if two sets have it and one of them looks it up
        apart = (np.minimum.reduceat(e["key"], begin) != np.maximum.reduceat(e["key"], begin)) & (np.maximum.reduceat(e["need"], begin) > 0)
        e = e[np.repeat(apart, np.diff(begin, append=len(e)))]
        e = e[np.lexsort((e["key"], e["sig"]))]
        if len(e):
            e = e[np.concatenate([[True], (e["sig"][1:] != e["sig"][:-1]) | (e["key"][1:] != e["key"][:-1])])]
        run = (np.int64(b) << 32) | e["sig"].astype(np.int64)
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        many = np.diff(begin, append=len(e))
        cost = np.repeat(many, many)
        for a in range(0, len(e), 50_000):
            p = e[a : a + 50_000]
            columns = [pa.nulls(len(p), t) for t in types[:2]] + [
                pa.array(np.ascontiguousarray(p["key"]).view(np.int64)), pa.array(run[a : a + 50_000]), pa.array(p["band"].astype(np.int32)),
                pa.array(np.maximum(p["need"], 1).astype(np.int32)), pa.array(cost[a : a + 50_000].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(cluster, key, packed set) from (cluster, key, text); texts of another key (rows that repeat an id) go."""
    shingler = Shingler(shingle)
    with np.errstate(over="ignore"):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for cluster, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingler.sets(text)
                found = int(mix(np.array([np.sum(mix(s ^ U(len(s))), dtype=np.uint64)]))[0])
                if found == key % (1 << 64):
                    for column, value in zip(out, (cluster, key, s.tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["cluster", "key", "packed"])


def links_of(keys: list[int], sets: list[np.ndarray], side: list[bool] | None, bands: Bands) -> list[tuple[int, int]]:
    """Links that join what others haven't: of all pairs, or of pairs across the two sides."""
    order = sorted(range(len(keys)), key=lambda i: (len(sets[i]), keys[i]))
    keys, sets = [keys[i] for i in order], [sets[i] for i in order]
    sides = np.array([side[i] for i in order]) if side else None
    sizes = np.array([len(s) for s in sets])
    wide = int(min(8192, max(64, 1 << int(np.median(sizes)).bit_length()), max(64, (48 << 20) // max(1, len(sets)))))
    fine = np.zeros((len(sets), wide), dtype=np.uint64)
    for i, s in enumerate(sets):
        np.add.at(fine[i], (mix(s) % U(wide)).astype(np.int64), mix(s + U(1)))
    fine = (mix(fine) >> U(56)).astype(np.uint8)
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(sets)):
        stop = int(np.searchsorted(sizes, sizes[i] * bands.of // bands.share, "right"))
        rest = np.arange(i + 1, stop)
        if sides is not None:
            rest = rest[sides[rest] != sides[i]]
        if not len(rest):
            continue
        bound = (bands.of - bands.share) * (sizes[rest] + sizes[i]) // (bands.of + bands.share)
        near = (fine[rest] != fine[i]).sum(axis=1)
        close = near <= bound
        rest, near = rest[close], near[close]
        for j in rest[np.argsort(near, kind="stable")]:
            if find(i) == find(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if bands.of * both >= bands.share * (sizes[i] + sizes[j] - both):
                out.append((keys[i], keys[j]))
                root[find(j)] = find(i)
    return out


def _verified(batches: Iterator[pa.RecordBatch], jaccard: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links of each unit: rows (unit, side, key, packed) come sorted by unit."""
    bands = Bands(jaccard)
    unit, rows = None, []
    found: list[tuple[int, int]] = []

    def settle() -> None:
        if len(rows) > 1:
            sides = [r[0] for r in rows]
            across = [x == 1 for x in sides] if 1 in sides else None
            found.extend(links_of([r[1] for r in rows], [np.frombuffer(r[2], dtype=np.uint64) for r in rows], across, bands))

    def batch_of() -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    with np.errstate(over="ignore"):
        for batch in batches:
            for u, *r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if u != unit:
                    settle()
                    unit, rows = u, []
                rows.append(r)
            yield batch_of()
        settle()
        yield batch_of()


def clusters(shared: DataFrame) -> DataFrame:
    """(node, root) of the keys that still share as many signatures as a link takes, by the runs that one of them looks up.

    A set leaves out its need - 1 costliest shared signatures: what it links with shares need of them at least.
    """
    of = W.partitionBy("key", "band")
    rows = shared.withColumn("n", F.count("*").over(of)).withColumn("need", F.min("need").over(of)).where("n >= need")
    rows = rows.withColumn("looks", F.row_number().over(of.orderBy("cost", "run")) <= F.col("n") - F.col("need") + 1)
    left = common.stored(rows.select("run", "key", "looks"), "candidates")
    first = left.groupBy("run").agg(F.min("key").alias("a"), F.max("key").alias("last"), F.max("looks").alias("looks")).where("looks and a <> last").select("run", "a")
    return graph.components(left.join(first, "run").select("a", F.col("key").alias("b")))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text): doc is what a row counts as, its id (null last) and a hash of its text."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(F.struct(ident.isNull().alias("last"), ident.alias("id"), F.xxhash64(text).alias("row")).alias("doc"), text.alias("text"))


def linked(rows: DataFrame, jaccard: tuple[int, int], shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc, n, key) of the rows (doc, text), key being that of a row's set, and (node, root) of the keys that link."""
    spark = rows.sparkSession
    common.python_ready(spark)
    doc_type = rows.schema["doc"].dataType.simpleString()
    size = rows.agg(F.sum(F.length("text")).alias("n")).collect()[0]["n"] or 0
    # about one word of five characters in three leaves a signature
    buckets = int(max(8, size * ENTRY.itemsize // 15 // BUCKET_BYTES + 1))
    made = rows.mapInArrow(common.in_arrow(lambda b: _entries(b, buckets, jaccard, shingle)), f"doc {doc_type}, n long, key long, bucket int, packed binary")
    met = made.repartition(buckets, "bucket").mapInArrow(common.in_arrow(_shared), f"doc {doc_type}, n long, key long, run long, band int, need int, cost long")
    met = common.stored(met, "shared")
    info, shared = met.where("run is null").select("doc", "n", "key"), met.where("run is not null").select("run", "key", "band", "need", "cost")
    cluster = clusters(shared)
    one = info.where("key is not null").groupBy("key").agg(F.min("doc").alias("doc"))
    picked = cluster.select(F.col("node").alias("key"), F.col("root").alias("cluster")).join(one, "key")
    picked = common.pruning(picked.select("cluster", "key", F.col("doc")["id"].alias("_id"), F.col("doc")["row"].alias("_row")), "picked")
    texts = rows.select(F.col("doc")["id"].alias("id"), F.col("doc")["row"].alias("row"), "text")
    texts = texts.join(picked, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))).select("cluster", "key", "text")
    sets = texts.mapInArrow(common.in_arrow(lambda b: _sets(b, shingle)), "cluster long, key long, packed binary").dropDuplicates(["cluster", "key"])
    with common.runtime_filters(spark):
        sets = common.stored(sets, "sets")
    size_of = F.greatest(F.sum(F.length("packed") + 64) / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)
    blocks = sets.groupBy("cluster").agg(F.ceil(size_of).cast("int").alias("blocks"))
    units = sets.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = units.select(F.xxhash64("cluster", low, high).alias("unit"), (F.col("block") != low).cast("int").alias("side"), "key", "packed")
    tasks = int(max(8, size // (64 << 20)))
    units = units.repartition(tasks, "unit").sortWithinPartitions("unit", "key")
    return info, graph.components(units.mapInArrow(common.in_arrow(lambda b: _verified(b, jaccard)), "a long, b long"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: tuple[int, int] = JACCARD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: component_id is the smallest id reachable by links, its own included.

    Null, empty and blank texts have no shingle and no link. Equal sets link. Rows that repeat an id are documents of
    their own that answer to one name; rows without an id have the smallest id that they link with, if any. Ids are of any type that has an order.
    An empty table gives an empty result; texts of any length are read whole; other columns are ignored.
    """
    info, found = linked(rows_of(docs, id_col, text_col), jaccard, shingle)
    by_key = info.where("key is not null").groupBy("key").agg(F.min("doc").alias("first"))
    rooted = common.stored(by_key.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("smallest"))
    names = rooted.join(names, "root").select("key", F.col("smallest")["id"].alias("component_id"))
    own = F.col("doc")["id"]
    return info.join(names, "key", "left").select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), jaccard=(85, 100), shingle=4)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: tuple[int, int] = JACCARD, shingle: int = SHINGLE) -> DataFrame:
    """Of each connected group the row with the smallest id (null last); all columns as they are.

    Rows count by id and text: of rows that repeat an id with different texts each stays or goes by its own links, and rows
    that repeat both stay or go together. Texts without words stay. An empty table gives an empty result.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # of our own, so that no column's name clashes
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    ident, text = F.col(names[id_col]), F.col(names[text_col])
    info, found = linked(rows_of(docs, id_col, text_col), jaccard, shingle)
    rooted = info.where("key is not null").select("doc", "key").distinct().join(found.withColumnRenamed("node", "key"), "key", "left")
    rooted = common.stored(rooted.select("doc", F.coalesce("root", "key").alias("root")), "rooted")
    keep = rooted.groupBy("root").agg(F.min("doc").alias("keep"))
    gone = rooted.join(keep, "root").where(F.col("doc") != F.col("keep"))
    gone = common.stored(gone.select(F.col("doc")["id"].alias("_id"), F.col("doc")["row"].alias("_row")), "near-copies")
    out = rows.join(gone, ident.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_row")), "left_anti")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
