"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, verified edit similarity, one occurrence kept per group.

1. Lines are known by 128 bits of a digest; equal ones are counted by it, without their texts.
2. A line is normalised (lower case, marks to single spaces) and sketched by a SimHash of its words. Its blocks come from the
   pigeonhole principle on its runs of characters: of two similar lines most runs stay whole, so each of TABLES seeded orders of the
   runs takes the first and the last of a line as its block. Two lines whose runs have a Jaccard similarity J share a block with
   probability 1 - (1 - J * J) ** TABLES, whatever the number of lines; bits of the SimHash itself as blocks would need
   many more blocks for that (README has the figures).
3. Lines that share a block and whose sketches differ in SKETCH_BITS at most are candidates: all pairs of a block of up to SMALL lines. In larger
   blocks a first round joins each line with the block's smallest, and a second compares all
   pairs that the first has left in different groups, each in the first block that it shares, in tiles of bounded size that hold their lines' texts.
4. Candidates of the first round fetch their lines; pairs stay if the edit similarity of their characters reaches SIMILARITY, whatever their length.
5. Of each connected group the first occurrence, by document id and line, stays.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph
from .ngram_join import mix

#: Lines of fewer words and fewer characters stay: six characters are three words of two in a script without spaces.
SIMILARITY, LEAST_WORDS, LEAST_CHARS = 0.8, 3, 6
#: Runs of RUN bytes from each word's start. Lines of up to FEW_WORDS words, or without spaces, have blocks and a sketch of runs of
#: SHORT_RUN at every byte too.
TABLES, RUN, SHORT_RUN, FEW_WORDS, UNSPACED = 12, 8, 5, 8, 20
LONG_WORD = 4  # bytes; shorter words, which all lines share, count in the sketch of a line without longer ones only
SKETCH_BITS = np.array([36, 42])  # of 128, by kind of block: what the sketches of similar lines differ in at most; by chance 64 do
SMALL, TILE, HOT = 16, 2048, 256
#: Pairs of lines of up to 64 characters that are compared together (of longer ones in proportion fewer), and the bytes of a table for it.
TOGETHER, NEAR_BYTES = 16384, 16 << 20
LONG = 1024  # characters
#: Candidate pairs, and bytes of lines, that a task gathers before it compares them; pairs of a unit of the second round at first, until links settle others.
HELD_PAIRS, HELD_BYTES, QUOTA = 16384, 8 << 20, 256
FILTER_BITS = 24  # of the filter that picks the lines of candidates: 2 MB, whatever the table's size
#: Control characters, ASCII and Latin-1 marks and general punctuation: ranges, which a pattern tests fast.
MARKS = "[\\x00-\\x1F!-/:-@\\[-`{-\\xA9\\xAB-\\xB4\\xB6-\\xB9\\xBB-\\xBF\\u2000-\\u206F]+"
BUCKET_BYTES, FLUSH_BYTES, SLICE_CHARS, TASK_LINES = 12 << 20, 8 << 20, 1 << 20, 100_000
ENTRY = np.dtype([("sig", "<u8"), ("key", "<u8"), ("s0", "<u8"), ("s1", "<u8"), ("chars", "<u2"), ("kind", "u1"), ("hot", "?")])
U = np.uint64
_SPACED = bytes(32 if x != 10 and (x < 48 or 58 <= x < 65 or 91 <= x < 97 or 123 <= x < 128) else x for x in range(256))
_HIGH_MARKS = re.compile(rb"\xC2[\x80-\xBF]|\xE2[\x80\x81][\x80-\xBF]")  # Latin-1 marks and general punctuation
_LANES = (np.arange(1 << 16, dtype=np.uint64)[:, None] >> np.arange(16, dtype=np.uint64) & U(1) << U(0)) << (U(4) * np.arange(16, dtype=np.uint64))
_LANES = _LANES.sum(axis=1, dtype=np.uint64)  # the bits of sixteen, four bits apart
_SEEDS = [U(int(x)) for x in np.random.default_rng(29).integers(1, 1 << 63, TABLES, dtype=np.uint64) | U(1)]
_STEPS = sorted(((a, b) for a in range(5) for b in range(5) if a or b), key=lambda p: (sum(p), abs(p[0] - p[1])))  # words that may differ, of either line
_END = [None] * 6
_TOP = U(63)
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)


def simhash(words: np.ndarray, begin: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``bits`` bits (rounded up to 64) for each line; words are 64-bit hashes, begin says where lines start."""
    n64 = -(-bits // 64)
    ends = np.append(begin[1:], len(words))
    # sixteen counters to an integer, of four bits each: lines are summed in parts of fifteen words
    parts = -(-(ends - begin) // 15)
    of = np.repeat(np.arange(len(begin)), parts)
    at = begin[of] + 15 * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    drawn = np.stack([mix(words + U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(n64)], axis=1)
    sums = np.add.reduceat(_LANES[drawn.view(np.uint16)], at, axis=0)
    low, high = (sums & U(0x0F0F0F0F0F0F0F0F)).view(np.uint8), ((sums >> U(4)) & U(0x0F0F0F0F0F0F0F0F)).view(np.uint8)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    ones = np.concatenate([np.add.reduceat(x, first, axis=0, dtype=np.uint16) for x in (low, high)], axis=1)
    return 2 * ones.astype(np.int32) > (ends - begin)[:, None]


class Lines:
    """Normalised lines as one array of bytes: their words and runs as hashes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, p, dtype=np.uint64)])) for p in (_PRIME, _INVERSE))
        return self.up, self.down

    def read(self, lines: list[str]) -> tuple[np.ndarray, ...]:
        """(hashes of the words that tell lines apart, their lines, [(run hashes, their lines) of both kinds], characters a line, words a line). Lines hold no line feed."""
        raw = "\n".join([*lines, ""]).lower().encode("utf-8", "surrogatepass").translate(_SPACED)
        if b"\xC2" in raw or b"\xE2" in raw:
            raw = _HIGH_MARKS.sub(b" ", raw)
        data = np.frombuffer(raw, dtype=np.uint8)
        letter = data > 32
        keep = letter | (data == 10)
        keep[1:-1] |= letter[:-2] & (data[2:] != 10)  # of spaces the first of several, but none at a line's edges
        data = data[keep]
        late = (data[:-1] == 32) & (data[1:] == 10)
        if late.any():
            data = data[np.append(~late, True)]
        stop = np.flatnonzero(data == 10)
        n_bytes = np.diff(stop, prepend=-1) - 1
        n_chars = n_bytes if raw.isascii() else n_bytes - np.diff(np.searchsorted(np.flatnonzero(data & 0xC0 == 0x80), stop), prepend=0)
        edge = np.flatnonzero(np.diff((data > 32).view(np.int8), prepend=np.int8(0)))
        begin, end = edge[::2], edge[1::2]
        up, down = self._powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        run[1:] = data
        run[1:] += U(1)
        run[1:] *= up[: len(data)]
        np.cumsum(run, out=run)
        words = mix((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64))
        n_words = np.diff(np.searchsorted(begin, stop), prepend=0)
        of = np.repeat(np.arange(len(lines)), n_words)
        few = np.flatnonzero((n_words > 0) & ((n_words <= FEW_WORDS) | (n_chars >= UNSPACED * n_words)))

        def runs(start: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
            fits = (start + length <= stop[owner]) | (np.diff(owner, prepend=-1) > 0)  # a line's first run stays, however short
            start, owner = start[fits], owner[fits]
            last = np.minimum(start + length, stop[owner])
            return mix((run[last] - run[start]) * down[start] + (last - start).astype(np.uint64)), owner

        telling = (end - begin >= LONG_WORD) | (np.bincount(of, end - begin >= LONG_WORD, len(lines)) == 0)[of]
        many = n_bytes[few]
        each = np.repeat(stop[few] - np.cumsum(many), many) + np.arange(many.sum())  # every byte of lines of few words
        return words[telling], of[telling], [runs(begin, of, RUN), runs(each, np.repeat(few, many), SHORT_RUN)], n_chars, n_words


def _entries(batches: Iterator[pa.RecordBatch], buckets: int, least_words: int, least_chars: int) -> Iterator[pa.RecordBatch]:
    """Packed block entries of lines (key, line)."""
    reader = Lines()
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        e = np.concatenate(held)
        e = e[np.argsort(e["sig"], kind="stable")]
        place = e["sig"].copy()
        first = np.flatnonzero(np.diff(place, prepend=place[0] ^ U(1)))
        many = np.repeat(np.diff(first, append=len(e)), np.diff(first, append=len(e))) > HOT
        if many.any():  # a block that is hot here is spread over buckets, but for one entry that tells its own bucket
            e["hot"] = many
            many[first] = False
            place = np.where(many, mix(place ^ (e["key"] % U(1021))), place)
        bucket = ((place >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
        if many.any():  # of others the order by block is one by bucket
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        held.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), pa.array([e[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["bucket", "packed"])

    with np.errstate(over="ignore"):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            fresh = []
            for i, k in enumerate(keys.tolist()):
                if k not in seen:
                    fresh.append(i)
                    seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            if not fresh:
                continue
            keys, lines = keys[fresh], batch.column(1).take(pa.array(fresh)).to_pylist()
            ends = np.cumsum([len(x) for x in lines])
            a = 0
            while a < len(lines):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_CHARS)))
                words, of, kinds, n_chars, n_words = reader.read(lines[a:b])
                use = (n_words > 0) & ((n_words >= least_words) | (n_chars >= least_chars))
                for kind, (runs, owner) in enumerate(kinds):
                    has = np.unique(owner)
                    if not len(has):
                        continue
                    at = np.searchsorted(owner, has)
                    made = (words, np.searchsorted(of, has)) if kind == 0 else (runs, at)
                    sketch = np.packbits(simhash(*made, 128), axis=1).view(np.uint64)
                    e = np.empty((TABLES, len(has)), dtype=ENTRY)
                    e["key"], e["s0"], e["s1"], e["chars"], e["kind"], e["hot"] = keys[a:b][has], sketch[:, 0], sketch[:, 1], np.minimum(n_chars[has], 65535), kind, False
                    for t, seed in enumerate(_SEEDS):
                        x = runs * seed
                        e["sig"][t] = mix(np.minimum.reduceat(x, at) * U(3) + np.maximum.reduceat(x, at) + U(t + kind * TABLES))
                    held.append(e[:, use[has]].ravel())
                    size += held[-1].nbytes
                a = b
                if size >= FLUSH_BYTES:
                    yield flush()
        if held:
            yield flush()


def alike(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sketches and lengths of entries allow for similar lines."""
    short, long = np.minimum(e["chars"][i], e["chars"][j]), np.maximum(e["chars"][i], e["chars"][j])
    far = np.bitwise_count(e["s0"][i] ^ e["s0"][j]) + np.bitwise_count(e["s1"][i] ^ e["s1"][j])
    return (far <= SKETCH_BITS[e["kind"][i]]) & (short >= np.floor(SIMILARITY * long))


def pairs_of(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of keys, and which entries lie in blocks of more than SMALL lines, hot ones included (in order of the entries returned).

    Small blocks give all their pairs; of others each line meets its block's smallest key, which is mostly the same in all its blocks, and in one
    block of four its neighbour in sketch order.
    """
    e = e[np.argsort(e["sig"])]
    other = np.concatenate([[True], e["sig"][1:] != e["sig"][:-1], [True]])
    e = e[~(other[1:] & other[:-1]) | e["hot"]]  # most blocks have one line
    if not len(e):
        none = np.zeros(0, np.uint64)
        return none, none, e
    e = e[np.lexsort((e["key"], e["sig"]))]
    same = (e["sig"][1:] == e["sig"][:-1]) & (e["key"][1:] == e["key"][:-1])
    e = e[np.concatenate([[True], ~same])]
    first = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]]))
    n = np.diff(first, append=len(e))
    big = (n > SMALL) | np.logical_or.reduceat(e["hot"], first)
    leader, large, left = np.repeat(first, n), np.repeat(big, n), np.arange(len(e))
    found = []
    for k in range(1, SMALL):
        i = left[(left - k >= leader) & ~large]
        found.append((i, i - k))
    i = np.flatnonzero(large & (left > leader))
    found.append((i, leader[i]))
    some = np.flatnonzero(large & (e["sig"] % U(4) == 0))
    some = some[np.lexsort((e["s0"][some], e["sig"][some]))]
    next_ = np.flatnonzero(e["sig"][some[1:]] == e["sig"][some[:-1]])
    found.append((some[next_ + 1], some[next_]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = alike(e, i, j)
    return e["key"][i[ok]], e["key"][j[ok]], e[large]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of candidate pairs, and rows (block, key, s0, s1, chars, kind) of the lines in large blocks."""
    buckets: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            buckets[b].append(packed)
    names = ["a", "b", "block", "key", "s0", "s1", "chars", "kind"]
    with np.errstate(over="ignore"):
        for b in list(buckets):
            x, y, large = pairs_of(np.frombuffer(b"".join(buckets.pop(b)), dtype=ENTRY))
            x, y = x.view(np.int64), y.view(np.int64)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            none = [pa.nulls(len(pairs), pa.int64())] * 4 + [pa.nulls(len(pairs), pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], names=names)
            none = [pa.nulls(len(large), pa.int64())] * 2
            columns = [pa.array(np.ascontiguousarray(large[c]).view(np.int64)) for c in ("sig", "key", "s0", "s1")]
            yield pa.RecordBatch.from_arrays([*none, *columns, pa.array(large["chars"].astype(np.int32)), pa.array(large["kind"].astype(np.int32))], names=names)


def _open(e: np.ndarray, i: int, top: np.ndarray, side: np.ndarray, block: int, blocks: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The lines of ``rest`` that line i is a candidate with in this block: of another group, on the other side where there are two, in no block before."""
    j = rest[(top[rest] != top[i]) & ((side[rest] != side[i]) | (side[0] == 0 and not side.any()))]
    j = j[alike(e, np.full(len(j), i), j)]
    for b in blocks[i] if len(j) else ():
        if b >= block:
            break
        j = j[(blocks[j] != b).all(axis=1)]
    return j


def _order(roots: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Roots by number, lines with those of the largest group last, and how many have to be compared with those after them."""
    _, root, many = np.unique(roots, return_inverse=True, return_counts=True)
    return root, np.argsort(many[root], kind="stable"), len(root) - (0 if side.any() else many.max())


def partnered(e: np.ndarray, roots: np.ndarray, side: np.ndarray, block: int, blocks: np.ndarray) -> np.ndarray:
    """Which lines of a unit are a candidate with another one."""
    good, two, own = np.zeros(len(e), bool), side.any(), np.ascontiguousarray(e["chars"])
    high = int(SKETCH_BITS[e["kind"][0]]) if len(e) else 0
    s0, s1 = np.ascontiguousarray(e["s0"]), np.ascontiguousarray(e["s1"])
    many = max(1, 65536 // max(1, len(e)))
    for a in range(0, len(e), many):  # rows of all pairs
        i = slice(a, a + many)
        far = np.bitwise_count(s0[i, None] ^ s0) + np.bitwise_count(s1[i, None] ^ s1)
        ok = (far <= high) & (roots[i, None] != roots)
        if two:
            ok &= side[i, None] != side
        x, y = np.nonzero(ok)
        x += a
        like = np.minimum(own[x], own[y]) >= np.floor(SIMILARITY * np.maximum(own[x], own[y]))
        x, y = x[like], y[like]
        for k in range(0, len(x), 1024):
            p, q = x[k : k + 1024], y[k : k + 1024]
            new = ~((blocks[p][:, :, None] == blocks[q][:, None, :]) & (blocks[p] < block)[:, :, None]).any(axis=(1, 2))
            good[p[new]] = True
            good[q[new]] = True
    return good


def _asked(e: np.ndarray, roots: np.ndarray, side: np.ndarray, block: int, blocks: np.ndarray) -> Generator[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """Asks which of some pairs of a unit are similar, again and again, and returns the links that join lines of different roots.

    ``blocks`` has the large blocks of each line, in order, padded with the unit's own: two lines are compared in the first that they share. Pairs that links have made
    needless aren't asked for, so few are asked for at once where lines link, and more where they don't.
    """
    root, order, n = _order(roots, side)
    up = list(range(int(root.max()) + 1))

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    top, quota = root.copy(), QUOTA
    links: list[tuple[int, int]] = []
    pairs: list[tuple[int, int]] = []
    for place, i in enumerate(order[:n].tolist()):
        j = _open(e, i, top, side, block, blocks, order[place + 1 :])
        pairs += [(i, k) for k in j.tolist()]
        if pairs and (len(pairs) >= quota or place == n - 1):
            similar_ = yield pairs
            some = [p for p, s in zip(pairs, similar_.tolist(), strict=True) if s]
            for i, k in some:
                x, y = find(int(root[i])), find(int(root[k]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    links.append((i, k))
            quota = max(QUOTA, min(HELD_PAIRS, 2 * quota) if 8 * len(some) < len(pairs) else quota // 2)
            pairs = []
            if some:
                top = np.array([find(r) for r in range(len(up))])[root]
    return links


def across_units(units: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, list[str]]], similarity: float) -> list[list[tuple[int, int]]]:
    """Links of each of some units (entries, roots, sides, block, blocks, texts) that join lines of different roots; where a unit has two sides, of pairs across them.

    Pairs of all units are compared together.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in units]
    asked = [_asked(*u[:5]) for u in units]
    answers: dict[int, np.ndarray | None] = dict.fromkeys(range(len(units)))
    while answers:
        wanted: list[tuple[int, list[tuple[int, int]]]] = []
        for u, answer in answers.items():
            try:
                wanted.append((u, asked[u].send(answer)))
            except StopIteration as end:
                out[u] = end.value
        xs, ys = ([units[u][5][p[k]] for u, pairs in wanted for p in pairs] for k in (0, 1))
        found, at = all_similar(xs, ys, similarity), np.cumsum([0, *(len(pairs) for _, pairs in wanted)])
        answers = {u: found[at[k] : at[k + 1]] for k, (u, _) in enumerate(wanted)}
    return out


def across(e: np.ndarray, roots: np.ndarray, side: np.ndarray, block: int, blocks: np.ndarray, texts: list[str], similarity: float) -> list[tuple[int, int]]:
    """across_units() of one unit."""
    return across_units([(e, roots, side, block, blocks, texts)], similarity)[0]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(rows, entries, roots, sides, block, blocks) of each unit: rows (unit, side, block, blocks, root, s0, s1, chars, kind, ...) come sorted by unit."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.RecordBatch) -> Iterator[tuple]:
        column = {c: rows.column(c).to_numpy() for c in ("unit", "side", "block", "root", "s0", "s1", "chars", "kind")}
        own = rows.column("blocks").to_pylist()
        e = np.empty(len(rows), dtype=ENTRY)
        e["s0"], e["s1"], e["chars"], e["kind"] = column["s0"].view(np.uint64), column["s1"].view(np.uint64), column["chars"], column["kind"]
        cut = np.flatnonzero(np.diff(column["unit"], prepend=column["unit"][0] ^ 1, append=column["unit"][-1] ^ 1))
        for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            block = int(column["block"][a])
            wide = max(len(x) for x in own[a:b])
            blocks = np.array([x + [block] * (wide - len(x)) for x in own[a:b]], dtype=np.int64)
            yield rows.slice(a, b - a), e[a:b], column["root"][a:b], column["side"][a:b], block, blocks

    for batch in batches:
        if not len(batch):
            continue
        units = batch.column(0).to_numpy()
        last = int(np.searchsorted(units, units[-1]))  # where the last unit begins, which may go on
        if held and units[0] != held[0].column(0)[0].as_py() or last:
            yield from settle(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(last))
    if held:
        yield from settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of units that have a candidate partner there."""
    for rows, e, roots, side, block, blocks in _units(batches):
        good = partnered(e, roots, side, block, blocks)
        if good.any():
            yield rows.filter(pa.array(good))


def _across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of units, whose rows have key and norm too; some units at a time, of HELD_BYTES together or a single one."""
    held: list[tuple] = []
    keys: list[list[bytes]] = []
    size = 0

    def settle() -> pa.RecordBatch:
        found = across_units(held, similarity)
        x, y = ([of[p[k]] for of, links in zip(keys, found, strict=True) for p in links] for k in (0, 1))
        held.clear()
        keys.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["a", "b"])

    for rows, e, roots, side, block, blocks in _units(batches):
        # copies, as slices would keep what they are cut from
        held.append((e.copy(), roots.copy(), side.copy(), block, blocks, rows.column("norm").to_pylist()))
        keys.append(rows.column("key").to_pylist())
        size += rows.nbytes
        if size >= HELD_BYTES:
            yield settle()
            size = 0
    if held:
        yield settle()


def normalised(line: Column) -> Column:
    """Lower case, marks and white space to single spaces."""
    marks = F.regexp_replace(F.lower(line), MARKS, " ")
    return F.trim(F.regexp_replace(marks, " {2,}", " "))


def eligible(raw: Column, least_words: int, least_chars: int) -> Column:
    """Whether a line has so many words or characters; a line with a long run of letters need not be normalised for that."""
    norm = normalised(raw)
    n_words = F.length(norm) - F.length(F.translate(norm, " ", "")) + 1
    return F.when(raw.rlike(rf"[\p{{L}}\p{{N}}]{{{max(1, least_chars)}}}"), True).otherwise((n_words >= least_words) | (F.length(norm) >= least_chars))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, line, raw, short): row tells apart rows that repeat an id, short is a hash under which candidates are looked up."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    return rows.withColumn("short", F.xxhash64("raw"))


def line_key(raw: Column) -> Column:
    """The 128 bits that a line is known by."""
    return F.unhex(F.md5(raw))


def edits(x: str, y: str, most: int | None = None) -> int:
    """Edit distance, by bit-parallel columns over integers of any length; over ``most``, a number over it, found as soon as that is certain."""
    if not x or not y:
        return len(x) + len(y)
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, score = full, 0, len(x)
    left = len(y) + (len(x) + len(y) if most is None else most)
    for c in y:
        left -= 1
        eq = at.get(c, 0)
        across_ = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(across_ | up), up & across_
        if plus & top:
            score += 1
            if score > left:  # each column to come takes one off at most
                return score
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(across_ | plus)) & full, plus & across_ & full
    return score


def common_edge(x: str, y: str) -> int:
    """Length of the longest prefix that two texts share."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _codes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, a row for each text, 0 before it; which are the text's): texts stand at the right."""
    out, inside = np.zeros((len(texts), width), np.uint32), np.arange(width) >= width - np.array([len(t) for t in texts])[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, inside


def _near(xs: list[str], ys: list[str], most: np.ndarray) -> np.ndarray:
    """Whether edits() of each pair is at most ``most``: the same columns, of all pairs at once, 64 rows to an integer. Texts aren't empty.

    All texts end in the last row or column, so pairs of any lengths share a diagonal; nothing changes in columns before a text, and rows before one pass on what
    comes from above. Ways to so few edits stay near the diagonal: with k edits, and d characters more in y than in x, they step (k + d) / 2 characters of y ahead
    of x at most, and (k - d) / 2 of x ahead of y. Only integers that hold such rows are computed; rows above count as one more edit a column, rows below as one more a row, as
    ways do that lead there.
    """
    m, n, most = np.array([len(x) for x in xs]), np.array([len(y) for y in ys]), most.copy()
    near, live = np.zeros(len(xs), bool), np.arange(len(xs))
    reach = np.abs(n - m) <= most
    if not reach.all():
        near[reach] = _near([x for x, r in zip(xs, reach, strict=True) if r], [y for y, r in zip(ys, reach, strict=True) if r], most[reach]) if reach.any() else False
        return near
    words = -(-int(m.max()) // 64)
    columns = int(n.max())
    x, of_x = _codes(xs, 64 * words)
    y, of_y = _codes(ys, columns)
    used = np.zeros(max(int(x.max()), int(y.max())) + 1, bool)
    used[x[of_x]] = used[y[of_y]] = True
    rank = np.cumsum(used)
    kinds = int(rank[-1]) + 1  # 0: no character
    if len(xs) > 1 and len(xs) * kinds * words * 8 > NEAR_BYTES:
        half = len(xs) // 2
        return np.concatenate([_near(xs[:half], ys[:half], most[:half]), _near(xs[half:], ys[half:], most[half:])])
    own = kinds * np.arange(len(xs))[:, None]
    x, y = (np.where(of_x, rank[x], 0) + own).T.copy(), (np.where(of_y, rank[y], 0) + own).T.copy()
    at, up = np.zeros((words, len(xs) * kinds), np.uint64), np.zeros((words, len(xs)), np.uint64)
    for i in range(64 * words):
        bit = U(1 << (i & 63))
        at[i >> 6][x[i]] |= bit
        up[i >> 6] |= of_x[:, i] * bit
    down, score, middle = np.zeros_like(up), m.copy(), 64 * words - columns
    first, last = middle - int((most - n + m).max()) // 2, middle + int((most + n - m).max()) // 2
    end = np.clip((np.arange(columns) + last >> 6) + 1, 1, words)
    low = np.minimum(np.maximum(0, np.arange(columns) + first) >> 6, end - 1).tolist()
    end, of_word = end.tolist(), (np.arange(words) * at.shape[1])[:, None]
    at, a, b = at.ravel(), 0, 0
    buffers, place = np.empty((5, words, len(live)), np.uint64), np.empty((words, len(live)), np.int64)
    passed, before = np.zeros((2, 2, words + 1, len(live)), np.uint64)
    for step in range(columns + words - 1):
        # integer w is at column step - w, as it needs what the one above has passed on in this column
        while step - a >= columns or a <= step and a < low[step - a]:
            a += 1
        b = max(a, b)
        while b < words and b <= step and b < end[step - b]:
            b += 1
        if a >= b or a > step:
            continue
        eq, vertical, t, plus, minus = buffers[:, : b - a]
        if a == low[step - a]:
            before[0, a], before[1, a] = n >= columns - step + a, U(0)
        (plus_in, minus_in), (plus_out, minus_out) = before[:, a:b], passed[:, a + 1 : b + 1]
        u, d = up[a:b], down[a:b]
        at.take(np.add(y[step - b + 1 : step - a + 1][::-1], of_word[a:b], out=place[: b - a]), out=eq, mode="clip")
        np.bitwise_or(eq, d, out=vertical)
        np.bitwise_or(eq, minus_in, out=eq)
        np.bitwise_and(eq, u, out=t)
        np.add(t, u, out=t)
        np.bitwise_xor(t, u, out=t)
        np.bitwise_or(t, eq, out=t)
        np.bitwise_or(t, u, out=plus)
        np.invert(plus, out=plus)
        np.bitwise_or(plus, d, out=plus)
        np.bitwise_and(t, u, out=minus)
        np.right_shift(plus, _TOP, out=plus_out)
        np.right_shift(minus, _TOP, out=minus_out)
        np.add(plus, plus, out=plus)
        np.bitwise_or(plus, plus_in, out=plus)
        np.add(minus, minus, out=minus)
        np.bitwise_or(minus, minus_in, out=minus)
        np.bitwise_or(vertical, plus, out=t)
        np.invert(t, out=t)
        np.bitwise_or(t, minus, out=u)
        np.bitwise_and(plus, vertical, out=d)
        passed, before = before, passed
        j = step - b + 1
        if b == end[j]:  # the lowest integer of a column
            score += plus_out[-1].view(np.int64)
            score -= minus_out[-1].view(np.int64)
            if j % 32 == 31:
                stay = score - np.minimum(n, columns - j - 1) <= most  # each column to come takes one off at most
                if np.count_nonzero(stay) < 0.9 * len(stay):
                    live, n, most, score = (x[stay] for x in (live, n, most, score))
                    up, down, y, before = up[:, stay], down[:, stay], y[:, stay], before[:, :, stay]
                    passed, buffers, place = np.zeros_like(before), np.empty((5, words, len(live)), np.uint64), np.empty((words, len(live)), np.int64)
                if not len(live):
                    break
    near[live] = score <= most
    return near


def word_edits(u: list[str], v: list[str], most: int, close: bool = False) -> int:
    """Edits that make words v of words u, where what differs ends with the next two words that are the same again: no fewer than edits() needs, and over ``most``
    any number over it. ``close``: with the characters' edits of what differs, which are fewer."""
    n, m, i, j, total = len(u), len(v), 0, 0, 0
    u, v = u + _END, v + _END
    while i < n or j < m:
        if u[i] == v[j]:
            i, j = i + 1, j + 1
            continue
        for a, b in _STEPS:
            if u[i + a] == v[j + b] and u[i + a + 1] == v[j + b + 1]:
                break
        else:
            a, b = min(1, n - i), min(1, m - j)
        if close and a and b:
            total += edits(" ".join(u[i : i + a]), " ".join(v[j : j + b]))
        elif a == b:
            total += sum(max(len(u[i + k]), len(v[j + k])) for k in range(a)) if a > 1 else max(len(u[i]), len(v[j]))
        else:  # with a space each
            total += max(sum(map(len, u[i : i + a])) + a, sum(map(len, v[j : j + b])) + b) - (a > 0 and b > 0)
        if total > most:
            break
        i, j = i + a, j + b
    return total


def _undecided(x: str, y: str, similarity: float) -> bool | tuple[str, str, int]:
    """Whether two lines are similar, or what is left to compare and the edits allowed.

    If words in place of words are few enough edits, so are the characters' edits: most similar lines are told by that, at a tenth of the time. Of others what
    they share at either end is cut off.
    """
    allowed = int(max(len(x), len(y)) * round(1 - similarity, 9) + 1e-9)
    if abs(len(x) - len(y)) > allowed:
        return False
    if word_edits(x.split(" "), y.split(" "), allowed) <= allowed:
        return True
    a = common_edge(x, y)
    x, y = x[a:], y[a:]
    b = common_edge(x[::-1], y[::-1])
    x, y = x[: len(x) - b], y[: len(y) - b]
    if max(len(x), len(y)) <= allowed:
        return True
    return (x, y, allowed) if len(x) <= len(y) else (y, x, allowed)


def similar(x: str, y: str, similarity: float = SIMILARITY) -> bool:
    """Whether the edit similarity of two lines reaches ``similarity``: 1 - edits / longer length."""
    left = _undecided(x, y, similarity)
    return left if isinstance(left, bool) else edits(*left) <= left[2]


def all_similar(xs: list[str], ys: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """similar() of each pair; pairs of about a length are compared together, where they are so many that this pays."""
    found = [_undecided(x, y, similarity) for x, y in zip(xs, ys, strict=True)]
    out = np.array([f is True for f in found], bool)
    left = [i for i, f in enumerate(found) if not isinstance(f, bool)]
    out[left] = _compared([found[i] for i in left])
    return out


def _compared(found: list[tuple[str, str, int]]) -> np.ndarray:
    """Whether edits() of each pair that _undecided() has left is at most what it allows."""
    out = np.zeros(len(found), bool)
    kind = [(int(np.log2(len(f[1]) + 64) * 3), f[2]) for f in found]  # by length, within a quarter of it, and edits allowed
    left = sorted(range(len(found)), key=kind.__getitem__)
    a = 0
    while a < len(left):
        words, b = 1, a
        while b < len(left) and kind[left[b]][0] == kind[left[a]][0] and b - a < max(1, TOGETHER // max(words, -(-len(found[left[b]][0]) // 64))):
            words = max(words, -(-len(found[left[b]][0]) // 64))
            b += 1
        own = [found[i] for i in left[a:b]]
        if len(own) * (40 + words) >= 800:  # what a column costs for each pair, and for all together
            with np.errstate(over="ignore"):
                out[left[a:b]] = _near([f[0] for f in own], [f[1] for f in own], np.array([f[2] for f in own]))
        else:
            # long lines, which few others are of a length with, are told by their words for a hundredth of the time
            out[left[a:b]] = [len(f[0]) > LONG and word_edits(f[0].split(" "), f[1].split(" "), f[2], True) <= f[2] or edits(*f) <= f[2] for f in own]
        a = b
    return out


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of those of rows (a, x, b, y) whose lines are similar: what many batches leave to compare is compared together, so that there are many of a length."""
    held: list[pa.RecordBatch] = []
    left: list[tuple[str, str, int]] = []
    size = 0

    def settle() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from rows.filter(pa.array(_compared(left))).to_batches()
        held.clear()
        left.clear()

    for batch in batches:
        found = [_undecided(x, y, similarity) for x, y in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        keys = batch.select([0, 2])
        yield keys.filter(pa.array([f is True for f in found], pa.bool_()))
        open_ = [f for f in found if not isinstance(f, bool)]
        if open_:
            held.append(keys.filter(pa.array([not isinstance(f, bool) for f in found], pa.bool_())))
            left += open_
            size += sum(len(f[0]) + len(f[1]) for f in open_)
        if len(left) >= HELD_PAIRS or size >= HELD_BYTES:
            yield from settle()
            size = 0
    if left:
        yield from settle()


def _filter(wanted: DataFrame) -> np.ndarray:
    """2 ** FILTER_BITS bits, as bytes: those set that the hashes ``wanted`` fall on. At most 2 ** (FILTER_BITS - 6) rows come to the driver."""
    slot = F.shiftrightunsigned("short", 64 - FILTER_BITS).cast("int")
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(short, {64 - FILTER_BITS}) as int) & 63)").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype="<i8")
    out[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _picked(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (short, raw) whose hash falls on a bit that is set."""
    for batch in batches:
        at = batch.column(0).to_numpy().view(np.uint64) >> U(64 - FILTER_BITS)
        yield batch.filter(pa.array(bits[at.astype(np.int64)].astype(bool)))


def texts_of(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(short, key, norm) of the lines whose hash is among ``wanted`` (short). Of all texts only those move that a filter of bounded size lets through."""
    wanted = common.stored(wanted.distinct(), "line-wanted")
    bits = np.packbits(_filter(wanted))
    some = lines.select("short", "raw").mapInArrow(common.in_arrow(lambda b: _picked(b, np.unpackbits(bits))), "short long, raw string")
    texts = some.withColumn("key", line_key(F.col("raw"))).dropDuplicates(["key"]).join(wanted, "short", "left_semi")
    return common.stored(texts.select("short", "key", normalised(F.col("raw")).alias("norm")), "line-texts")


def verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of keys, of the candidate pairs whose lines are similar, and (short, key) of all lines of pairs."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("short")), lines)
    own = texts.select(F.col("short").alias("sa"), F.col("key").alias("a"), F.col("norm").alias("x"))
    other = texts.select(F.col("short").alias("sb"), F.col("key").alias("b"), F.col("norm").alias("y"))
    both = pairs.toDF("sa", "sb").join(own, "sa").join(other, "sb").select("a", "x", "b", "y")
    links = both.mapInArrow(common.in_arrow(lambda b: _similar(b, similarity)), "a binary, b binary")
    return common.stored(links, "line-links"), texts.select("short", "key")


def candidates(lines: DataFrame, n_lines: int, least_words: int, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of short keys, and the lines (block, key, s0, s1, chars, kind) of large blocks."""
    buckets = int(max(8, n_lines * TABLES * ENTRY.itemsize // BUCKET_BYTES + 1))
    packed = lines.select("short", "raw").mapInArrow(common.in_arrow(lambda b: _entries(b, buckets, least_words, least_chars)), "bucket int, packed binary")
    schema = "a long, b long, block long, key long, s0 long, s1 long, chars int, kind int"
    met = common.stored(packed.repartition(buckets, "bucket").mapInArrow(common.in_arrow(_candidates), schema), "line-candidates")
    large = met.where("block is not null").select("block", "key", "s0", "s1", "chars", "kind").distinct()
    return common.stored(met.where("a is not null").select("a", "b").distinct(), "line-pairs"), common.stored(large, "line-large")


def second_round(large: DataFrame, roots: DataFrame, lines: DataFrame, similarity: float, tasks: int) -> DataFrame:
    """Links (a, b) of keys in large blocks, between lines that have not met; ``roots``: (short, root).

    Lines with a partner come to a unit with their texts, so that no pair is written down but those that link.
    """
    rows = large.withColumnRenamed("key", "short").join(roots, "short", "left").withColumn("root", F.coalesce("root", "short"))
    blocks = rows.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.min("root").alias("low"), F.max("root").alias("high"))
    rows = common.stored(rows.join(blocks.where("low < high").select("block", "tiles"), "block"), "line-blocks")
    of = rows.groupBy("short").agg(F.array_sort(F.collect_set("block")).alias("blocks"))  # 2 * TABLES at most
    units = rows.withColumn("tile", F.pmod(F.xxhash64("short"), F.col("tiles")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).join(of, "short")
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    units = units.select(F.xxhash64("block", low, high).alias("unit"), (F.col("tile") != low).cast("int").alias("side"), "block", "blocks", "root", "s0", "s1", "chars", "kind", "short")
    # most lines of large blocks are unlike all others there: only those with a partner come back with their texts
    some = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(common.in_arrow(_partnered), units.schema)
    some = common.stored(some, "line-partners")
    whole = some.join(texts_of(some.select("short"), lines), "short").select("unit", "side", "block", "blocks", "root", "s0", "s1", "chars", "kind", "key", "norm")
    # few rows, but each is compared with many: Spark would leave them in a task or two
    return common.stored(whole.repartition(tasks, "unit").sortWithinPartitions("unit").mapInArrow(common.in_arrow(lambda b: _across(b, similarity)), "a binary, b binary"), "line-links")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row, line, keep_doc_id, keep_line, kept) for every line of every text, lines counted from 0.

    Lines of fewer than ``least_words`` words and ``least_chars`` characters stay and stand for themselves. Null texts have no lines, empty ones have one
    empty line. Of equal or similar lines that are connected, the first by document id (null last) and line stays. Rows that repeat id and
    text are one occurrence: they stay or go together. An empty table gives an empty result; other columns are ignored.
    """
    common.python_ready(docs.sparkSession)
    lines = lines_of(docs, id_col, text_col)
    places = common.stored(lines.select("doc_id", "row", "line", line_key(F.col("raw")).alias("key"), eligible(F.col("raw"), least_words, least_chars).alias("eligible")), "line-places")
    n_lines = places.where("eligible").count()
    pairs, large = candidates(lines, n_lines, least_words, least_chars)
    links, keys = verified(pairs, lines, similarity)
    root = graph.components(links)
    if not large.isEmpty():
        roots = keys.join(root, F.col("key") == F.col("node")).groupBy("short").agg(F.min(F.xxhash64("root")).alias("root"))
        root = graph.components(links.unionByName(second_round(large, roots, lines, similarity, max(8, n_lines // TASK_LINES))))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "row")
    firsts = places.where("eligible").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(root.withColumnRenamed("node", "key"), "key", "left")
    grouped = common.stored(firsts.where("n > 1 or root is not null").select("key", "first", F.coalesce("root", "key").alias("root")), "line-groups")
    keep = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    kept = common.stored(grouped.join(keep, "root").select("key", "keep"), "line-keeps")
    out = places.join(kept, "key", "left")
    mine = F.col("keep").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep")["doc_id"]) & (F.col("row") == F.col("keep")["row"]) & (F.col("line") == F.col("keep")["line"]))
    return out.select(
        "doc_id", "row", "line",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep")["doc_id"]).alias("keep_doc_id"),
        F.when(F.col("keep").isNull(), F.col("line")).otherwise(F.col("keep")["line"]).alias("keep_line"),
        mine.alias("kept"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones, all columns as they are.

    Documents of which nothing but blank lines is left, go; texts that were null or blank stay as they were.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # of our own, so that no column's name clashes
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    ident, text = F.col(names[id_col]), F.col(names[text_col])
    drop = line_dedup(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", **how).where(~F.col("kept"))
    drop = drop.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("line").alias("_drop"))
    split = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_drop"))
    clean = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    out = rows.join(drop, ident.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_row")), "left")
    out = out.withColumn("_clean", clean).where(F.col("_drop").isNull() | F.col("_clean").rlike(r"\S"))
    return out.select(*[(F.col("_clean") if c == text_col else F.col(n)).alias(c) for c, n in names.items()])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.table(spark, sf_dir, "documents")).drop("row")
