"""Toxicity: a support vector machine over a subsequence string kernel, with Nystroem landmarks.

The kernel compares words by their subsequences of three or four letters (a word's beginning is one) that span five at
most, a gap costing GAP for each letter skipped: an insult
with letters dropped or put in still shares most of them. Marks inside a word are skipped, digits that stand for letters
read as such, and single letters in a row join ("i d i o t").

Two machines are trained on the driver, over a bounded sample of labelled rows with their whole texts (SAMPLE_POSITIVE,
SAMPLE_NEGATIVE). The first judges words: it finds in each toxic document its witnesses, words whose letter n-grams
speak for toxicity by a likelihood-ratio test over documents. Witnesses, copies of them with a letter put in or dropped,
and the words of the other documents (the hardest first, in two rounds) are projected on landmarks by K_mm**-1/2 and separated by
dual coordinate descent on the squared hinge loss; a text is judged by its worst word. The second judges texts by the mean of their words'
projections, so that subsequences count that clean texts hold too, but seldom; landmarks are words whose subsequences are denser in
toxic documents. Since the kernel is a dot product over subsequences, machines and landmarks fold
into one weight for each, so a word costs a few table look-ups. A text's score is the higher of the two,
squashed so that THRESHOLD lies where training documents divide best (for the second: documents left out of the fit).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

THRESHOLD = 0.7
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 2000, 4000
GAP, LANDMARKS, DENSE_MARKS, CLASSES = 0.5, 288, 128, 64
WIDTHS, SLICE = (8, 12, words.WIDTH), 2000
#: Of the density machine: documents that it learns from (toxic ones, and twice as many others), and letters, documents and t
#: statistic of the runs that become landmarks.
DENSE_DOCS, LANDMARK_LETTERS, LEAST_DOCS, LEAST_T, RUNS = 800, (5, 6, 7), 5, 2.5, 1 << 20
FOLDS, COST, DENSE_HARM = 2, 0.1, 10
PRIOR = 20  # words that add nothing: a short text has to be dense in earnest
START = CLASSES - 1  # the class of a word's beginning
#: Offsets of a subsequence's letters, which span five at most, and its weight.
SHAPES = [((0, *mid, k), GAP ** (k - 1 - len(mid))) for k in (2, 3, 4) for n in (1, 2) for mid in combinations(range(1, k), n)]
FEATURES = 1 << 19  # triples have a row each, longer ones a hashed row beyond them
#: Digits read as the letters they stand for, fixed values.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SINGLES = re.compile(r"(?:^|(?<=\s))\w(?:[ .*_-]+\w){2,}(?=\s|$|[.,!?])")


def _classes() -> np.ndarray:
    """Letter classes by code point: a to z apart, other letters by remainder, 0 for anything else."""
    table = np.zeros(0x3000, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = c - 96
        elif ch in DIGITS:
            table[c] = ord(DIGITS[ch]) - 96
        elif ch.isalpha():
            table[c] = 27 + c % (START - 27)
    return table


CLASS_OF = _classes()


def tokens(text: str) -> set[str]:
    """Distinct words in lower case, and runs of single letters joined: repeated lines don't make a text denser."""
    low = text.lower()
    out = set(low.split())
    out.update(re.sub(r"[ .*_-]+", "", m) for m in SINGLES.findall(low))
    return out


def subsequences(cut: list[str], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of the subsequences of pieces of up to ``width`` letters, a row for each; a weight of 0 is none."""
    points = words.matrix(cut, width)
    codes = np.where(points < 0x3000, CLASS_OF[np.minimum(points, 0x2FFF)], 27 + points % (START - 27))
    codes = np.take_along_axis(codes, np.argsort(codes == 0, axis=1, kind="stable"), axis=1).astype(np.int64)
    codes = np.concatenate([codes, np.zeros((len(codes), 1), np.int64)], axis=1)
    codes[first] = np.concatenate([np.full((int(first.sum()), 1), START), codes[first, :-1]], axis=1)
    ids, weights = [], []
    for shape, weight in SHAPES:
        letters = [codes[:, j : width + 1 - shape[-1] + j] for j in shape]
        key = letters[0]
        for x in letters[1:]:
            key = key * CLASSES + x
        if len(shape) > 3:
            key = CLASSES**3 + (key * 2654435761 >> 7) % (FEATURES - CLASSES**3)
        ids.append(key.astype(np.int32))
        weights.append(np.where(np.minimum.reduce(letters) > 0, np.float32(weight), np.float32(0)))
    return np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)


def by_width(ws: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word of each piece, ids, weights), for pieces of like length together, so that short words aren't padded to long ones."""
    cut, owner = words.pieces(ws)
    size, first = np.array([len(x) for x in cut]), np.diff(owner, prepend=-1) > 0
    for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
        at = np.flatnonzero((size > low) & (size <= width))
        for a in range(0, len(at), SLICE):
            part = at[a : a + SLICE]
            yield owner[part], *subsequences([cut[i] for i in part], first[part], width)


def norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Length of each row as a vector over subsequences; one that comes twice adds up first."""
    if len(ids) > SLICE:
        return np.concatenate([norms(ids[a : a + SLICE], weights[a : a + SLICE]) for a in range(0, len(ids), SLICE)])
    order = np.argsort(ids, axis=1)
    ids, weights = np.take_along_axis(ids, order, axis=1), np.take_along_axis(weights, order, axis=1)
    run = np.cumsum(weights.astype(np.float64), axis=1)
    last = np.concatenate([ids[:, 1:] != ids[:, :-1], np.ones((len(ids), 1), bool)], axis=1)
    upto = np.where(last, run, 0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(ids), 1)), upto[:, :-1]], axis=1), axis=1)
    return np.sqrt((np.where(last, run - before, 0) ** 2).sum(axis=1))


@dataclass
class Machine:
    """A folded machine: its weight for each subsequence, the cut at which it scores THRESHOLD, and the steepness there."""

    weight: np.ndarray
    bias: float
    at: float = np.inf
    scale: float = 1.0

    def score(self, value: np.ndarray) -> np.ndarray:
        odds = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.scale * (value - self.at) + odds, -30, 30)))

    def cut(self, high: np.ndarray, low: np.ndarray, harm: float = 4) -> None:
        """The cut between the values of toxic and other documents: most right, a clean document taken for toxic counting
        ``harm`` times; the middle of the best gap."""
        edges = np.unique(np.concatenate([low, high]))
        mids = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else edges
        if len(mids) > 4000:
            mids = np.quantile(mids, np.linspace(0, 1, 4000))
        gain = len(high) - np.searchsorted(np.sort(high), mids) - harm * (len(low) - np.searchsorted(np.sort(low), mids))
        best = mids[gain == gain.max()]
        if gain.max() > 0:
            self.at = float((best.min() + best.max()) / 2)
            self.scale = float(3 / max(0.05 * (edges[-1] - edges[0]), np.median(high[high >= self.at]) - self.at))


@dataclass
class Model:
    """Two machines over the same kernel: of a text's worst word, and of the density of its words' subsequences."""

    word: Machine
    density: Machine

    def decide(self, ws: list[str]) -> np.ndarray:
        """Of each word its decision value, and what it adds to a text's density."""
        out = np.zeros((len(ws), 2), dtype=np.float64)
        out[:, 0] = -np.inf
        for owner, ids, weights in by_width(ws):
            raw = np.einsum("ij,ij->i", self.word.weight[ids], weights)
            value = np.full(len(ids), self.word.bias, dtype=np.float64)
            some = np.nonzero(raw > 0)[0]  # others are below the bias, and no text is judged by them
            if len(some):
                value[some] += raw[some] / np.maximum(norms(ids[some], weights[some]), 1e-9)
            np.maximum.at(out[:, 0], owner, value)
            np.add.at(out[:, 1], owner, np.einsum("ij,ij->i", self.density.weight[ids], weights))
        return out

    def score(self, worst: np.ndarray, added: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Scores of texts from their worst word's value, and the sum of what their words add."""
        return np.maximum(self.word.score(worst), self.density.score(added / (n_words + PRIOR) + self.density.bias))


def lengths(weights: np.ndarray) -> np.ndarray:
    """Length of each row as a vector, each subsequence on its own."""
    return np.sqrt(np.maximum((weights * weights).sum(axis=1), 1e-9))


def kernel(x: tuple, y: tuple) -> np.ndarray:
    """Normalised kernel of all rows of ``x`` and the (few) rows of ``y``, both (ids, weights)."""
    out = np.zeros((len(x[0]), len(y[0])))
    nx = np.maximum(norms(*x), 1e-9)
    table = np.zeros(FEATURES, dtype=np.float64)
    ny = np.maximum(norms(*y), 1e-9)
    for j in range(len(y[0])):
        np.add.at(table, y[0][j], y[1][j])
        out[:, j] = np.einsum("ij,ij->i", table[x[0]], x[1]) / nx / ny[j]
        table[y[0][j]] = 0
    return out


def _grams(word: str) -> set[str]:
    return {word[i : i + n] for n in (3, 4, 5) for i in range(len(word) - n + 1)} | {word}


@dataclass
class Corpus:
    """Documents as arrays of word numbers: the toxic ones, the others, and the words."""

    bad: list[np.ndarray]
    good: list[np.ndarray]
    words: list[str]

    @classmethod
    def of(cls, positive: list[str], negative: list[str]) -> Corpus:
        at: dict[str, int] = {}
        read = lambda texts: [np.array(sorted(at.setdefault(w, len(at)) for w in sorted(tokens(t))), dtype=np.int32) for t in texts]
        bad, good = read(positive), read(negative)
        return cls(bad, good, list(at))


def witnesses(corpus: Corpus) -> list[str]:
    """Words that speak for toxicity: in each toxic document those with the best n-gram, by a likelihood ratio over documents.

    The ratio has to beat what the best of all n-grams would reach by chance, and the n-gram to be ten times as frequent in
    toxic documents.
    """
    df: list[Counter] = [Counter(), Counter()]
    for d in corpus.bad:
        df[1].update({g for w in d for g in _grams(corpus.words[w])})
    df[1] = Counter({g: n for g, n in df[1].items() if n > 1})
    for d in corpus.good:
        df[0].update({g for w in d for g in _grams(corpus.words[w]) if g in df[1]})
    n1, n0 = max(1, len(corpus.bad)), max(1, len(corpus.good))

    def evidence(a: int, b: int) -> float:
        if a < 2 or a / n1 <= 10 * b / n0:
            return 0.0
        p = (a + b) / (n1 + n0)
        return 2 * (a * np.log(a / (n1 * p)) + (b * np.log(b / (n0 * p)) if b else 0.0))

    least = 2 * np.log(max(2, len(df[1])))
    weight = {g: x for g, a in df[1].items() if (x := evidence(a, df[0][g])) >= least}
    out: set[str] = set()
    for d in corpus.bad:
        ws = [corpus.words[i] for i in d]
        best = {w: max((weight.get(g, 0.0) for g in _grams(w)), default=0.0) for w in ws if df[1][w] * n0 >= 10 * df[0][w] * n1}
        top = max(best.values(), default=0.0)
        if top > 0:
            out |= {w for w, x in best.items() if x >= 0.6 * top}
    return sorted(out)


def _varied(ws: list[str], rng: np.random.Generator) -> list[str]:
    """Copies with a letter put in, or one dropped from longer words."""
    out = []
    for w in ws:
        if len(w) >= 4:
            i = int(rng.integers(1, len(w)))
            out.append(w[:i] + chr(97 + int(rng.integers(0, 26))) + w[i:])
            if len(w) >= 6:
                out.append(w[:i] + w[i + 1 :])
    return out


def _separate(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, cost: float = 30.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent on the squared hinge loss, classes weighing the same; the weights and the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    slack = 0.5 / np.where(y > 0, cost * len(y) / max(1, (y > 0).sum()), cost * len(y) / max(1, (y < 0).sum()))
    curve = (x * x).sum(axis=1) + slack
    alpha, w, xy = np.zeros(len(x)), np.zeros(x.shape[1]), x * y[:, None]
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = max(0.0, alpha[i] - (xy[i] @ w - 1 + slack[i] * alpha[i]) / curve[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * xy[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def _nystroem(marks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """K_mm ** -1/2 of landmarks (ids, weights)."""
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def _single(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights) of words, one row for each: long ones by their first letters."""
    return subsequences([w[: words.WIDTH] for w in ws], np.ones(len(ws), bool), words.WIDTH)


def _folded(marks: tuple[np.ndarray, np.ndarray], beta: np.ndarray) -> np.ndarray:
    """One weight for each subsequence: landmarks times their coefficients."""
    table = np.zeros(FEATURES)
    for j, b in enumerate(beta):
        np.add.at(table, marks[0][j], marks[1][j] * b)
    return table.astype(np.float32)


def _worst_word(corpus: Corpus, rng: np.random.Generator) -> Machine:
    """The machine of single words: witnesses of toxic documents against the words of others, the hardest in two more rounds."""
    found = witnesses(corpus)
    seen = np.zeros(len(corpus.words), bool)
    for d in corpus.good:
        seen[d] = True
    pool = [corpus.words[i] for i in np.flatnonzero(seen)]
    none = Machine(np.zeros(FEATURES, dtype=np.float32), -1.0, 0.0, 4.0)
    if not found or not pool:
        return none
    if len(found) > 3000:
        found = sorted(rng.choice(found, 3000, replace=False).tolist())
    some = lambda n: [pool[i] for i in rng.choice(len(pool), min(n, len(pool)), replace=False)]
    ones, zeros = found + _varied(found, rng), some(3000)
    model = Model(none, none)
    for _ in range(3):
        x1, x0 = _single(ones), _single(zeros)
        pick1 = rng.choice(len(found), min(LANDMARKS * 2 // 3, len(found)), replace=False)
        pick0 = rng.choice(len(zeros), min(LANDMARKS // 3, len(zeros)), replace=False)
        marks = tuple(np.concatenate([a[pick1], b[pick0]]) for a, b in zip(x1, x0, strict=True))
        root = _nystroem(marks)
        z = np.concatenate([kernel(x1, marks), kernel(x0, marks)]) @ root
        w, bias = _separate(z, np.concatenate([np.ones(len(ones)), -np.ones(len(zeros))]), rng)
        size = np.linalg.norm(w) + 1e-9
        model.word = Machine(_folded(marks, root @ w / size / np.maximum(norms(*marks), 1e-9)), bias / size)
        value = model.decide(pool)[:, 0]
        zeros = sorted({*(pool[i] for i in np.argsort(-value, kind="stable")[:3000]), *some(2000)})
    every = np.full(len(corpus.words), -9.0)
    every[seen] = value
    every[~seen] = model.decide([corpus.words[i] for i in np.flatnonzero(~seen)])[:, 0]
    high, low = (np.array([every[d].max() if len(d) else -9.0 for d in docs]) for docs in (corpus.bad, corpus.good))
    model.word.cut(high, low)
    return model.word


def _runs(vocabulary: list[str], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(word, row, place, hash) of all runs of ``n`` letters, some words at a time, with the pieces of words that rows stand for."""
    for a in range(0, len(vocabulary), 10 * SLICE):
        cut, owner = words.pieces(vocabulary[a : a + 10 * SLICE])
        codes = words.matrix(cut).astype(np.uint64)
        h = np.zeros((len(cut), words.WIDTH - n + 1), dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[:, k : words.WIDTH - n + 1 + k]) * np.uint64(1099511628211)
        row, place = np.nonzero(codes[:, n - 1 :])
        yield a + owner[row], np.stack([row, place]), (h[row, place] >> np.uint64(20)).astype(np.int64) % RUNS, cut


def _landmarks(vocabulary: list[str], word: np.ndarray, doc: np.ndarray, share: np.ndarray, toxic: np.ndarray, use: np.ndarray) -> list[str]:
    """Runs of letters that are denser in toxic documents (by the t statistic of their density over documents), unlike each other.

    ``word`` (sorted), ``doc`` and ``share`` say how dense a word is in a document, ``toxic`` which of the documents ``use`` are.
    """
    sides = (toxic & use, use & ~toxic)
    dense_in = [np.bincount(word, share * side[doc], len(vocabulary)) / max(1, side.sum()) for side in sides]
    begin = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    found: list[tuple[float, str]] = []
    for n in LANDMARK_LETTERS:
        dense = np.zeros((2, RUNS))
        for of, _, run, _ in _runs(vocabulary, n):
            for side in (0, 1):
                dense[side] += np.bincount(run, dense_in[side][of], RUNS)
        rough = (dense[0] - dense[1]) / np.sqrt(dense.sum(axis=0) + 1e-6)
        keep = np.full(RUNS, -1)
        top = np.argsort(-rough, kind="stable")[:4000]
        keep[top[rough[top] > 0]] = np.arange((rough[top] > 0).sum())
        pairs, per, text = [], [], {}
        for of, at, run, cut in _runs(vocabulary, n):
            some = np.flatnonzero(keep[run] >= 0)
            for i in some[np.unique(run[some], return_index=True)[1]].tolist():
                text.setdefault(int(keep[run[i]]), cut[at[0, i]][at[1, i] : at[1, i] + n])
            many = (begin[1:] - begin[:-1])[of[some]]
            entry = np.repeat(begin[:-1][of[some]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.repeat(keep[run[some]], many) * len(toxic) + doc[entry])
            per.append(share[entry])
        pair, where = np.unique(np.concatenate(pairs), return_inverse=True)
        x, run, doc_of = np.bincount(where, np.concatenate(per)), pair // len(toxic), pair % len(toxic)
        mean, var = np.zeros((2, 4000)), np.zeros((2, 4000))
        for side, which in enumerate(sides):
            on, m = which[doc_of], max(1, which.sum())
            mean[side] = np.bincount(run[on], x[on], 4000) / m
            var[side] = np.maximum(np.bincount(run[on], x[on] ** 2, 4000) / m - mean[side] ** 2, 0) / m
        docs = np.bincount(run[sides[0][doc_of]], minlength=4000)
        t = np.where(docs >= LEAST_DOCS, (mean[0] - mean[1]) / np.sqrt(var.sum(axis=0) + 1e-12), 0)
        found += [(float(t[i]), text[i]) for i in np.argsort(-t, kind="stable")[:300].tolist() if t[i] > LEAST_T]
    best = [x for _, x in sorted(found, key=lambda f: (-f[0], f[1]))]
    chosen: list[int] = []
    if best:
        x = _single(best)
        like = kernel(x, x)
        for i in range(len(best)):
            if len(chosen) < DENSE_MARKS and (not chosen or like[i, chosen].max() < 0.8):
                chosen.append(i)
    return [best[i] for i in chosen]


def _near(vocabulary: list[str], marks: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, its and the next words' kernel with each landmark, of length 1), some words at a time."""
    size = norms(*marks)
    table = np.zeros(FEATURES, dtype=np.int32)
    used = np.unique(marks[0][marks[1] > 0])
    table[used] = np.arange(1, len(used) + 1)
    folded = np.zeros((len(used) + 1, len(size)), dtype=np.float32)
    for j in range(len(size)):
        np.add.at(folded[:, j], table[marks[0][j]], marks[1][j] / size[j])
    folded[0] = 0
    for a in range(0, len(vocabulary), SLICE):
        near = np.zeros((min(SLICE, len(vocabulary) - a), len(size)), dtype=np.float32)
        for owner, ids, weights in by_width(vocabulary[a : a + SLICE]):
            row, col = np.nonzero((table[ids] > 0) & (weights > 0))
            if len(row):
                of_row, first = np.unique(row, return_index=True)
                np.add.at(near, owner[of_row], np.add.reduceat(folded[table[ids[row, col]]] * weights[row, col][:, None], first))
        yield a, near


def _density(corpus: Corpus, rng: np.random.Generator) -> Machine:
    """The machine of whole documents: the mean of their words' Nystroem features. Its cut comes from documents left out of the fit."""
    none = Machine(np.zeros(FEATURES, dtype=np.float32), 0.0)
    bad, good = ([docs[i] for i in sorted(rng.permutation(len(docs))[:n].tolist())] for docs, n in ((corpus.bad, DENSE_DOCS), (corpus.good, 2 * DENSE_DOCS)))
    docs = bad + good
    if len(bad) < 8 or len(good) < 8:
        return none
    n = np.array([len(d) for d in docs])
    used, word = np.unique(np.concatenate(docs), return_inverse=True)
    vocabulary, doc = [corpus.words[i] for i in used], np.repeat(np.arange(len(docs)), n)
    order = np.lexsort((doc, word))
    doc, word = doc[order], word[order]
    share, begin = 1 / (n + PRIOR)[doc], np.searchsorted(word, np.arange(len(vocabulary) + 1))
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])

    def fit(use: np.ndarray) -> tuple[np.ndarray, Machine]:
        """Decision values of all documents, and the machine, by the documents ``use``."""
        found = _landmarks(vocabulary, word, doc, share, y > 0, use)
        if not found:
            return np.full(len(docs), -np.inf), none
        marks = _single(found)
        mean = np.zeros((len(docs), len(found)))
        for a, near in _near(vocabulary, marks):
            for low in range(begin[a], begin[a + len(near)], 4 * SLICE):
                part = slice(low, min(low + 4 * SLICE, begin[a + len(near)]))
                np.add.at(mean, doc[part], near[word[part] - a] * share[part, None])
        root = _nystroem(marks)
        z = mean @ root
        middle = z[use].mean(axis=0)
        spread = max(1e-9, float(np.linalg.norm(z[use] - middle, axis=1).mean()))
        w, bias = _separate((z[use] - middle) / spread, y[use], rng, cost=COST)
        beta, bias = root @ w / spread, float(bias - middle @ w / spread)
        return mean @ beta + bias, Machine(_folded(marks, beta / norms(*marks)), bias)

    out, fold = np.full(len(docs), -np.inf), rng.permutation(len(docs)) % FOLDS
    for k in range(FOLDS):
        out[fold == k] = fit(fold != k)[0][fold == k]
    machine = fit(np.ones(len(docs), bool))[1]
    if np.isfinite(out).all():
        machine.cut(out[y > 0], out[y < 0], DENSE_HARM)
    return machine


def train(positive: list[str], negative: list[str], seed: int = 5) -> Model:
    """A model from the texts of toxic and other documents. Without witnesses, and without a density that tells, no text is toxic."""
    rng = np.random.default_rng(seed)
    corpus = Corpus.of(positive, negative)
    return Model(_worst_word(corpus, rng), _density(corpus, rng))


def sample(docs: DataFrame, labels: DataFrame, where: Column, positive: int = SAMPLE_POSITIVE, negative: int = SAMPLE_NEGATIVE) -> tuple[list[str], list[str]]:
    """Whole texts of toxic and of other labelled documents, about so many of each, by a hash of the id.

    A document with both labels is toxic.
    """
    usable = labels.where(where & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, common.share_below(positive / max(1, counts.get(1, 0)), "toxicity", F.col("doc_id")))
    picked = usable.where(share.otherwise(common.share_below(negative / max(1, counts.get(0, 0)), "toxicity", F.col("doc_id"))))
    picked = common.bounded(common.stored(picked, "toxicity-sample"), 2 * (positive + negative))
    got = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(picked, "doc_id").select("toxic", "text").dropDuplicates()
    rows = got.collect()  # about positive + negative rows, whatever the table's size
    rows.sort(key=lambda r: (r["toxic"], r["text"]))
    return [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0]


def _judged(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the scores of its texts."""
    cache = words.Cache(model.decide, 2)
    for batch in batches:
        docs = [tokens(t) if t else set() for t in batch.column(text).to_pylist()]
        n = np.array([len(d) for d in docs], dtype=np.int64)
        worst, added = np.full(len(docs), model.word.bias), np.zeros(len(docs))
        flat = [w for d in docs for w in d]
        if flat:
            rows, some = cache(flat), np.flatnonzero(n)
            begin = np.cumsum(n)[some] - n[some]
            worst[some] = np.maximum(worst[some], np.maximum.reduceat(rows[:, 0], begin))
            added[some] = np.add.reduceat(rows[:, 1].astype(np.float64), begin)
        yield batch, model.score(worst, added, n)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch, score in _judged(batches, model, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Columns doc_id, held_out, score, predicted for each row.

    Null and empty texts score as a text without words, low. Repeated rows give repeated answers; an empty table gives
    an empty result; texts of any length are read whole; ids stay as they are, nulls too; other columns are ignored.
    """
    common.python_ready(docs.sparkSession)
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held.alias("held_out"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(common.in_arrow(lambda b: _scored(b, model)), f"doc_id {id_type}, held_out boolean, score double, predicted int")


def _kept(batches: Iterator[pa.RecordBatch], model: Model, text: int) -> Iterator[pa.RecordBatch]:
    for batch, score in _judged(batches, model, text):
        yield batch.filter(pa.array(score < THRESHOLD))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not judged toxic, all columns as they are."""
    common.python_ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(common.in_arrow(lambda b: _kept(b, model, at)), docs.schema)


def held_out_rows() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels, ~held_out_rows()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fitted(docs, common.table(spark, sf_dir, "labels")), held_out=held_out_rows())
