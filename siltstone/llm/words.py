"""Words as padded matrices of character codes, and a bounded cache of what a model says of each word."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Longer words go in pieces of this many characters.
WIDTH = 24
#: Words that a worker keeps.
CACHED = 250_000


def pieces(words: Iterable[str], width: int = WIDTH, overlap: int = 4) -> tuple[list[str], np.ndarray]:
    """Words cut to ``width``, each with the position of its word; pieces overlap, so no n-gram is lost."""
    out: list[str] = []
    owner: list[int] = []
    for i, w in enumerate(words):
        if len(w) <= width:
            out.append(w)
            owner.append(i)
        else:
            cut = [w[a : a + width] for a in range(0, len(w) - overlap, width - overlap)]
            out += cut
            owner += [i] * len(cut)
    return out, np.array(owner, dtype=np.int64)


def matrix(words: list[str], width: int = WIDTH) -> np.ndarray:
    """Code points, one row per word, 0 after its end."""
    return np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)


class Cache:
    """Rows of numbers by word: ``score`` is asked once for the words not seen yet, and all goes when it grows too large."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], columns: int, cached: int = CACHED) -> None:
        self.score, self.cached, self.columns = score, cached, columns
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.columns), dtype=np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        """One row per word."""
        at = list(map(self.at.get, words))
        if None in at:
            new = list({w for w, i in zip(words, at, strict=True) if i is None})
            if len(self.at) + len(new) > self.cached and self.at:
                self._clear()
                new = list(dict.fromkeys(words))
            n = len(self.at)
            if n + len(new) > len(self.rows):
                rows = np.zeros((max(2 * len(self.rows), n + len(new)), self.columns), dtype=np.float32)
                rows[:n] = self.rows[:n]
                self.rows = rows
            for a in range(0, len(new), 20_000):
                self.rows[n + a : n + a + 20_000][: len(new) - a] = self.score(new[a : a + 20_000])
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
            at = list(map(self.at.__getitem__, words))
        return self.rows[np.array(at, dtype=np.int64)]
