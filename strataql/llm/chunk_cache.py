"""Token ids of many texts through a cache of their chunks, gathered in numpy."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np


class ChunkCache:
    """``encode_many`` gives the ids of chunks that aren't held, in a row, and how many each has.

    Beyond ``limit`` chunks, those used once are dropped; all, if that isn't enough.
    """

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.encode_many, self.limit = encode_many, limit
        self.index: dict[str, int] = {}
        self.start, self.length, self.uses, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _shrink(self) -> None:
        old, uses = self.index, self.uses
        kept = [c for c, k in old.items() if uses[k] > 1]
        if len(kept) > self.limit // 2:
            kept = []
        places = np.fromiter((old[c] for c in kept), np.int64, len(kept))
        lens = self.length[places]
        flat = self.flat[runs(self.start[places], lens)]
        self.index, self.n, self.used = {}, 0, 0
        self.flat, self.start, self.length, self.uses = np.zeros(1 << 14, np.int32), *(np.zeros(1024, np.int64) for _ in range(3))
        self._put(kept, flat, lens)

    def _put(self, chunks: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        total, n = len(ids), len(chunks)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.uses))
        self.flat[self.used : self.used + total] = ids
        self.length[self.n : self.n + n] = lens
        self.start[self.n : self.n + n] = self.used + np.cumsum(lens) - lens
        self.index.update(zip(chunks, range(self.n, self.n + n), strict=True))
        self.used, self.n = self.used + total, self.n + n

    def ids(self, chunks: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row and, for each text, where its ids end; ends: where its chunks end."""
        if self.n > self.limit:
            self._shrink()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        absent = np.flatnonzero(at < 0).tolist()
        if absent:
            new = list(dict.fromkeys(chunks[k] for k in absent))
            self._put(new, *self.encode_many(new))
            at[absent] = [self.index[chunks[k]] for k in absent]
        uses = np.bincount(at, minlength=self.n)
        self.uses[: self.n] += uses[: self.n]
        lens = self.length[at]
        after = np.concatenate([[0], np.cumsum(lens)])
        return self.flat[runs(self.start[at], lens)], after[ends]


def runs(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for the length of each run, in a row."""
    after = np.cumsum(lens)
    return np.repeat(start - (after - lens), lens) + np.arange(after[-1] if len(after) else 0)
