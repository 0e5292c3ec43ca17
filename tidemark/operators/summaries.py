"""Small mergeable summaries that a task or a stream's state holds: numpy arrays whose size their parameters bound."""

from __future__ import annotations

import hashlib
import math
from bisect import insort

import numpy as np


class RankSummary:
    """Quantiles of a stream: sorted buffers of `k` values, one of weight 2**i at level i at most. Two of a level are merged, and every other
    value goes on to the next, odd and even ones in turn; a level's merges together move a rank by at most n / (2 k)."""

    def __init__(self, eps: float, k: int | None = None):
        self.k = k or math.ceil(16 / eps)  # good for 2**32 buffers
        self.n, self.turn, self.raw, self.levels = 0, 0, np.zeros(0), []

    def _carry(self, buffer: np.ndarray, level: int = 0) -> None:
        self.levels += [None] * (level + 1 - len(self.levels))
        while self.levels[level] is not None:
            buffer, self.levels[level] = np.sort(np.concatenate([self.levels[level], buffer]))[self.turn :: 2], None
            self.turn, level = 1 - self.turn, level + 1
            if level == len(self.levels):
                self.levels.append(None)
        self.levels[level] = buffer

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.raw = np.concatenate([self.raw, values])
        while len(self.raw) >= self.k:
            self._carry(np.sort(self.raw[: self.k]))
            self.raw = self.raw[self.k :]

    def merge(self, other: RankSummary) -> None:
        n = self.n + other.n
        for level, buffer in enumerate(other.levels):
            if buffer is not None:
                self._carry(buffer, level)
        self.add(other.raw)
        self.n = n

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        full = [(b, 2.0**i) for i, b in enumerate(self.levels) if b is not None]
        return np.concatenate([self.raw, *(b for b, _ in full)]), np.concatenate([np.ones(len(self.raw)), *(np.full(len(b), w) for b, w in full)])

    def quantile(self, q: float) -> float | None:
        return weighted_quantile(*self.weighted(), q)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float | None:
    if not len(values):
        return None
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(total, q * total[-1] - 1e-9), len(values) - 1)])


class WindowRanks:
    """Quantiles of the last `window` values within eps * window ranks (Arasu and Manku, 2004).

    Blocks of a level follow each other; a level's are twice as long as those of the level below, from eps * window / 4 values on. Each has
    a summary of its own while it is filled; of a full one evenly spaced values are kept, and it goes when its first value leaves the window.
    A window is covered by at most two whole blocks of each level and the newest values, and each moves a rank by at most
    3 eps * window / (8 levels); what is left out at the window's old end is less than the shortest block.
    """

    def __init__(self, eps: float, window: int):
        self.window, self.n = window, 0
        self.short = max(1, int(eps * window / 4))
        self.count = max(1, math.ceil(math.log2(window / self.short)) + 1)
        move = 3 * eps * window / (8 * self.count)
        self.k, self.kept = [], []
        for level in range(self.count):
            length = self.short << level
            k = min(length, 2)
            while k < length and math.ceil(math.log2(length / k)) * length / (2 * k) > move / 2:
                k = min(length, 2 * k)
            self.k.append(k)
            self.kept.append(min(length, math.ceil(length / move)))
        self.open = [RankSummary(eps, k) for k in self.k]
        self.done: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in self.k]

    def add(self, values: np.ndarray) -> None:
        long = self.short << self.count - 1
        start = max(0, self.n + len(values) - self.window) // long * long
        if start > self.n:  # all blocks so far and those up to there would have gone by the end: every level starts anew where a longest block does
            values, self.n = values[start - self.n :], start
            self.open, self.done = [RankSummary(1, k) for k in self.k], [[] for _ in self.k]
        for level, k in enumerate(self.k):
            length, at = self.short << level, 0
            while at < len(values):
                have = (self.n + at) % length
                part = values[at : at + length - have]
                self.open[level].add(part)
                at += len(part)
                if have + len(part) == length:
                    self.done[level].append((self.n + at - length, *self._frozen(level)))
                    self.open[level] = RankSummary(1, k)
        self.n += len(values)
        start = self.n - self.window
        for blocks in self.done:
            while blocks and blocks[0][0] < start:
                blocks.pop(0)

    def _frozen(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        values, weights = self.open[level].weighted()
        order, m = np.argsort(values, kind="stable"), self.kept[level]
        total = np.cumsum(weights[order])
        return values[order][np.searchsorted(total, (np.arange(m) + 0.5) * total[-1] / m)], np.full(m, total[-1] / m)

    def points(self) -> int:
        """How many values are held."""
        return sum(len(b[1]) for blocks in self.done for b in blocks) + sum(len(o.weighted()[0]) for o in self.open)

    def quantile(self, q: float) -> float | None:
        at, parts = -(-max(0, self.n - self.window) // self.short) * self.short, []
        starts = [{b[0]: b for b in blocks} for blocks in self.done]
        while at + self.short <= self.n:
            level = max(k for k in range(self.count) if at in starts[k])
            parts.append(starts[level][at][1:])
            at += self.short << level
        if at < self.n:
            parts.append(self.open[0].weighted())
        return weighted_quantile(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), q) if parts else None


def priority(*parts) -> int:
    """A number of 64 bits that decides samples, alike at every site."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def by_priority(x) -> tuple:
    return x[1], x[0], str(x[2])


class WindowSample:
    """A uniform sample without replacement of `size` elements of the last `window` units of time (or of all of them): those with the lowest
    priorities. An element stays while fewer than `size` later ones have lower priorities, so that some size * log(window) are held, and the
    sample of every later window is among them. Sites' samples merge to the sample of all they saw."""

    def __init__(self, size: int, window: int | None = None):
        self.size, self.window, self.held, self.last = size, window, [], None

    def add(self, elements) -> None:
        """elements: (time, priority, what) in any order; an element is counted once."""
        rows = sorted({*self.held, *elements}, key=lambda x: (-x[0], x[1]))  # the newest first
        if not rows:
            return
        self.last = rows[0][0] if self.last is None else max(self.last, rows[0][0])
        self.held = self._undominated([x for x in rows if self.window is None or x[0] > self.last - self.window])

    def _undominated(self, rows):
        best: list[int] = []  # priorities of newer elements, the `size` lowest
        out = []
        for x in rows:
            if self.window is None:  # no element ever leaves: all are of one time
                out.append(x)
                continue
            if len(best) < self.size or x[1] < best[-1]:
                out.append(x)
                insort(best, x[1])
                del best[self.size :]
        return sorted(out, key=by_priority)[: self.size] if self.window is None else out

    def merge(self, other: WindowSample) -> None:
        self.last = max((x for x in (self.last, other.last) if x is not None), default=None)
        self.add(other.held)

    def sample(self, at: int | None = None) -> list:
        """The sample of the window that ends at the time given (the last one seen)."""
        at = self.last if at is None else at
        rows = [x for x in self.held if self.window is None or at - self.window < x[0] <= at]
        return sorted(rows, key=by_priority)[: self.size]
