"""Phrase counts in a burstable trie of bounded size: hash containers under word ids."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

# A container that holds more entries bursts into the two halves of its prefix range.
BURST = 1 << 16
# Entries that a task holds; beyond them whole subtrees are spilled.
ENTRIES = 1 << 21

ID_BITS = 21
MOST_WORDS = (1 << ID_BITS) - 2
MOST_LANGS = (1 << 16) - 1

Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def packed(lang: np.ndarray, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A phrase of one to four word ids as two longs: language and first two words, the rest.

    The longs order phrases of a language by their word ids; no word is 0.
    """
    none = np.zeros(len(lang), np.int64)
    one, two, three, four = ([i.astype(np.int64) + 1 for i in ids] + [none] * 4)[:4]
    return ((lang.astype(np.int64) << 2 * ID_BITS) | (one << ID_BITS) | two,
            (three << ID_BITS) | four)


def unpacked(prefix: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Language and four word ids of packed phrases; -1 where there is no word."""
    mask = (1 << ID_BITS) - 1
    ids = [prefix >> ID_BITS, prefix, rest >> ID_BITS, rest]
    return prefix >> 2 * ID_BITS, [(i & mask) - 1 for i in ids]


def summed(prefix: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> Run:
    """Equal phrases added up, in order."""
    order = np.lexsort((rest, prefix))
    prefix, rest, counts = prefix[order], rest[order], counts[order]
    new = np.ones(len(prefix), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (rest[1:] != rest[:-1])
    at = np.flatnonzero(new)
    return prefix[at], rest[at], np.add.reduceat(counts, at) if len(at) else counts


class _Container:
    """Counts of the phrases of one range of prefixes: a sorted run, and what came since."""

    def __init__(self, run: Run, limit: int):
        self.run, self.since, self.size, self.limit = run, [], len(run[0]), limit

    def add(self, run: Run) -> None:
        self.since.append(run)
        self.size += len(run[0])

    def merge(self) -> None:
        if self.since:
            self.run = summed(*(np.concatenate(c) for c in zip(self.run, *self.since)))
            self.since, self.size = [], len(self.run[0])


class HatTrie:
    """Counts of packed phrases.

    The trie's paths are language, first and second word; a container serves a range of
    them and bursts, when it is too full, into two at the middle of its phrases. Of one
    prefix alone a container is never cut. Beyond ``entries`` the largest subtrees
    are spilled whole, as sorted runs.
    """

    def __init__(self, burst: int = BURST, entries: int = ENTRIES):
        self.burst, self.entries = burst, entries
        empty = np.zeros(0, np.int64)
        self.firsts, self.containers = [-1], [_Container((empty, empty, empty), burst)]
        self.size = 0

    def add(self, prefix: np.ndarray, rest: np.ndarray) -> Iterator[Run]:
        """Count phrases; yields the runs that had to be spilled for them."""
        run = summed(prefix, rest, np.ones(len(prefix), np.int64))
        bounds = [0, *np.searchsorted(run[0], self.firsts[1:]).tolist(), len(run[0])]
        full = []
        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                self.containers[n].add(tuple(c[a:b] for c in run))
                if self.containers[n].size > self.containers[n].limit:
                    full.append(self.containers[n])
        self.size += len(run[0])
        for container in full:
            self._settle(container)
        if self.size > self.entries:
            yield from self.spill(self.entries // 2)

    def _settle(self, container: _Container) -> None:
        before = container.size
        container.merge()
        self.size += container.size - before
        prefix = container.run[0]
        # One that merging has made small stays, and one that can't burst may grow.
        container.limit = max(self.burst, 2 * container.size)
        if 2 * container.size <= self.burst:
            return
        middle = int(np.searchsorted(prefix, prefix[len(prefix) // 2]))
        if not middle:
            middle = int(np.searchsorted(prefix, prefix[0], "right"))
        if middle == len(prefix):
            return
        upper = _Container(tuple(c[middle:] for c in container.run), self.burst)
        container.run = tuple(c[:middle].copy() for c in container.run)
        container.size, container.limit = middle, self.burst
        at = bisect_right(self.firsts, int(prefix[middle]))
        self.firsts.insert(at, int(prefix[middle]))
        self.containers.insert(at, upper)

    def spill(self, down_to: int = 0) -> Iterator[Run]:
        """The largest subtrees' runs, until no more than ``down_to`` entries are left."""
        for container in sorted(self.containers, key=lambda c: -c.size):
            if self.size <= down_to:
                break
            self.size -= container.size
            container.merge()
            if container.size:
                yield container.run
            container.run = tuple(c[:0].copy() for c in container.run)
            container.size = 0
        if not self.size:
            self.firsts, self.containers = self.firsts[:1], self.containers[:1]
