"""An R-tree over count vectors: which sets can overlap enough, by summed minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 16
FAN = 8
MOST_DIMENSIONS = 1024


def needed(a, b, percent: int):
    """Least overlap of sets of ``a`` and ``b`` with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def dimensions(most: int) -> int:
    """Groups, as a power of two, for sets of at most ``most`` hashes: more for larger ones.

    With a few groups to a hash the bound comes close to the overlap itself.
    """
    return min(max((2 * most).bit_length(), 4), MOST_DIMENSIONS.bit_length() - 1)


def vectors(sets: list[np.ndarray], power: int) -> np.ndarray:
    """How many hashes of each set fall into each of 2**power groups."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) >> np.uint64(64 - power)).astype(np.int64)
    flat = np.bincount(owner << power | group, minlength=len(sets) << power)
    kind = np.uint16 if max(map(len, sets)) < 1 << 16 else np.int32
    return flat.reshape(len(sets), 1 << power).astype(kind)


def tiled_order(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sort-tile order: slabs of like size, and in each slab by the widest of its groups."""
    order = np.argsort(sizes, kind="stable")
    slabs = max(1, int(np.sqrt(len(order) / LEAF)))
    out = []
    for slab in np.array_split(order, slabs):
        widest = np.argsort(-points[slab].var(axis=0), kind="stable")[:2]
        out.append(slab[np.lexsort(points[slab][:, widest].T)])
    return np.concatenate(out)


class CountTree:
    """Points (vectors of counts) packed into boxes, boxes into larger boxes.

    A box knows the greatest count of each group and the range of its sets' sizes. A set
    overlaps none of a box by more than the sum, over the groups, of the lesser of its
    own count and the box's greatest.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.order = tiled_order(points, sizes)
        self.points, self.sizes, self.percent = points[self.order], sizes[self.order], percent
        #: From the leaves up: greatest counts, least and greatest size of each box.
        self.levels = []
        high, low_size, high_size, width = self.points, self.sizes, self.sizes, LEAF
        while len(high) > 1 or not self.levels:
            at = np.arange(0, len(high), width)
            high = np.maximum.reduceat(high, at, axis=0)
            low_size = np.minimum.reduceat(low_size, at)
            high_size = np.maximum.reduceat(high_size, at)
            self.levels.append((high, low_size, high_size, width))
            width = FAN

    def _can(self, point, size, high, low_size, high_size) -> np.ndarray:
        """Which boxes may hold a set alike enough."""
        p = self.percent
        fits = np.flatnonzero((100 * high_size >= p * size) & (p * low_size <= 100 * size))
        bound = np.minimum(high[fits], point).sum(axis=1, dtype=np.int64)
        # Of sets of all sizes in the box, the smallest that may do needs the least.
        least = np.maximum(low_size[fits], -(-p * size // 100))
        return fits[bound >= needed(size, least, p)]

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places (in the given order) of the points that the bound does not rule out."""
        boxes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low, top, width = self.levels[level]
            boxes = boxes[self._can(point, size, high[boxes], low[boxes], top[boxes])]
            if not len(boxes):
                return boxes
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            boxes = (boxes[:, None] * width + np.arange(width)).ravel()
            boxes = boxes[boxes < below]
        sizes = self.sizes[boxes]
        found = boxes[self._can(point, size, self.points[boxes], sizes, sizes)]
        return self.order[found]


class Tile:
    """Some sets of hashes under a tree, and what is known to be connected.

    Each set has the label of the component that it is known to be in.
    """

    def __init__(self, sets: list[np.ndarray], labels: list, percent: int):
        self.sets, self.percent = sets, percent
        sizes = np.array([len(s) for s in sets], np.int64)
        self.power = dimensions(int(sizes.max()))
        self.points = vectors(sets, self.power)
        self.tree = CountTree(self.points, sizes, percent)
        #: Component of each label, and of each set.
        self.of: dict = {}
        self.component = np.array([self.of.setdefault(x, len(self.of)) for x in labels])

    def _join(self, one: int, other: int) -> None:
        self.component[self.component == one] = other
        self.of.update({x: other for x, c in self.of.items() if c == one})

    def _alike(self, one: np.ndarray, other: np.ndarray) -> bool:
        if len(one) > len(other):
            one, other = other, one
        at = np.minimum(np.searchsorted(other, one), len(other) - 1)
        return int((other[at] == one).sum()) >= needed(len(one), len(other), self.percent)

    def _links(self, point: np.ndarray, hashes: np.ndarray, own: int, before: int
               ) -> Iterator[int]:
        found = self.tree.search(point, len(hashes))
        found = found[found < before]
        while len(found := found[self.component[found] != own]):
            n, found = int(found[0]), found[1:]
            if self._alike(self.sets[n], hashes):
                yield n
                self._join(own, int(self.component[n]))
                own = int(self.component[n])

    def inner(self) -> Iterator[tuple[int, int]]:
        """The sets that alike pairs of the tile connect with an earlier one, and the first."""
        for n, (point, hashes) in enumerate(zip(self.points, self.sets)):
            for _ in self._links(point, hashes, int(self.component[n]), n):
                pass
        first: dict = {}
        for n, component in enumerate(self.component.tolist()):
            head = first.setdefault(component, n)
            if head != n:
                yield n, head

    def asked(self, hashes: np.ndarray, label) -> Iterator[int]:
        """Sets of the tile that connect a set from elsewhere with all that it is like."""
        own = self.of.setdefault(label, len(self.of) + len(self.sets))
        yield from self._links(vectors([hashes], self.power)[0], hashes, own, len(self.sets))
