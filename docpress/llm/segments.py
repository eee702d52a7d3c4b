"""Hashes of many byte segments at once: the base of word windows and word tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Odd, so that it has an inverse modulo 2**64; any odd constants serve.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


class SegmentHasher:
    """Polynomial hashes modulo 2**64 of byte segments, by one running sum."""

    def __init__(self, seed: int = 11):
        self.values = _table(seed)
        self.powers = np.empty(0, np.uint64)
        self.inverses = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 20)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.powers = np.cumprod(np.full(n, _BASE, np.uint64))
            self.inverses = np.cumprod(np.full(n, inverse, np.uint64))

    def __call__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(buffer) + 1)
        sums = np.empty(len(buffer) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[buffer] * self.powers[:len(buffer)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each starts and ends.

    A NULL text is empty.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def joined_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words precede each text.

    ``is_word`` says of each byte value whether it belongs to a word; a word never
    runs from one text into the next.
    """
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# Hashes whose bits are spread out at once: 64 bytes each, and four times that in sums.
VOTES_AT_ONCE = 1 << 15


def add_votes(votes: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> None:
    """Count for each owner how many of its hashes have each bit; owners ascend.

    Bounded memory, however many hashes there are.
    """
    for lo in range(0, len(hashes), VOTES_AT_ONCE):
        of = owner[lo:lo + VOTES_AT_ONCE]
        bits = np.unpackbits(hashes[lo:lo + VOTES_AT_ONCE].astype("<u8").view(np.uint8)
                             .reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        votes[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def majority(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that over half of each owner's ``counts`` hashes have, as one value."""
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()
