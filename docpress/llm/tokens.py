"""Token ids of whole texts, with the ids of each word looked up once per worker.

A byte-level BPE tokenizer cuts a text into words first and encodes each word on
its own. Two places always part two words: a letter before something that is none,
and a visible character before white space. So a text may be cut there, and the
ids of its pieces joined, whatever the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from docpress.llm.segments import SegmentHasher, text_bytes

_WORD = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")

# Slots of a worker's table of words; half of them are used at most, then the
# words are learnt anew.
TABLE_SLOTS = 1 << 21
# Pieces beyond this many bytes are encoded each time they occur.
LONGEST_KEPT = 64


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low:high + 1] = True
    return flags


_LETTER = _flags((65, 90), (97, 122))
_OTHER_ASCII = _flags((0, 127)) & ~_LETTER
_SPACE = _flags((9, 13), (32, 32))
_VISIBLE = _flags((33, 126))
# Second bytes that make a Latin letter of a lead byte 0xC3: all but two signs.
_SECOND = _flags((0x80, 0xBF)) & ~_flags((0x97, 0x97), (0xB7, 0xB7))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: every text's start, and each place that parts two words."""
    cut = np.zeros(len(data), bool)
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _SECOND[data[1:]]
    cut[1:] = (letter[:-1] & _OTHER_ASCII[data[1:]]) | (_VISIBLE[data[:-1]] & _SPACE[data[1:]])
    starts = offsets[:-1]
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte.

    Printable bytes stand for themselves, the others for code points from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + n) for n, b in enumerate(others)}}


class Encoder:
    """Texts to token ids, equal to encoding each text whole."""

    def __init__(self, path: str, slots: int = TABLE_SLOTS):
        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text in a document.
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        self.hasher = SegmentHasher()
        self.slots = slots
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        mask = np.uint64(self.slots - 1)
        slot = keys & mask
        found = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(keys != 0)
        slot = slot[left]
        while len(left):
            there = self.keys[slot]
            same = there == keys[left]
            found[left[same]] = self.entry[slot[same]]
            go_on = ~same & (there != 0)
            left, slot = left[go_on], (slot[go_on] + np.uint64(1)) & mask
        return found

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = np.uint64(self.slots - 1)
        slot = keys & mask
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one_each = np.unique(slot[free], return_index=True)
            put = free[one_each]
            self.keys[slot[put]] = keys[put]
            self.entry[slot[put]] = entries[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, entries = keys[rest], entries[rest]
            slot = (slot[rest] + np.uint64(1)) & mask

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        ids: list[list[int]] = [[] for _ in pieces]
        others = []
        for n, piece in enumerate(pieces):
            if _WORD.fullmatch(piece):
                # One word to the tokenizer too: only its merges are left to do.
                written = piece.encode().decode("latin1").translate(self.letters)
                ids[n] = [t.id for t in self.tokenizer.model.tokenize(written)]
            else:
                others.append(n)
        encoded = self.tokenizer.encode_batch_fast(
            [pieces[n] for n in others], add_special_tokens=False)
        for n, e in zip(others, encoded):
            ids[n] = e.ids
        return ids

    def _add(self, pieces: list[str]) -> np.ndarray:
        """New entries for the pieces: where their ids lie."""
        ids = self._encode(pieces)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        entries = len(self.first) + np.arange(len(ids))
        self.first = np.append(self.first, len(self.pool) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        flat = np.fromiter((i for one in ids for i in one), np.uint32, int(counts.sum()))
        self.pool = np.append(self.pool, flat)
        return entries

    @staticmethod
    def _fresh(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys that have no entry yet, and one place of each."""
        places = np.flatnonzero((found < 0) & (keys != 0))
        fresh, example = np.unique(keys[places], return_index=True)
        return fresh, places[example]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many precede each text."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = self.hasher(data, starts, ends) | np.uint64(1)
        keys[ends - starts > LONGEST_KEPT] = 0
        found = self._find(keys)
        long = np.flatnonzero(keys == 0)
        fresh, example = self._fresh(keys, found)
        if len(self.first) + len(fresh) > self.slots // 2:
            self._forget()
            found[:] = -1
            fresh, example = self._fresh(keys, found)
            while len(fresh) > self.slots // 2:
                self.slots *= 2
                self._forget()
        raw = data.tobytes()
        word = lambda n: raw[starts[n]:ends[n]].decode()
        self._insert(fresh, self._add([word(n) for n in example]))
        kept = len(self.first), len(self.pool)
        missing = np.flatnonzero((found < 0) & (keys != 0))
        found[missing] = self._find(keys[missing])
        if len(long):
            found[long] = self._add([word(n) for n in long])
        counts = self.count[found]
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        ids = self.pool[np.repeat(self.first[found] - before, counts) + np.arange(total)]
        # Pieces that are not kept leave the table again.
        self.first, self.count = self.first[:kept[0]], self.count[:kept[0]]
        self.pool = self.pool[:kept[1]]
        return ids, np.append(before, total)[np.searchsorted(starts, offsets)]
