"""Plain versions of the operators' results, over a handful of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def kept_lines(rows):
    """(id, lines, dropped, digest) of rows with distinct ids."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    owner = {}
    for i, text in sorted(rows):
        for line in (text or "").split("\n"):
            owner.setdefault(key(line), i)
    out = set()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out.add((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def kept_words(rows, width):
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = set()
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s:s + width])] < (i, s):
                gone[s:s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.add((i, len(w), sum(gone), sha(kept)))
    return out


def fingerprint(text, width):
    w = (text or "").translate(UPPER)
    w = words(w)
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprint_components(rows, width, radius):
    rows = sorted(rows)
    prints = np.array([fingerprint(t, width) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {(rows[n][0], int(prints[n]), rows[find(n)][0]) for n in range(len(rows))}


def leaks(rows, items, similarity=0.8):
    def split(text):
        return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(UPPER))

    def shingles(w):
        k = min(5, len(w))
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))

    best = {}
    for d, text in rows:
        w = split(text)
        for i, item in items:
            v = split(item)
            if not v:
                continue
            b, k = shingles(v), min(5, len(v))
            if not any(tuple(w[x:x + k]) in b for x in range(len(w) - k + 1)):
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                window = w[s:s + len(v)]
                if len(window) < k:
                    continue
                a = Counter(tuple(window[x:x + k]) for x in range(len(window) - k + 1))
                both = sum((a & b).values())
                like = both / (sum(a.values()) + sum(b.values()) - both)
                if like >= similarity and like > best.get((d, i), (0,))[0]:
                    best[d, i] = (like, s, len(window))
    return {(d, i, s, n, round(like, 9)) for (d, i), (like, s, n) in best.items()}


def levelled_shards(sizes, shards):
    """Sizes of the groups of each shard: the capacity is smallest, the cuts are levelled."""
    capacity, out, at = smallest_capacity(sizes, shards), [], 0
    for left in range(shards, 0, -1):
        here = []
        while at < len(sizes):
            rest = sum(sizes[at:])
            full = sum(here) * left >= sum(here) + rest
            must = left == 1 or smallest_capacity(sizes[at:], left - 1) > capacity
            if sum(here) + sizes[at] > capacity or (full and not must):
                break
            here.append(sizes[at])
            at += 1
        out.append(here)
    return out


def smallest_capacity(sizes, shards):
    def shards_needed(capacity):
        n, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                n, held = n + 1, 0
            held += s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def patterns(text, luhn):
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text)
              if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    kinds = ("email", "ip", "card", "phone")
    return sorted(found, key=lambda s: (s[0], kinds.index(s[2])))
