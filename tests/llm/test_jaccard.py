"""The Jaccard join against all pairs, and its tree against plain bounds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docpress.llm import counttree, jaccard
from docpress.llm.jaccard import jaccard_components
from tests.llm import brute


def plain(rows, width=3, percent=90):
    """(id, set size, smallest id reachable) by comparing all pairs; NULL ids are last."""
    def shingles(text):
        w = brute.words((text or "").translate(brute.UPPER))
        return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else None

    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (a == b or 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b))
                            and 100 * len(a & b) >= percent * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((rows[n][0], len(s or ()), rows[find(n)][0]) for n, s in enumerate(sets)), key=str)


def found(docs, rows, **options):
    df = docs(rows).selectExpr("*", "'x' as key", "1 as size", "2 as node", "3 as root")
    return sorted(map(tuple, jaccard_components(df, **options).select(
        "doc_id", "n_shingles", "component_id").collect()), key=str)


def changed(rng, text, words):
    """``text`` with so many words new, each at a random place."""
    w = text.split()
    for at in rng.sample(range(len(w)), words):
        w[at] = f"n{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Texts of many lengths, each with copies that lose up to a fifth of the shingles."""
    rng = random.Random(1)
    rows = []
    for n in range(70):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((1, 2, 3, 12, 22, 60, 200))))
        size = len(text.split())
        rows += [text] + [changed(rng, text, rng.randrange(1 + size // 40)) for _ in range(3)]
        rows += [text.upper() + " ", text + " more", text.split(" ", 1)[-1]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_all_links_are_found_and_no_other(docs, copies):
    want = plain(copies)
    assert found(docs, copies) == want
    assert 100 < len({head for _, _, head in want}) < len(copies) - 150


@pytest.mark.parametrize("width, percent", [(1, 80), (5, 95)])
def test_other_bounds(docs, copies, width, percent):
    assert found(docs, copies[:200], width=width, percent=percent) == [
        r for r in plain(copies[:200], width, percent)]


def test_whole_table(small):
    df, rows = small
    got = jaccard_components(df).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_families_of_many_tiles(docs, monkeypatch):
    """Hubs and chains over more tiles than one: each link counts."""
    rng = random.Random(2)
    monkeypatch.setattr(jaccard, "TILE_POINTS", 6)
    base = " ".join(f"h{i}" for i in range(240))
    rows = [changed(rng, base, 3) for _ in range(60)] + [base]        # like base, not each other
    rows += [changed(rng, base, 1) for _ in range(40)]
    rows += [changed(rng, changed(rng, base, 8), 2) for _ in range(20)]
    rows += [" ".join(f"c{i}" for i in range(4 * k, 4 * k + 104)) for k in range(40)]  # a chain
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = plain(rows)
    assert found(docs, rows) == want
    sizes = sorted(np.bincount([h for _, _, h in want]))[::-1]
    assert sizes[0] > 90 and sizes[1] == 40


def test_odd_rows(docs, odd):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a\x0bB"), (6, "a"), (None, "a b c"),
            (None, "a b c"), (None, "other words here now"), (7, "a B c"), (7, "something else now"),
            (8, None), (9, "ÄÖ x"), (10, "äö x"), (None, None)]
    assert found(docs, rows) == plain(rows)
    assert len(jaccard_components(odd).collect()) == odd.count()
    assert jaccard_components(odd.limit(0)).collect() == []


def test_long_text(docs):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10**5)}" for _ in range(2_500_000))
    rows = [(1, text), (2, text + " and more"), (3, text[:len(text) // 2])]
    assert [r[2] for r in found(docs, rows)] == [1, 1, 3]


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(4)
    bases = [rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.08], rng.integers(
        0, 2**64, max(1, len(b) // 12), dtype=np.uint64)])) for b in bases for _ in range(9)]
    sizes = np.array([len(s) for s in sets])
    points = counttree.vectors(sets, counttree.dimensions(int(sizes.max())))
    tree = counttree.CountTree(points, sizes, 90)
    assert len(tree.levels) > 2
    for n in range(len(sets)):
        bound = np.minimum(points, points[n]).sum(axis=1)
        want = np.flatnonzero((bound >= counttree.needed(sizes, sizes[n], 90))
                              & (100 * sizes >= 90 * sizes[n]) & (90 * sizes <= 100 * sizes[n]))
        assert sorted(tree.search(points[n], int(sizes[n])).tolist()) == want.tolist()


def test_alike_sets_share_a_block():
    rng = np.random.default_rng(5)
    for percent in (60, 90):
        for size in (*range(1, 60), 200, 999):
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            lost = int(size * (100 - percent) // (100 + percent))
            for b in (a[lost:], np.concatenate([a[lost:], rng.integers(0, 2**64, lost, np.uint64)]),
                      np.concatenate([a, rng.integers(0, 2**64, size * (100 - percent) // percent, np.uint64)])):
                common = len(np.intersect1d(a, b))
                if 100 * common < percent * (len(a) + len(b) - common) or len(b) == size == common:
                    continue
                owner = np.repeat([0, 1], [len(a), len(b)])
                of, block = jaccard.blocks(owner, np.concatenate([np.sort(a), np.sort(b)]), 2, percent)
                assert set(block[of == 0]) & set(block[of == 1])
