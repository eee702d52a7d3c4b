"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from docpress.llm import collocations as module
from docpress.llm import hattrie
from docpress.llm.collocations import collocations
from tests.llm import brute


def plain(rows, least, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) for rows (lang, text)."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(brute.UPPER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + n])] += 1
    out = set()
    for lang, f in counts.items():
        found = []
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for phrase, a in chosen.items():
            size = len(phrase)
            if any(len(q) > size and 100 * b >= 80 * a and any(
                    q[i:i + size] == phrase for i in range(len(q))) for q, b in chosen.items()):
                continue
            score, k = min((2000000 * a // (f[phrase[:k]] + f[phrase[k:]]), k)
                           for k in range(1, size))
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr(
        "*", "'x' as phrase", "1 as n", "2 as words", "3 as rank")
    return {tuple(r) for r in collocations(df, **options).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(1)
    words = ["of", "the", "a", "New", "York", "été", "x" * 300, "漢字", "\x00", "b\xa0c"]
    return [(rng.choice(["en", "en", "fr", "", None]), "".join(
        rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "-"])
        for _ in range(rng.randrange(60)))) for _ in range(200)] + [(None, None), ("de", "")]


@pytest.mark.parametrize("least, top", [(1, 40), (5, 2000), (30, 2000)])
def test_all_phrases_are_counted(spark, chatter, least, top):
    assert found(spark, chatter, least=least, top=top) == plain(chatter, least, top)


def test_small_tries_spill_and_lose_nothing(spark, chatter, monkeypatch):
    """Counting starts anew after a few words, and spills after a few phrases."""
    counted = []
    for table, length in ((None, 1), (np.full(64, 2**64 - 1, np.uint64), 2),
                          (np.full(64, 2**64 - 1, np.uint64), 4)):
        for small in (False, True):
            with monkeypatch.context() as m:
                if small:
                    m.setattr(hattrie.HatTrie.__init__, "__defaults__", (8, 50))
                    m.setattr(module, "VOCABULARY_BYTES", 2_000)
                    m.setattr(module, "PART_BYTES", 100)
                counter, sums, runs = module.Counter((length,), table), Counter(), 0
                for lang, text in chatter:
                    if lang is None or text is None:
                        continue
                    for batch in counter.add(module.pa.array([text]), [lang]):
                        runs += 1
                        sums.update({tuple(r.values())[:3]: 0 for r in batch.to_pylist()})
                        for r in batch.to_pylist():
                            sums[r["lang"], r["prefix"], r["phrase"]] += r["n"]
                for batch in counter.end():
                    phrases = batch.column("phrase").to_pylist()
                    if len(set(batch.column("lang").to_pylist())) == 1:
                        assert phrases == sorted(phrases, key=str.encode)
                    for r in batch.to_pylist():
                        sums[r["lang"], r["prefix"], r["phrase"]] += r["n"]
                assert (runs > 20) == small
                counted.append(sums)
    assert counted[0] == counted[1] and counted[2] == counted[3] and counted[4] == counted[5]
    assert all(counted)


def test_containers_burst():
    rng = np.random.default_rng(2)
    trie, want = hattrie.HatTrie(burst=100, entries=10**9), Counter()
    for _ in range(30):
        lang, a, b = (rng.zipf(1.5, 500) % m for m in (3, 200, 300))
        assert list(trie.add(*hattrie.packed(lang, [a, b]))) == []
        want.update(zip(lang.tolist(), a.tolist(), b.tolist()))
    assert len(trie.containers) > 10
    got = Counter()
    for prefix, rest, counts in trie.spill():
        assert (np.diff(prefix) >= 0).all()
        lang, ids = hattrie.unpacked(prefix, rest)
        assert (ids[2] == -1).all()
        got.update(dict(zip(zip(lang.tolist(), ids[0].tolist(), ids[1].tolist()), counts.tolist())))
    assert got == want and trie.size == 0


def test_long_and_empty_texts(spark):
    rows = [("en", "over and over again, " * 600_000), ("en", "one " * 3_000_000)]
    got = {(r[2], r[3]) for r in found(spark, rows)}
    assert ("over and over again", 600_000) in got and ("one one one one", 2_999_997) in got
    assert found(spark, []) == set() == found(spark, [("en", None), (None, " . \t")])


def test_hash_is_sparks(spark):
    row = spark.sql("select xxhash64('fr', 'été') as h").first()
    assert row["h"] % 2**64 == module.word_hash("fr", "été")
    rows = spark.createDataFrame([("fr", "été là")], "lang string, phrase string")
    one, two = (np.array([module.word_hash("fr", w)], np.uint64) for w in ("été", "là"))
    assert rows.select(module._pair_column("lang", "phrase")).first()[0] % 2**64 == int(
        module._pair_hash(one, two)[0])
