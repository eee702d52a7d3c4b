"""Phrase collocations: frequent phrases counted in tries of word ids, scored by their parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpress.llm.common import bitmap, holds, partitions, slices, stored
from docpress.llm.hattrie import MOST_LANGS, MOST_WORDS, HatTrie, packed, unpacked
from docpress.llm.segments import joined_words, text_bytes

NO_LANG = "und"
# Bytes of words that a task keeps ids for; then it spills its trie and starts anew.
VOCABULARY_BYTES = 32 << 20
# Longer texts are counted in parts that end where a piece does.
PART_BYTES = 4 << 20

_BREAKS = np.array([chr(b) in ".,;:!?\n\x0b\x0c\r" for b in range(256)])
_IS_WORD = ~_BREAKS & np.array([b not in (9, 32) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SEED = 42


def parts(texts: pa.Array, langs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, offsets and languages of texts; a long text in parts.

    A part ends behind a break between pieces, so no phrase is cut.
    """
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    if len(data) <= PART_BYTES:
        yield data, offsets, langs
        return
    for n, lang in enumerate(langs):
        start, end = offsets[n], offsets[n + 1]
        while start < end:
            stop = end
            if end - start > PART_BYTES:
                breaks = np.flatnonzero(_BREAKS[data[start + PART_BYTES:end]])
                stop = start + PART_BYTES + breaks[0] + 1 if len(breaks) else end
            yield data[start:stop], np.array([0, stop - start]), np.array([lang])
            start = stop


class Vocabulary:
    """Ids of the words of a task, and whether each is frequent in a language."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.words: list[str] = []
        self.bytes = 0

    def number(self, words: pa.Array) -> np.ndarray:
        found = words.dictionary_encode()
        ids = np.empty(len(found.dictionary), np.int64)
        for n, word in enumerate(found.dictionary.to_pylist()):
            number = self.ids.get(word)
            if number is None:
                number = self.ids[word] = len(self.words)
                self.words.append(word)
                self.bytes += len(word) + 100
            ids[n] = number
        return ids[found.indices.to_numpy()]


def word_hash(lang: str, word: str) -> int:
    """Spark's ``xxhash64(lang, word)``, unsigned."""
    seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
    return xxhash.xxh64_intdigest(word.encode(), seed)


def _pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return one ^ (two << np.uint64(1) | two >> np.uint64(63))


def _pair_column(lang: str, phrase: str) -> Column:
    """What :func:`_pair_hash` gives, of the two words of a phrase."""
    one, two = (F.xxhash64(lang, F.split_part(phrase, F.lit(" "), F.lit(n))) for n in (1, 2))
    return one.bitwiseXOR(F.shiftleft(two, 1).bitwiseOR(F.shiftrightunsigned(two, 63)))


_COUNTED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("phrase", pa.string()),
                      ("n", pa.int64())])


class Counter:
    """Phrases of one task, counted in a trie; what it spills and ends with are runs."""

    def __init__(self, lengths: tuple[int, ...], filter_table: np.ndarray | None):
        self.lengths, self.table = lengths, filter_table
        self._start()

    def _start(self) -> None:
        self.trie, self.words, self.langs = HatTrie(), Vocabulary(), {}
        self.hashes = np.zeros(0, np.uint64)
        self.hash_keys = np.zeros(0, np.int64)

    def add(self, texts: pa.Array, langs: list[str]) -> Iterator[pa.RecordBatch]:
        if len(self.words.words) > MOST_WORDS // 2 or len(self.langs) > MOST_LANGS // 2 or (
                self.words.bytes > VOCABULARY_BYTES):
            yield from self.end()
            self._start()
        numbers = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        for data, offsets, lang in parts(texts, numbers):
            for prefix, rest in self._phrases(data, offsets, lang):
                for run in self.trie.add(prefix, rest):
                    yield self._written(*run)

    def _phrases(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> Iterator[tuple]:
        starts, ends, firsts = joined_words(data, offsets, _IS_WORD)
        if not len(starts):
            return
        inside = data[_IS_WORD[data]]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        ids = self.words.number(pa.Array.from_buffers(
            pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(inside)]))
        owner = np.repeat(np.arange(len(langs)), np.diff(firsts))
        breaks = np.cumsum(_BREAKS[data], dtype=np.int32)[starts]
        lang = langs[owner]
        # Words that go on the piece of the word before.
        goes_on = np.zeros(len(starts) + 3, bool)
        goes_on[1:len(starts)] = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])
        if self.lengths == (1,):
            yield packed(lang, [ids])
            return
        hashes = self._hashes(lang, ids)
        if self.lengths == (2,):
            frequent = holds(self.table, hashes)
            at = np.flatnonzero(goes_on[1:len(starts)] & frequent[:-1] & frequent[1:])
            yield packed(lang[at], [ids[at], ids[at + 1]])
            return
        # Longer phrases are frequent only if every two words of theirs are.
        pair = np.zeros(len(starts) + 3, bool)
        pair[:len(starts) - 1] = goes_on[1:len(starts)] & holds(
            self.table, _pair_hash(hashes[:-1], hashes[1:]))
        for length in self.lengths:
            joined = pair[:len(starts)].copy()
            for n in range(1, length - 1):
                joined &= pair[n:n + len(starts)]
            at = np.flatnonzero(joined)
            yield packed(lang[at], [ids[at + n] for n in range(length)])

    def _hashes(self, lang: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Hash of language and word of each place, worked out once for each pair."""
        keys, back = np.unique(lang << 32 | ids, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash_keys, keys), max(len(self.hash_keys) - 1, 0))
        known = self.hash_keys[at] == keys if len(self.hash_keys) else np.zeros(len(keys), bool)
        if not known.all():
            fresh = keys[~known]
            names = list(self.langs)
            new = np.array([word_hash(names[k >> 32], self.words.words[k & 0xFFFFFFFF])
                            for k in fresh.tolist()], np.uint64)
            order = np.argsort(np.concatenate([self.hash_keys, fresh]), kind="stable")
            self.hashes = np.concatenate([self.hashes, new])[order]
            self.hash_keys = np.concatenate([self.hash_keys, fresh])[order]
            at = np.searchsorted(self.hash_keys, keys)
        return self.hashes[at][back]

    def _written(self, prefix: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """A run in order of its phrases, with words in the place of ids."""
        lang, ids = unpacked(prefix, rest)
        used, back = np.unique(np.concatenate(ids), return_inverse=True)
        texts = pa.array([None if i < 0 else self.words.words[i] for i in used.tolist()], pa.string())
        columns = [texts.take(pa.array(b)) for b in np.split(back, 4)]

        def joined(some: list[pa.Array]) -> pa.Array:
            return pa.compute.binary_join_element_wise(*some, " ", null_handling="skip")

        names = pa.array(list(self.langs), pa.string())
        batch = pa.RecordBatch.from_arrays(
            [names.take(pa.array(lang)), joined(columns[:2]), joined(columns), pa.array(counts)],
            schema=_COUNTED)
        order = pa.compute.sort_indices(batch, [("lang", "ascending"), ("phrase", "ascending")])
        return batch.take(order)

    def end(self) -> Iterator[pa.RecordBatch]:
        for run in self.trie.spill():
            yield self._written(*run)


def _counted(lengths: tuple[int, ...], table=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lengths, table.value if table is not None else None)
        for batch in slices(batches):
            yield from counter.add(batch.column("text"), batch.column("lang").to_pylist())
        yield from counter.end()

    return run


def _merged(docs: DataFrame, lengths: tuple[int, ...], table=None) -> DataFrame:
    """Counts of all phrases of these lengths, the tasks' runs merged by their prefix."""
    runs = docs.mapInArrow(_counted(lengths, table), "lang string, prefix string, phrase string, n long")
    # Up to two words are their own prefix; it need not travel beside them.
    keys = ["lang", "prefix", "phrase"] if max(lengths) > 2 else ["lang", "phrase"]
    return (runs.select(*keys, "n").repartition(partitions(docs.sparkSession), *keys[:2])
            .groupBy(*keys).agg(F.sum("n").alias("n"))
            .select("lang", "phrase", "n"))


def phrase_counts(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text",
                  least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Languages with their number of words, and all phrases of one to four words that
    occur ``least`` times or more: ``lang``, ``phrase``, ``words``, ``f``.

    A part of a phrase occurs at least as often as the phrase. So words are counted
    first, then pairs of frequent words, then phrases whose neighbouring words are
    all frequent pairs; what is frequent travels as a bitmap of bounded size, which
    lets too much through if it is full, and never too little.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.col(text_col).cast("string").alias("text"))
    words = stored(_merged(texts, (1,)), "word-counts")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "lang-words")
    words = words.where(F.col("n") >= least)
    frequent = bitmap(words.select(F.xxhash64("lang", "phrase").alias("hash")))
    pairs = stored(_merged(texts, (2,), frequent).where(F.col("n") >= least), "pair-counts")
    frequent = bitmap(pairs.select(_pair_column("lang", "phrase").alias("hash")))
    longer = stored(_merged(texts, (3, 4), frequent).where(F.col("n") >= least), "phrase-counts")
    counted = words.unionByName(pairs).unionByName(longer).select(
        "lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), F.col("n").alias("f"))
    return totals, counted


def _scored(counted: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``score`` of the lowest-scoring cut."""
    whole = counted.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    left, right = (counted.select(F.col("lang"), F.col("phrase").alias(side), F.col("f").alias(name))
                   for side, name in (("left", "l"), ("right", "r")))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # Products may pass 64 bits; a score never does.
    score = F.expr("(2000000 * cast(a as decimal(24, 0))) div (cast(l as decimal(24, 0)) + r)")
    return (cuts.withColumn("score", score.cast("long"))
            .groupBy("lang", "phrase", "words", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"))


def _contained(counted: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` and the greatest count of a longer phrase around it."""
    words = F.split("phrase", " ")
    longer = counted.where("words > 2").select(
        "lang", "words", "f", words.alias("w"),
        F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length"))
    inner = longer.select("lang", "f", "w", "length", F.explode(
        F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)).alias("at"))
    return inner.select("lang", "f", F.array_join(
        F.slice("w", F.col("at"), F.col("length")), " ").alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text",
                 least: int = 30, inside_percent: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to four words of each language, by how firmly they stand.

    Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
    words at spaces and tabs. Candidates occur ``least`` times (``a``); each way to
    cut one in two parts that occur ``l`` and ``r`` times scores
    floor(2000000 a / (l + r)), and the lowest cut counts, of equal ones the first. A
    candidate inside a longer one with ``inside_percent`` of its count is dropped. Returns
    ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of the
    language) and ``score``, by score, ``a`` and phrase.

    Each task counts in a trie (:mod:`docpress.llm.hattrie`) whose largest subtrees spill as
    sorted runs, merged by language and first two words. Languages may be unequal: the
    best are taken in parts of a language before they are ranked.

    NULL languages are ``und``; NULL and empty texts have no words. Repeated rows count
    each. An empty table gives no rows.
    """
    totals, counted = phrase_counts(docs, lang_col=lang_col, text_col=text_col, least=least)
    around = _contained(counted)
    share = F.expr(f"cast(longest as decimal(24, 0)) * 100 >= cast(a as decimal(24, 0)) * {inside_percent}")
    alone = stored(_scored(counted).join(around, ["lang", "phrase"], "left").where(
        ~F.coalesce(share, F.lit(False))), "collocations")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))).alias("part")
    best = alone.select("*", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(
        F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
