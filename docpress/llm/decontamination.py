"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpress.llm.common import LAST_ID, order_id, slices, stored
from docpress.llm.segments import (
    SegmentHasher, add_votes, joined_words, majority, mix, text_bytes)
from docpress.llm.substrings import rolling

SHINGLE = 5
SIMILARITY = 0.8
# Bits in which fingerprints of texts that are 0.8 alike may differ: about 10 are
# expected, with a spread of 3. The most that two flips in each block still find.
RADIUS = 23
BLOCKS = 8
# Size of the filter of item shingles that every worker gets: this many bits for each
# shingle, and never more than 2**27 bits (16 MB). A fuller filter lets more windows
# through to the search; it never loses one.
FILTER_BITS_EACH = 32
FILTER_BITS_MOST = 27
# Shingles unfolded at once.
PIECE = 1 << 17

_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
                  for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_hashes(texts: pa.Array, hasher: SegmentHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and how many words precede each text.

    Words are runs of ASCII letters and digits and of all non-ASCII characters.
    """
    data, offsets = text_bytes(texts)
    starts, ends, firsts = joined_words(data, offsets, _WORD)
    words = hasher(_LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return words, firsts


def repeats_apart(owner: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Shingles such that the k-th of equal ones of an owner is a value of its own.

    Sets of such values have the intersections of the multisets they stand for.
    """
    order = np.lexsort((shingles, owner))
    o, s = owner[order], shingles[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    rank = np.arange(len(order)) - at[np.cumsum(new) - 1] if len(order) else np.arange(0)
    out = shingles.copy()
    again = rank > 0
    out[order[again]] = mix(s[again] + rank[again].astype(np.uint64))
    return out


def simhashes(owner: np.ndarray, shingles: np.ndarray, owners: int) -> np.ndarray:
    """SimHash of each owner's shingles, one vote for each occurrence."""
    votes = np.zeros((owners, 64), np.int32)
    add_votes(votes, owner, mix(shingles))
    return majority(votes, np.bincount(owner, minlength=owners))


def _lists(owner: np.ndarray, values: np.ndarray, owners: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                    pa.array(values.view(np.int64)))


def _expand(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and positions of runs of ``counts`` positions from ``first`` on."""
    owner = np.repeat(np.arange(len(first)), counts)
    before = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - before[owner] + first[owner]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SegmentHasher()
    for batch in slices(batches):
        words, firsts = word_hashes(batch.column("text"), hasher)
        sizes = np.diff(firsts)
        for width in range(1, SHINGLE + 1):  # shorter items are one shingle
            rows = np.flatnonzero(sizes >= width if width == SHINGLE else sizes == width)
            if not len(rows):
                continue
            grams = rolling(words, width)
            owner, at = _expand(firsts[rows], sizes[rows] - width + 1)
            plain = grams[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(rows)), pa.array(sizes[rows]),
                 pa.array(simhashes(owner, plain, len(rows)).view(np.int64)),
                 _lists(owner, plain, len(rows)),
                 _lists(owner, repeats_apart(owner, plain), len(rows))],
                names=["item_id", "n_words", "fp", "plain", "shingles"])


def _sized(grams: np.ndarray, size: int) -> np.ndarray:
    return mix(grams + np.uint64(size))


def shingle_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bitmap of the items' shingles, alone and together with the item's size; sizes.

    Spark sets the bits, 64 to a word; at most 2**21 words reach the driver. There are
    fewer different sizes than the square root of twice the benchmark's words.
    """
    sizes = [r[0] for r in items.select("n_words").distinct().collect()]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column("plain")
            grams = plain.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.repeat(batch.column("n_words").to_numpy(),
                             pa.compute.list_value_length(plain).to_numpy())
            both = np.unique(np.concatenate([grams, mix(grams + size.astype(np.uint64))]))
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64))], names=["h"])

    hashes = stored(items.select("plain", "n_words").mapInArrow(bits, "h long").distinct(),
                    "benchmark-shingles")
    wanted = max(1, hashes.count() * FILTER_BITS_EACH)
    power = min(FILTER_BITS_MOST, max(12, (wanted - 1).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit((1 << power) - 1).cast("long"))
    rows = (hashes.select(F.shiftright(bit, 6).alias("word"),
                          F.call_function("shiftleft", F.lit(1).cast("long"),
                                          bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))
                          .alias("set"))
            .groupBy("word").agg(F.bit_or("set").alias("set")).toArrow())
    table = np.zeros(1 << power - 6, np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return table, sorted(sizes)


def _holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(len(table) * 64 - 1)
    return table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1


def needed(size: int, similarity: float) -> int:
    """Shingles that two texts of ``size`` words share if they are ``similarity`` alike."""
    shingles = max(size - SHINGLE + 1, 1)
    return max(1, ceil(2 * similarity / (1 + similarity) * shingles - 1e-9))


def windows_of(words: np.ndarray, firsts: np.ndarray, size: int, table: np.ndarray,
               similarity: float, hits: np.ndarray, grams: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` words that hold enough shingles of items of that size.

    Returns text, first word and words of each. A text with fewer words than the size
    is one window. ``hits`` are places of shingles that some item has.
    """
    width = min(size, SHINGLE)
    shingles, need = size - width + 1, needed(size, similarity)
    hit = hits[_holds(table, _sized(grams[hits], size))]
    doc = np.searchsorted(firsts, hit, side="right") - 1
    found_doc, found_at, found_size = [], [], []
    if len(hit) >= need:
        a, b = hit[:len(hit) - need + 1], hit[need - 1:]
        near = (doc[:len(a)] == doc[need - 1:]) & (b - a < shingles)
        low = np.maximum(b[near] - shingles + 1, firsts[doc[:len(a)][near]])
        high = np.minimum(a[near], firsts[doc[:len(a)][near] + 1] - size)
        some = high >= low
        _, at = _expand(low[some], (high - low + 1)[some])
        at = np.unique(at)
        found_doc.append(np.searchsorted(firsts, at, side="right") - 1)
        found_at.append(at)
        found_size.append(np.full(len(at), size))
    lengths = np.diff(firsts)
    enough = np.bincount(doc, minlength=len(lengths)) >= ceil(similarity * shingles - 1e-9)
    short = np.flatnonzero((lengths < size) & (lengths >= width) & enough)
    found_doc.append(short)
    found_at.append(firsts[short])
    found_size.append(lengths[short])
    return tuple(np.concatenate(x).astype(np.int64) for x in (found_doc, found_at, found_size))


def first_of_equal(doc: np.ndarray, at: np.ndarray, counts: np.ndarray,
                   sums: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each text's windows with the same shingles the first, in order.

    ``sums`` are running sums of two hashes of the shingles, so that the difference of two
    of them is a hash of the multiset between, however long the window is.
    """
    keys = np.stack([doc.astype(np.uint64), *(s[at + counts] - s[at] for s in sums)], axis=1)
    order = np.lexsort((at, keys[:, 2], keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    return np.sort(order[new])


def _running_sums(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.zeros(1, np.uint64)
    return tuple(np.concatenate([start, np.cumsum(mix(grams ^ np.uint64(seed)), dtype=np.uint64)])
                 for seed in (1, 2))


def _window_maker(filter_table, sizes: list[int], similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = SegmentHasher(), filter_table.value
        for batch in slices(batches):
            words, firsts = word_hashes(batch.column("text"), hasher)
            hits_of = {}
            for width in {min(s, SHINGLE) for s in sizes}:
                grams = rolling(words, width)
                at = np.flatnonzero(_holds(table, grams))
                doc = np.searchsorted(firsts, at, side="right") - 1
                hits = at[at + width <= firsts[doc + 1]]
                hits_of[width] = hits, grams, _running_sums(grams) if len(hits) else None
            for size in sizes:
                width = min(size, SHINGLE)
                hits, grams, sums = hits_of[width]
                if not len(hits):
                    continue
                doc, at, n_words = windows_of(words, firsts, size, table, similarity, hits, grams)
                kept = first_of_equal(doc, at, n_words - width + 1, sums)
                doc, at, n_words = doc[kept], at[kept], n_words[kept]
                counts = n_words - width + 1
                piece = (np.cumsum(counts) - 1) // PIECE
                for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(piece)) + 1):
                    if not len(part):
                        continue
                    owner, place = _expand(at[part], counts[part])
                    plain = grams[place]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(doc[part])),
                         pa.array(at[part] - firsts[doc[part]]), pa.array(n_words[part]),
                         pa.array(simhashes(owner, plain, len(part)).view(np.int64)),
                         _lists(owner, repeats_apart(owner, plain), len(part))],
                        names=["key", "start", "n_words", "fp", "shingles"])

    return run


def block_values(fp: str, blocks: int, flips: int) -> list[Column]:
    """Rows (block, value) of a fingerprint: each block, and each value ``flips`` bits
    from it at most."""
    width = 64 // blocks
    masks = [0]
    layer = [0]
    for _ in range(flips):
        layer = sorted({m | 1 << b for m in layer for b in range(width)} - set(masks))
        masks += layer
    mask_column = F.array(*(F.lit(m).cast("long") for m in masks))

    def row(block: int) -> Column:
        value = F.shiftrightunsigned(fp, block * width).bitwiseAND(
            F.lit((1 << width) - 1).cast("long"))
        return F.transform(mask_column, lambda mask: F.struct(
            F.lit(block).alias("block"), value.bitwiseXOR(mask).alias("value")))

    return [row(block) for block in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                 similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS
                 ) -> DataFrame:
    """Documents that hold a passage like a benchmark item: a row for each such pair.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
    lower-cased; shingles are five words (all words of a shorter item). A passage is a
    window of as many words as the item has, at any word of the document, or the whole
    of a shorter document; likeness is shared by joined weight of the two shingle
    multisets, each shingle weighing as often as it occurs, and must reach
    ``similarity``. Of each pair the best window is returned: ``doc_id``,
    ``item_id``, ``start`` (in words), ``n_words``, ``similarity``.

    A window of the size of an item cannot be alike unless it holds nearly all of that
    many shingles of items of the same size; a filter of item shingles, of bounded
    size, leaves such windows only and loses none. These are fingerprinted by SimHash
    and looked up: fingerprints at most ``radius`` bits apart agree in one of
    ``blocks`` blocks within ``radius // blocks`` bits, and items are indexed under all
    those values. The exact likeness verifies each candidate. Windows with the same
    shingles are looked up and verified once, however many documents hold them; of those
    of one text only the first is made at all, and windows are unfolded a bounded number
    of shingles at a time, so a text that repeats an item takes no more memory.

    NULL and empty texts and items without a word match nothing. NULL ids, of documents
    or items, are returned as NULL, as one id; repeated rows, of documents or items, give
    one row for each pair of ids. Other columns are not carried. Empty tables, either
    or both, give no rows.
    """
    if 64 % blocks:
        raise ValueError(f"blocks must divide 64, got {blocks}")
    spark = docs.sparkSession
    items = stored(benchmark.select(
        order_id(item_id_col).alias("item_id"),
        F.col(item_text_col).cast("string").alias("text")).mapInArrow(
            _items, "item_id long, n_words long, fp long, plain array<long>, shingles array<long>"),
        "benchmark-items").select("item_id", "n_words", "fp", "plain", "shingles")
    table, sizes = shingle_filter(items)
    shared = spark.sparkContext.broadcast(table)
    windows = stored(docs.select(
        order_id(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _window_maker(shared, sizes, similarity),
            "key long, start long, n_words long, fp long, shingles array<long>")
        .withColumn("class", F.struct(F.xxhash64("shingles").alias("c1"),
                                      F.xxhash64(F.lit(1), "shingles").alias("c2"))), "windows")
    classes = stored(windows.groupBy("class").agg(
        F.first("fp").alias("fp"), F.first("shingles").alias("shingles")), "window-classes")
    looked_up = classes.select("class", "fp", F.explode(F.concat(*block_values("fp", blocks, 0)))
                               .alias("b")).select("class", "fp", "b.*")
    index = items.select("item_id", F.col("fp").alias("item_fp"), F.explode(F.concat(
        *block_values("fp", blocks, radius // blocks))).alias("b")).select(
            "item_id", "item_fp", "b.*")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    candidates = (looked_up.join(index, ["block", "value"]).where(near)
                  .select("class", "item_id").distinct())
    both = candidates.join(classes.select("class", "shingles"), "class").join(
        items.select("item_id", F.col("shingles").alias("item_shingles")), "item_id")
    common = F.size(F.array_intersect("shingles", "item_shingles"))
    alike = common / (F.size("shingles") + F.size("item_shingles") - common)
    verified = stored(both.select("class", "item_id", alike.alias("similarity"))
                      .where(F.col("similarity") >= similarity - 1e-12), "verified")
    best = (windows.select("class", "key", "start", "n_words").join(verified, "class")
            .groupBy("key", "item_id").agg(F.max(F.struct(
                "similarity", (-F.col("start")).alias("before"), "n_words")).alias("best")))
    return best.select(
        F.nullif(F.col("key"), F.lit(LAST_ID)).alias("doc_id"),
        F.nullif(F.col("item_id"), F.lit(LAST_ID)).alias("item_id"), (-F.col("best.before")).alias("start"), "best.n_words", "best.similarity")
