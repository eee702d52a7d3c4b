"""N-gram Jaccard join: sets of shingles as points of an R-tree over group counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpress.llm.common import LAST_ID, bitmap, holds, order_id, partitions, slices, stored
from docpress.llm.components import components
from docpress.llm.counttree import Tile
from docpress.llm.segments import SegmentHasher, joined_words, mix, text_bytes
from docpress.llm.substrings import rolling

# Points and shingles of a tile; a tree covers one tile.
TILE_POINTS = 4096
TILE_SHINGLES = 1 << 20
# Sizes of sets that are told apart; no text has as many words.
MOST_SIZE = 1 << 40

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IS_WORD = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_ID = pa.decimal128(38, 0)


def shingle_sets(texts: pa.Array, width: int, hasher: SegmentHasher
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of each text, sorted by both.

    A text with fewer than ``width`` words has one shingle, all its words; one without
    words none.
    """
    data, offsets = text_bytes(texts)
    starts, ends, firsts = joined_words(data, offsets, _IS_WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words, sizes = hasher(_LOWER[data], starts, ends), np.diff(firsts)
    owners, hashes = [], []
    for n in range(1, width + 1):
        rows = np.flatnonzero(sizes >= n if n == width else sizes == n)
        if len(rows):
            counts = sizes[rows] - n + 1
            before = np.cumsum(counts) - counts
            at = np.arange(counts.sum()) + np.repeat(firsts[rows] - before, counts)
            owners.append(np.repeat(rows, counts))
            hashes.append(mix(rolling(words, n)[at] + np.uint64(n)))
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def set_ids(owner: np.ndarray, hashes: np.ndarray, owners: int
            ) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A 126-bit hash of each set as a number, its lower 64 bits, and the set's size."""
    sizes = np.bincount(owner, minlength=owners).astype(np.int64)
    halves = np.zeros((owners, 2), np.uint64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for half, salt in enumerate((0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C)):
        if len(starts):
            halves[owner[starts], half] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts)
        halves[:, half] = mix(halves[:, half] + sizes.astype(np.uint64))
    halves[:, 1] >>= np.uint64(2)
    number = pa.Array.from_buffers(_ID, owners, [None, pa.py_buffer(halves.astype("<u8").tobytes())])
    return number, halves[:, 0].copy().view(np.int64), sizes


def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each class, and the number of groups in which its sets are compared.

    Alike sets lie in one class or in neighbouring ones. Two of them differ in r
    shingles at most; of r + 1 groups one then has the same content in both.
    """
    firsts = [1]
    while firsts[-1] < MOST_SIZE:
        firsts.append(max(firsts[-1] + 1, -(-firsts[-1] * 100 // percent)))
    firsts = np.array(firsts, np.int64)
    differ = 2 * (firsts[1:] - 1) * (100 - percent) // (100 + percent)
    return firsts[:-1], differ + 1


def blocks(owner: np.ndarray, hashes: np.ndarray, owners: int, percent: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of what each group of a set holds, in its class and the next."""
    firsts, groups = size_classes(percent)
    sizes = np.bincount(owner, minlength=owners)
    own = np.searchsorted(firsts, sizes, "right") - 1
    out = []
    for step in (0, 1):
        cls = np.maximum(own, 0) + step
        many = np.where((sizes > 0) & (groups[cls] > 1), groups[cls], 0)
        before = np.cumsum(many) - many
        held = np.zeros(int(many.sum()), np.uint64)
        listed = many[owner] > 0
        o, h = owner[listed], hashes[listed]
        group = ((h >> np.uint64(32)) * many[o].astype(np.uint64)) >> np.uint64(32)
        np.add.at(held, before[o] + group.astype(np.int64), mix(h ^ np.uint64(0x5A5A5A5A5A5A5A5A)))
        of = np.repeat(np.arange(owners), many)
        place = np.arange(len(of)) - before[of]
        out.append((of, mix(held + mix((cls[of] << 32 | place).astype(np.uint64)))))
    return tuple(np.concatenate(c) for c in zip(*out))


def _described(width: int):
    """Rows ``key``, ``id``, ``node``, ``size``: the set of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SegmentHasher()
        for batch in slices(batches):
            owner, hashes = shingle_sets(batch.column("text"), width, hasher)
            number, node, size = set_ids(owner, hashes, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), number, pa.array(node), pa.array(size)],
                names=["key", "id", "node", "size"])

    return run


def _blocks(width: int, percent: int, shared=None):
    """Rows ``block``, ``node``; of ``shared`` blocks, if given, and once for a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SegmentHasher()
        for batch in slices(batches):
            owner, hashes = shingle_sets(batch.column("text"), width, hasher)
            _, node, _ = set_ids(owner, hashes, batch.num_rows)
            # Copies have the same blocks.
            once = np.zeros(batch.num_rows, bool)
            once[np.unique(node, return_index=True)[1]] = True
            kept = once[owner]
            of, block = blocks(owner[kept], hashes[kept], batch.num_rows, percent)
            if shared:
                some = holds(shared.value, block)
                of, block = of[some], block[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.view(np.int64)), pa.array(node[of])], names=["block", "node"])

    return run


def _listed(width: int, wanted):
    """Rows ``id``, ``node``, ``shingles`` of the texts whose key may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SegmentHasher()
        for batch in slices(batches):
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.flatnonzero(holds(wanted.value, keys))
            if not len(rows):
                continue
            owner, hashes = shingle_sets(batch.column("text").take(pa.array(rows)), width, hasher)
            number, node, size = set_ids(owner, hashes, len(rows))
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
            once = pa.array(np.sort(np.unique(node, return_index=True)[1]))
            yield pa.RecordBatch.from_arrays(
                [number.take(once), pa.array(node).take(once), lists.take(once)],
                names=["id", "node", "shingles"])

    return run


# What a row is to its tile: a member, a member that looks for links, one that asks only.
MEMBER, LOOKS, ASKS = range(3)


def _linker(percent: int):
    """Links found in each tile, from rows sorted by tile and by what they are to it."""
    def inner(rows: list[tuple]) -> tuple[Tile, Iterator[tuple]]:
        tile = Tile([r[3] for r in rows], [r[1] for r in rows], percent)
        looks = rows[0][2] == LOOKS and len({r[1] for r in rows}) > 1
        return tile, ((rows[a][0], rows[b][0]) for a, b in (tile.inner() if looks else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, tile = None, [], None
        for batch in batches:
            found: list[tuple] = []
            lists = batch.column("shingles")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for n, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (
                    "family", "tile", "id", "root", "role")))):
                if row[:2] != now:
                    found += inner(rows)[1] if rows and tile is None else ()
                    now, rows, tile = row[:2], [], None
                hashes = np.sort(values[bounds[n]:bounds[n + 1]].view(np.uint64))
                if row[4] != ASKS:
                    rows.append((*row[2:], hashes))
                elif rows:
                    if tile is None:
                        tile, _ = inner(rows)
                    found += ((row[2], rows[other][0]) for other in tile.asked(hashes, row[3]))
            if found:
                yield _pairs(found)
        if rows and tile is None:
            yield _pairs(list(inner(rows)[1]))

    return run


def _pairs(links: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([link[side] for link in links], _ID) for side in (0, 1)], names=["a", "b"])


def _in_trees(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` found by a tree for each ``family`` and ``tile`` of ``rows``."""
    dealt = rows.select("family", "tile", "id", "root", "role", "shingles")
    return (dealt.repartition(partitions(rows.sparkSession), "family", "tile")
            .sortWithinPartitions("family", "tile", "role", "id")
            .mapInArrow(_linker(percent), "a decimal(38,0), b decimal(38,0)"))


def _tiled(points: DataFrame) -> DataFrame:
    """``points`` (``family``, ``id``, ``size``) with ``tile`` and the family's number of ``tiles``.

    A large family is cut into slabs of like size; a slab that is still too large, by
    a hash. Only sizes are gathered, as approximate quantiles of each large family.
    """
    share = F.greatest(F.ceil(F.count("*") / TILE_POINTS), F.ceil(F.sum("size") / TILE_SHINGLES))
    families = stored(points.groupBy("family").agg(share.alias("tiles")), "families")
    large = families.where("tiles > 1").select("family", "tiles")
    cuts = (points.join(large, "family").groupBy("family")
            .agg(F.percentile_approx("size", [n / 16 for n in range(1, 16)], 1000).alias("cuts")))
    slab = F.size(F.filter("cuts", lambda c: c < F.col("size")))
    slabs = stored(points.join(families, "family").join(cuts, "family", "left").select(
        points["*"], "tiles", F.coalesce(slab, F.lit(0)).alias("slab")), "slabs")
    full = slabs.where("tiles > 1").groupBy("family", "slab").agg(share.alias("salts"))
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))
    return slabs.join(full, ["family", "slab"], "left").select(
        points.columns + ["tiles", F.struct("slab", salt.cast("long").alias("salt")).alias("tile")])


def _known(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with ``root`` by ``links``; an id without links is its own root."""
    roots = components(links).withColumnRenamed("node", "linked")
    rows = rows.drop("root")
    return rows.join(roots, rows["id"] == roots["linked"], "left").select(
        *rows.columns, F.coalesce("root", "id").alias("root"))


def alike_sets(texts: DataFrame, described: DataFrame, width: int, percent: int) -> DataFrame:
    """``node`` and ``root``: ids of sets that alike pairs connect, and one of each component."""
    schema = "block long, node long"
    shared = stored(texts.mapInArrow(_blocks(width, percent), schema).groupBy("block").agg(
        F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
        .select("block", "head"), "shared-blocks")
    some = bitmap(shared.select("block"))
    stars = (texts.mapInArrow(_blocks(width, percent, some), schema).join(shared, "block")
             .where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    families = stored(components(stars).select("node", F.col("root").alias("family")), "block-families")
    points = stored(described.where("size > 0").groupBy("id", "node", "size").agg(
        F.min("key").alias("key")).join(families, "node"), "points")
    lists = texts.mapInArrow(_listed(width, bitmap(points.select("key"))),
                             "id decimal(38,0), node long, shingles array<long>")
    tiled = stored(_tiled(points.select("family", "id", "size")), "tiles")
    members = stored(lists.groupBy("id").agg(F.first("shingles").alias("shingles"))
                     .join(tiled, "id"), "members")
    looks, asks, member = (F.lit(r).alias("role") for r in (LOOKS, ASKS, MEMBER))
    first = stored(_in_trees(members.select("*", F.col("id").alias("root"), looks), percent),
                   "links-in-tiles")
    # A family of one tile is done. Those of more tiles are dealt out anew by a hash, so that what is alike
    # throughout becomes one; then all but the commonest root of a family ask all tiles.
    large = stored(members.where("tiles > 1"), "large-families")
    if large.isEmpty():
        return first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    of_large = large.select("id")
    small = first.join(of_large, F.col("a") == F.col("id"), "left_anti")
    first = stored(first.join(of_large, F.col("a") == F.col("id"), "left_semi"), "large-links")
    again = F.struct(F.lit(-1).alias("slab"),
                     F.pmod(F.xxhash64("id", F.lit(1)), "tiles").alias("salt"))
    rooted = stored(_known(large, first), "large-members")
    second = stored(first.union(_in_trees(rooted.select("*", looks).withColumn("tile", again),
                                          percent)), "links-again")
    rooted = stored(_known(rooted, second), "large-rooted")
    common = (rooted.groupBy("family", "root").count().groupBy("family")
              .agg(F.max_by("root", F.struct("count", "root")).alias("common")))
    asking = rooted.join(common, "family").where("root <> common").drop("tile")
    spans = stored(rooted.groupBy("family", "tile").agg(
        F.min("size").alias("low"), F.max("size").alias("high")), "tile-sizes")
    fits = ((100 * F.col("high") >= percent * F.col("size"))
            & (percent * F.col("low") <= 100 * F.col("size")))
    columns = ["family", "tile", "id", "root", "shingles"]
    asked = asking.join(spans, "family").where(fits).select(*columns, asks)
    last = _in_trees(rooted.select(*columns, member).unionByName(asked), percent)
    return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        components(second.union(last)))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``: the smallest id reachable over links.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text's set holds
    its distinct shingles of ``width`` words (all words of a shorter text). Two texts link
    when 100 * intersection >= ``percent`` * union.

    Shingles are hashed into groups. Alike sets differ in few shingles, so of somewhat
    more groups one has the same content in both: sets that share such a block become
    families, and only within one can there be links. A family's sets are points whose
    coordinates are the group counts, in an R-tree for each of its tiles
    (:mod:`docpress.llm.counttree`): summed coordinate minima bound the overlap with a
    box, then with a point, and the whole sets of the pairs that survive are compared.
    Pairs that are connected already are not looked at again. Equal sets are one
    point, so copies in any number add no links.

    Texts without words have no set, link with nothing and keep their own id. NULL ids
    count as larger than all others; a component of such rows alone has a NULL id. Rows of
    one id are each returned, by their own texts. Other columns are not carried.
    An empty table gives no rows.
    """
    if not 50 <= percent <= 99:
        raise ValueError(f"percent must be 50 to 99, got {percent}")
    texts = docs.select(order_id(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    described = stored(texts.mapInArrow(
        _described(width), "key long, id decimal(38,0), node long, size long"), "sets")
    roots = alike_sets(texts, described, width, percent)
    firsts = described.where("size > 0").groupBy("id").agg(F.min("key").alias("first"))
    rooted = stored(firsts.join(roots, firsts["id"] == roots["node"], "left").select(
        "id", "first", F.coalesce("root", "id").alias("root")), "rooted-sets")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    named = rooted.join(heads, "root").select("id", "head")

    def shown(head: Column | str) -> Column:
        return F.nullif(head if isinstance(head, Column) else F.col(head), F.lit(LAST_ID))

    return described.join(named, "id", "left").select(
        shown("key").alias("doc_id"), F.col("size").alias("n_shingles"),
        shown(F.coalesce("head", "key")).alias("component_id"))
