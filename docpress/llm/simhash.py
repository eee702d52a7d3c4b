"""SimHash near-dedup by a generalised pigeonhole over unequal bit groups."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpress.llm.common import (
    LAST_ID, by_row, narrow, order_id, row_mark, slices, stored, without)
from docpress.llm.components import components
from docpress.llm.segments import (
    VOTES_AT_ONCE, add_votes, joined_words, majority, text_bytes)

BITS = 64
HASH_SEED = 42
# Values a bit group is counted by; wider groups are counted by so many of their bits.
COUNTED_BITS = 16
# A fingerprint with more estimated candidates first joins those that differ in one
# or two bits, so that a dense group is linked through few of its pairs.
DENSE = 64
# Cosets of the Hamming code whose words serve as meeting points there. More of them
# leave fewer links to the probes that follow; the components are the same with any.
COSETS = range(0, BITS, 4)

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IS_WORD = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])


def lowered_words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, A-Z lower-cased, one space after each; their starts and
    ends in those bytes, and how many precede each text."""
    data, offsets = text_bytes(texts)
    starts, ends, firsts = joined_words(data, offsets, _IS_WORD)
    if not len(starts):
        return b"", starts, ends, firsts
    keep = _IS_WORD[data]
    lengths = ends - starts
    # A word's bytes and a space, at their new places.
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(at[-1], 32, np.uint8)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    out[place] = _LOWER[data[keep]]
    return out.tobytes(), at[:-1], at[1:] - 1, firsts


def fingerprints_of(texts: pa.Array, width: int) -> np.ndarray:
    """64-bit SimHash of each text: the bits set in over half of its shingle hashes.

    A shingle's hash is the XXH64 of ``width`` words; a text with fewer words has one
    shingle, all its words, and one without words none, which gives zero. Shingles are
    made and counted a bounded number at a time, so a long text takes no more than
    its words do.
    """
    raw, starts, ends, firsts = lowered_words(texts)
    words = np.diff(firsts)
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    before = np.concatenate([[0], np.cumsum(counts)])
    votes = np.zeros((len(counts), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, int(before[-1]), VOTES_AT_ONCE):
        number = np.arange(lo, min(lo + VOTES_AT_ONCE, int(before[-1])))
        owner = np.searchsorted(before, number, side="right") - 1
        first = firsts[owner] + number - before[owner]
        last = np.minimum(first + width, firsts[owner + 1]) - 1
        spans = zip(starts[first].tolist(), ends[last].tolist())
        hashes = np.fromiter((digest(raw[a:b], HASH_SEED) for a, b in spans), np.uint64,
                             len(number))
        add_votes(votes, owner, hashes)
    return majority(votes, counts)


def _fingerprinter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = fingerprints_of(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))],
                names=["doc_id", "fp"])

    return run


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            width: int = 4) -> DataFrame:
    """``doc_id`` and ``fp``, the 64-bit SimHash of each whole text as a signed long."""
    return narrow(docs, id_col, text_col).mapInArrow(
        _fingerprinter(width), "doc_id long, fp long")


# --- how the bits are grouped and the thresholds allotted ------------------------------------

def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set, for all i and j."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            rows += len(fp)
        cells = np.append(total.ravel(), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    summed = prints.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n"))
    cells = dict(summed.collect())  # 64 * 64 + 1 rows
    flat = np.array([cells.get(i, 0) for i in range(BITS * BITS + 1)], np.float64)
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, correlated bits together.

    What varies together then varies inside one group, and the groups are closer to
    independent, which is what lets unequal thresholds pay.
    """
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    tie = np.nan_to_num(tie)
    np.fill_diagonal(tie, 0)
    left, groups = list(range(BITS)), []
    for part in range(parts):
        size = -(-len(left) // (parts - part))
        seed = max(left, key=lambda b: (tie[b, left].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def choose_parts(n: int, radius: int) -> int:
    """Number of groups with the fewest probes and candidates, were bits random."""
    def cost(parts: int) -> float:
        width = BITS // parts
        spare = radius + 1 - parts  # thresholds above 0, dealt out evenly
        total = 0.0
        for part in range(parts):
            top = spare // parts + (part < spare % parts)
            probes = sum(comb(width, k) for k in range(top + 1))
            total += probes * (1 + n / 2.0 ** width)
        return total

    return min(range(2, max(3, radius + 2)), key=cost) if radius else 1


def group_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of one group, packed from bit 0 on."""
    value = np.zeros(len(fp), np.int64)
    for n, bit in enumerate(bits):
        value |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << n
    return value


def _value_column(bits: list[int]) -> Column:
    value = F.lit(0).cast("long")
    for n, bit in enumerate(bits):
        one = F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1).cast("long"))
        value = value.bitwiseOR(F.shiftleft(one, n))
    return value


def candidate_counts(index: DataFrame, groups: list[list[int]], most: int) -> list[np.ndarray]:
    """For each group, value and threshold, how many fingerprints lie within it.

    Counted exactly by the lowest ``COUNTED_BITS`` bits of a group's value (at most
    2**16 counts a group reach the driver), and scaled down for the bits beyond.
    """
    cell = F.col("value").bitwiseAND(F.lit((1 << COUNTED_BITS) - 1).cast("long"))
    rows = index.groupBy("part", cell.alias("cell")).agg(F.count("*").alias("n")).collect()
    out = []
    for part, bits in enumerate(groups):
        counted = min(len(bits), COUNTED_BITS)
        exactly = np.zeros((most + 1, 1 << counted))
        for row in rows:
            if row["part"] == part:
                exactly[0, row["cell"]] = row["n"]
        exactly[0] /= 2.0 ** (len(bits) - counted)
        # One bit after the other: equal, or different at the price of one.
        cells = np.arange(1 << counted)
        for bit in range(len(bits)):
            other = exactly[:, cells ^ (1 << bit)] if bit < counted else exactly
            exactly[1:] = exactly[1:] + other[:-1]
        out.append(np.cumsum(exactly, axis=0))
    return out


def allot(costs: list[np.ndarray], units: int) -> np.ndarray:
    """Cheapest way to deal ``units`` out to the groups, for many rows at once.

    ``costs[i][u]`` holds each row's cost of giving group i u units, that is the
    threshold u - 1; no unit costs nothing, the group is not probed. Dynamic
    programming over the groups; returns the units by group and row.
    """
    rows = costs[0].shape[1]
    best = np.full((units + 1, rows), np.inf)
    best[0] = 0
    chosen = []
    for cost in costs:
        after = np.full_like(best, np.inf)
        choice = np.zeros((units + 1, rows), np.int8)
        for total in range(units + 1):
            for u in range(min(total, len(cost) - 1) + 1):
                price = best[total - u] + cost[u]
                better = price < after[total]
                after[total][better] = price[better]
                choice[total][better] = u
        best = after
        chosen.append(choice)
    out = np.zeros((len(costs), rows), np.int8)
    left = np.full(rows, units)
    for part in range(len(costs) - 1, -1, -1):
        out[part] = chosen[part][left, np.arange(rows)]
        left -= out[part]
    return out


def _masks(width: int, most: int) -> list[np.ndarray]:
    """Masks of a group with at most k bits set, for k = 0 ... ``most``."""
    layers = [np.zeros(1, np.int64)]
    for _ in range(most):
        wider = (layers[-1][:, None] | (np.int64(1) << np.arange(width))[None, :]).ravel()
        layers.append(np.setdiff1d(wider, np.concatenate(layers)))
    return [np.concatenate(layers[:k + 1]) for k in range(most + 1)]


class Probing:
    """Thresholds of each fingerprint, and the values it probes in each group."""

    def __init__(self, groups: list[list[int]], counts: list[np.ndarray], radius: int, most: int):
        self.groups, self.counts, self.radius, self.most = groups, counts, radius, most

    def _thresholds(self, fp: np.ndarray, sizes: list[list[int]]) -> tuple:
        values = [group_value(fp, bits) for bits in self.groups]
        costs = []
        for value, count, probes in zip(values, self.counts, sizes):
            near = count[:, value & (count.shape[1] - 1)]
            costs.append(np.vstack([np.zeros(len(fp)), near + np.array(probes)[:, None]]))
        return values, costs, allot(costs, self.radius + 1)

    def _slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        masks = [_masks(len(bits), self.most) for bits in self.groups]
        sizes = [[len(m) for m in mask] for mask in masks]
        for whole in batches:
            for start in range(0, whole.num_rows, 20_000):
                batch = whole.slice(start, 20_000)
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                yield batch, fp, masks, *self._thresholds(fp.view(np.uint64), sizes)

    def expected(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many probes and candidates each fingerprint is to expect."""
        for _, fp, _, _, costs, units in self._slices(batches):
            total = sum(np.take_along_axis(c, u[None].astype(np.int64), 0)[0]
                        for c, u in zip(costs, units))
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(total)],
                                             names=["fp", "expected"])

    def probes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``part``, ``value``, ``fp``, ``root``: what each fingerprint probes."""
        for batch, fp, masks, values, _, units in self._slices(batches):
            root = batch.column("root").to_numpy(zero_copy_only=False)
            for part, (value, mask) in enumerate(zip(values, masks)):
                for u in range(1, self.most + 2):
                    rows = np.flatnonzero(units[part] == u)
                    if not len(rows):
                        continue
                    probe = (value[rows][:, None] ^ mask[u - 1][None, :]).ravel()
                    each = len(mask[u - 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(probe), part, np.int32)), pa.array(probe),
                         pa.array(np.repeat(fp[rows], each)),
                         pa.array(np.repeat(root[rows], each))],
                        names=["part", "value", "fp", "root"])


# --- links ----------------------------------------------------------------------------------------

def _hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _syndrome(fp: str) -> Column:
    """The numbers (0 to 63) of the bits set, XORed: flipping bit i flips this by i."""
    value = F.lit(0)
    for place in range(6):
        mask = sum(1 << b for b in range(BITS) if b >> place & 1)
        odd = F.bit_count(F.col(fp).bitwiseAND(F.lit(mask - (mask >> 63 << 64)))) % 2
        value = value.bitwiseOR(F.shiftleft(odd, place))
    return value


def _dense_links(prints: DataFrame) -> DataFrame:
    """Links of fingerprints that share a point at most one bit away from each.

    The points are the words of some cosets of a Hamming code: in each coset every
    fingerprint has one word next to it, told by its syndrome, so a fingerprint makes
    a row for each coset and one for itself, not one for each of its 64 bits.
    """
    one = F.lit(1).cast("long")
    flips = F.array(F.lit(0).cast("long"), *(
        F.call_function("shiftleft", one, _syndrome("fp").bitwiseXOR(F.lit(coset)))
        for coset in COSETS))
    points = prints.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    shared = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
    return (points.join(shared.where("least < most"), "point").where("fp > least")
            .select(F.col("fp").alias("a"), F.col("least").alias("b")))


def hamming_links(prints: DataFrame, radius: int, *, parts: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints at most ``radius`` bits apart.

    ``prints`` has distinct values ``fp``. Generalised pigeonhole: the bits are put
    into groups, correlated ones together; with thresholds t_i such that the sum of
    t_i + 1 is ``radius`` + 1, two fingerprints within the radius agree in some group
    within its t_i. Each fingerprint gets the thresholds that promise the fewest
    probes and candidates, by dynamic programming on the counted values of each
    group, so common values are probed less or not at all. It probes an index of
    all fingerprints, and the whole Hamming distance verifies each candidate.

    Fingerprints that expect many candidates are first linked to some of those one or
    two bits away, through shared points; pairs connected by then are not linked once
    more. So a dense group costs few links, and nothing is lost: the links have the
    same connected components as all pairs within the radius.
    """
    if radius == 0:
        empty = prints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
        return empty.where("false")
    n, both = bit_counts(prints)
    groups = group_bits(n, both, parts or choose_parts(n, radius))
    most = min(radius, max(2, -(-(radius + 1) // len(groups))))
    values = F.array(*(F.struct(F.lit(p).alias("part"), _value_column(bits).alias("value"))
                       for p, bits in enumerate(groups)))
    index = prints.select("fp", F.explode(values).alias("v")).select("v.part", "v.value", "fp")
    probing = Probing(groups, candidate_counts(index, groups, most), radius, most)
    # Two that share a point may be two bits apart.
    dense = prints.select("fp").mapInArrow(probing.expected, "fp long, expected double").where(
        (F.col("expected") > DENSE) & F.lit(radius >= 2)).select("fp")
    close = stored(_dense_links(dense), "dense-links")
    roots = components(close).withColumnRenamed("node", "fp")
    rooted = stored(prints.select("fp").join(roots, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")), "dense-roots")
    probes = rooted.mapInArrow(probing.probes, "part int, value long, fp long, root long")
    index = rooted.select(F.col("fp").alias("other"), F.col("root").alias("other_root"),
                          F.explode(values).alias("v")).select(
                              "v.part", "v.value", "other", "other_root")
    near = (F.col("fp") < F.col("other")) & (_hamming("fp", "other") <= radius)
    links = (probes.join(index, ["part", "value"])
             .where(near & (F.col("root") != F.col("other_root")))
             .select(F.col("fp").alias("a"), F.col("other").alias("b")))
    return links.union(close.select("a", "b"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       width: int = 4, radius: int = 4, parts: int | None = None) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest id reachable over links.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are
    ``width`` words (all of a shorter text); a fingerprint bit is set if it is set in
    over half of the XXH64 hashes of the shingles. Fingerprints at most ``radius`` bits
    apart are linked (:func:`hamming_links`); equal ones are one node, so copies in
    any number add no links. See :mod:`docpress.llm.components` for how components
    are found.

    NULL, empty and blank texts have fingerprint 0 and are linked like any other. NULL
    ids count as larger than all others; a component of such rows alone has a NULL
    id. Repeated rows are returned each. Other columns are not carried. An empty
    table gives no rows.
    """
    prints = stored(simhash(docs, id_col=id_col, text_col=text_col, width=width)
                    .withColumn("key", order_id("doc_id")), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("first")), "fingerprint-nodes")
    roots = components(hamming_links(nodes.select("fp"), radius, parts=parts))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    heads = stored(rooted.groupBy("root").agg(F.min("first").alias("component")), "heads")
    named = rooted.join(heads, "root").select("fp", "component")
    known = prints.join(named, "fp")
    return known.select("doc_id", "fp",
                        F.nullif(F.col("component"), F.lit(LAST_ID)).alias("component_id"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     width: int = 4, radius: int = 4) -> DataFrame:
    """Of each component of :func:`simhash_components` the row with the smallest id.

    All columns stay. Rows are judged, not ids: rows of one id with different texts each
    stand for themselves, and so do rows with a NULL id, which count as larger than all
    others; of rows alike in id and component one stays, also of rows that repeat
    entirely. NULL, empty and blank texts are copies of each other. An empty table gives
    no rows.
    """
    mark = row_mark(docs)
    marked = simhash_components(by_row(docs, id_col), id_col=id_col, text_col=text_col,
                                width=width, radius=radius)
    marked = marked.select(F.col("doc_id").alias("mark"), F.col("component_id").alias("group"))
    ids = stored(docs.select(mark.alias("mark"), order_id(id_col).alias("key"))
                 .groupBy("mark", "key").count(), "row-ids")
    rows = stored(ids.join(marked.distinct(), "mark"), "row-groups")
    heads = stored(rows.groupBy("group").agg(F.min(F.struct("key", "mark")).alias("head")),
                   "row-heads")
    gone = rows.join(heads, "group").where("mark <> head.mark").select(F.col("mark").alias("key"))
    kept = without(docs, gone, mark)
    # Rows that repeat entirely have one mark.
    again = stored(rows.where("count > 1").join(heads.select("head.mark"), "mark")
                   .select(F.col("mark").alias("key")), "rows-again")
    if not again.count():
        return kept
    repeated = kept.join(again, row_mark(kept) == again["key"], "left_semi").dropDuplicates()
    return without(kept, again, row_mark(kept)).unionByName(repeated)
