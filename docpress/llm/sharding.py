"""Shards of near-equal bytes: minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpress.llm.common import narrow, order_id, partitions, stored

ROW_OVERHEAD = 16
# Cells into which one round of the search cuts the prefix sums it asks about. Each
# shard adds a cell's width to the doubt about where the next one ends, so the doubt
# of a round shrinks only if there are many more cells than squared shards.
SEARCH_CELLS = 16_384
CELLS_PER_SQUARED_SHARD = 10


class PrefixSums:
    """What the driver knows of the prefix sums of all groups, in ascending order.

    Spark holds every sum; the driver holds, for cells of the number line, the least
    and the greatest sum inside. A question that a cell leaves open is settled by
    asking Spark for finer cells there, so the driver never holds more than
    ``cells`` cells a round, at any number of groups.
    """

    def __init__(self, sums: DataFrame, total: int, cells: int):
        self.sums, self.total, self.cells = sums, total, cells
        self.known: list[int] = []
        # Between known sum i and known sum i + 1 there may be more: open[i].
        self.open: list[bool] = []
        self.refine([(0, total)])

    def refine(self, ranges: list[tuple[int, int]]) -> None:
        """Ask Spark for the sums inside the ranges, in cells of equal width.

        Ranges are widened to the known sums around them, so that nothing between two
        known sums is half known.
        """
        if self.known:
            ranges = [(self.known[max(0, bisect_right(self.known, low) - 1)],
                       self.known[min(len(self.known) - 1, bisect_left(self.known, high))])
                      for low, high in ranges]
        merged: list[list[int]] = []
        for low, high in sorted(ranges):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(high, merged[-1][1])
            else:
                merged.append([low, high])
        each = max(2, self.cells // len(merged))
        cell: Column | None = None
        for n, (low, high) in enumerate(merged):
            width = max(1, -(-(high - low) // each))
            here = F.struct(F.lit(n).alias("r"), F.expr(f"(s - {low}) div {width}").alias("c"))
            inside = (F.col("s") >= low) & (F.col("s") <= high)
            cell = F.when(inside, here) if cell is None else cell.when(inside, here)
        rows = (self.sums.select("s", cell.alias("cell")).where("cell is not null")
                .groupBy("cell").agg(F.min("s").alias("lo"), F.max("s").alias("hi"),
                                     F.count("*").alias("n")).collect())
        inside = {}
        for row in rows:
            inside[row["lo"]] = row["n"] > 2
            inside.setdefault(row["hi"], False)
        outside = {}
        tops = {high for _, high in merged}
        for value, is_open in zip(self.known, self.open):
            # What follows the last sum of a range is as open as it was.
            if value in tops or not any(low <= value <= high for low, high in merged):
                outside[value] = is_open
                inside.pop(value, None)
        points = sorted({**outside, **inside}.items())
        self.known = [v for v, _ in points]
        self.open = [o for _, o in points]

    def reach(self, limit: int) -> tuple[int, int]:
        """Bounds of the greatest prefix sum that is at most ``limit``."""
        if limit >= self.total:
            return self.total, self.total
        n = bisect_right(self.known, limit) - 1
        if n < 0:
            return 0, 0
        low = self.known[n]
        return low, min(limit, self.known[n + 1] - 1) if self.open[n] else low

    def least(self, limit: int) -> tuple[int, int]:
        """Bounds of the smallest prefix sum that is at least ``limit``."""
        if limit <= 0:
            return 0, 0
        n = bisect_left(self.known, limit)
        high = self.known[n]
        return (max(limit, self.known[n - 1] + 1) if n and self.open[n - 1] else high), high

    def level(self, capacity: int, shards: int) -> tuple[list[tuple[int, int]], list]:
        """Bounds of where levelled shards end, and the open ranges met.

        A shard ends at the first sum that reaches the mean of what is left for it and
        those after it, but neither beyond ``capacity`` nor so early that the others
        could not hold the rest.
        """
        # What has to lie before the last 0, 1, 2 ... shards.
        before = [(self.total, self.total)]
        for _ in range(shards - 1):
            low, high = before[-1]
            before.append((self.least(low - capacity)[0], self.least(high - capacity)[1]))

        def end(at: int, left: int, bound: int) -> int:
            mean = at - (at - self.total) // left
            most = min(self.least(mean)[bound], self.reach(at + capacity)[bound])
            return max(most, before[left - 1][bound])

        low, high, ends = 0, 0, []
        for left in range(shards, 0, -1):
            low, high = end(low, left, 0), end(high, left, 1)
            ends.append((low, high))
        return ends, [(low, high) for low, high in before + ends if low < high]

    def fill(self, capacity: int, shards: int) -> tuple[int, int, list[tuple[int, int]]]:
        """Greedy filling: bounds of what the shards hold, and the open ranges met."""
        low = high = 0
        unsure = []
        for _ in range(shards):
            low, high = self.reach(low + capacity)[0], self.reach(high + capacity)[1]
            if low < high:
                unsure.append((low, high))
        return low, high, unsure


def _search(sums: PrefixSums, shards: int, least: int) -> tuple[int, list[int]]:
    """The smallest capacity that ``shards`` shards can hold, and where they end."""
    low, high = max(least, -(-sums.total // shards)), sums.total
    while True:
        # Infeasible for certain below low, feasible for certain from high on.
        a, b = low, high
        while a < b:
            middle = (a + b) // 2
            if sums.fill(middle, shards)[0] >= sums.total:
                b = middle
            else:
                a = middle + 1
        high = b
        a, b = low, high
        while a < b:
            middle = (a + b) // 2
            if sums.fill(middle, shards)[1] < sums.total:
                a = middle + 1
            else:
                b = middle
        low = a
        capacity = high
        unsure = sums.fill(capacity, shards)[2]
        if low == high and not unsure:
            break
        ranges = unsure + sums.fill(low, shards)[2]
        # Every capacity between the two bounds ends its shards between theirs.
        first = second = 0
        for _ in range(shards):
            first, second = sums.reach(first + low)[0], sums.reach(second + high)[1]
            ranges.append((first, second))
        sums.refine(ranges)
    while True:
        ends, unsure = sums.level(capacity, shards)
        if not unsure:
            return capacity, [low for low, _ in ends]
        sums.refine(unsure)


def _numbered(rows: DataFrame, keys: list[str], size: Column, label: str,
              within: list[str]) -> DataFrame:
    """Running sum ``s`` of ``size`` over rows in key order, for each value of ``within``.

    Rows are dealt into ranges of the keys and written with their range; a running
    sum inside each range and the totals of the ranges before it make the whole.
    """
    spark = rows.sparkSession
    ranged = stored(rows.repartitionByRange(partitions(spark), *keys)
                    .withColumn("range", F.spark_partition_id()), label)
    totals = ranged.groupBy("range", *within).agg(F.sum(size).alias("total"))
    # As many rows as there are ranges and values of ``within``.
    before = Window.partitionBy(*within).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select("range", *within, F.coalesce(F.sum("total").over(before), F.lit(0))
                            .alias("before"))
    inside = Window.partitionBy("range", *within).orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, 0)
    return (ranged.withColumn("s", F.sum(size).over(inside))
            .join(offsets, ["range", *within])
            .withColumn("s", F.col("s") + F.col("before")).drop("range", "before"))


def shard_documents(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Documents with ``shard`` and ``slot``: shards of near-equal bytes.

    A document weighs its UTF-8 bytes plus 16. Documents of equal text form an atomic
    group that no cut divides. Groups stand in the order of their smallest id; the
    search finds the smallest capacity with which filling shard after shard needs no
    more than ``shards`` of them. No other contiguous partition has a smaller largest
    shard. Below that capacity the cuts are levelled: a shard ends where it reaches the
    mean of what is left, so one large group does not leave later shards empty; only
    with fewer groups than shards are there some. ``slot`` numbers the documents of a shard from 0 in the
    order of their ids; a shard that nothing is left for has none.

    DataFrame operations alone. Sizes are added up by text before any shuffle, a join
    to a hot text is left to Spark's skew splitting, and every numbering runs over
    ranges, not over whole shards; the driver sees cells of prefix sums only.

    NULL text: no bytes, grouped with the empty text. NULL ids come last. Repeated
    rows are documents of their own, numbered next to each other. Other columns are
    not carried. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError(f"shards must be positive, got {shards}")
    text = F.coalesce("text", F.lit(""))
    # Written once, so that row numbers and ranges cannot change between the steps.
    base = stored(narrow(docs, id_col, text_col).select(
        "doc_id", order_id("doc_id").alias("key"), F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("content")), "shard-rows")
    groups = base.groupBy("content").agg(
        F.min("key").alias("first"), F.sum("size").alias("bytes"))
    sums = stored(_numbered(groups, ["first", "content"], F.col("bytes"), "shard-groups", []),
                  "shard-sums")
    whole = sums.agg(F.max("s").alias("total"), F.max("bytes").alias("most")).first()
    ends = [0]
    if whole["total"] is not None:
        search = PrefixSums(sums.select("s"), whole["total"],
                              max(SEARCH_CELLS, CELLS_PER_SQUARED_SHARD * shards * shards))
        ends = _search(search, shards, whole["most"])[1]
    # At most as many cuts as shards.
    shard = F.lit(0)
    for end in ends[:-1]:
        shard = shard + (F.col("s") > end).cast("int")
    placed = base.join(sums.select("content", shard.alias("shard")), "content")
    slots = _numbered(placed.drop("content"), ["key", "text_crc32", "row"], F.lit(1),
                      "shard-slots", ["shard"])
    return slots.select("doc_id", "size", "text_crc32", "shard",
                        (F.col("s") - 1).alias("slot"))
