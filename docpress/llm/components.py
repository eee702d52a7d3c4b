"""Connected components of a link table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpress.llm.common import stored


def _pointed_down(links: DataFrame) -> DataFrame:
    """Links once each, from the greater node ``a`` to the lesser ``b``."""
    return links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is linked to over any number of links.

    ``links`` has two long columns ``a`` and ``b``, in either order, repeated or not.
    Nodes without links are not in the result.

    Large-star and small-star in turn: every node hands the nodes around it to the
    least of them, until all links point at roots. The number of rounds grows with
    the logarithm of the nodes; each takes grouped minima (combined before their
    shuffle) and an ordinary join. The minima are written before they are joined, to
    the shared scratch folder: a join of two plain shuffles is one that Spark splits
    where a hub is skewed.
    """
    links = stored(_pointed_down(links.select("a", "b")), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = _pointed_down(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = stored(large, "large-star")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(_pointed_down(small.union(least.select("a", "m"))), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    # Every node but the roots now has one link, to its root.
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(pairs.select("root", "root").distinct())
