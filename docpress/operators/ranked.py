"""Ordered reads by a document metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(documents: DataFrame, metric: str, k: int, *, ascending: bool = False,
          id_col: str = "_id") -> DataFrame:
    """The ``k`` documents with the largest (or smallest) metric.

    Each task keeps its own ``k``; only those meet. The id breaks ties.
    Documents without the metric come last.
    """
    value = F.col(metric)
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return documents.orderBy(order, F.col(id_col)).limit(k)


def top_k_by_bounds(documents: DataFrame, bounds: DataFrame, metric: str, k: int, *,
                    ascending: bool = False, id_col: str = "_id") -> DataFrame:
    """:func:`top_k` that reads only files which can hold one of the ``k``.

    ``bounds`` are those of :func:`docpress.operators.layout.store_bounds`. The files with the
    greatest minima hold ``k`` values together, so the k-th value is no less than the
    last of these minima; that limit reaches the Parquet scan, which leaves out files whose
    maximum is below. Each file counted holds a value, so ``k`` files are enough to look at.
    Files without bounds are read as well. With fewer than ``k`` values everything is read.
    """
    edge = F.col("high") if ascending else F.col("low")
    falling = edge.asc() if ascending else edge.desc()
    first = bounds.select(f"{metric}.*").where("n > 0").orderBy(falling).limit(k)
    held = first.withColumn("held", F.sum("n").over(Window.orderBy(falling)))
    best = F.min(edge) if ascending else F.max(edge)
    limit = held.where(F.col("held") >= k).agg(best).first()[0]
    if limit is not None:
        value = F.col(metric)
        documents = documents.where(value <= F.lit(limit) if ascending else value >= F.lit(limit))
    return top_k(documents, metric, k, ascending=ascending, id_col=id_col)


def metric_range(documents: DataFrame, metric: str, low: object, high: object) -> DataFrame:
    """Documents with ``low <= metric < high``; the bounds reach the Parquet scan."""
    return documents.where((F.col(metric) >= F.lit(low)) & (F.col(metric) < F.lit(high)))
