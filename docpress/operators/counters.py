"""The rate of a counter that only grows, until it begins anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpress.operators.windows import RATE_WINDOW_SECONDS


def _growth(before: Column, now: Column) -> Column:
    """What a counter gained: after a reset all that it shows, before a first sample nothing."""
    return F.when(before.isNull() | now.isNull(), F.lit(0)).when(now >= before, now - before).otherwise(now)


def counter_rate(samples: DataFrame, *, series: str, value: str, ts: str = "timestamp",
                 order_by: Sequence[str] = (), width: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Increase of each counter in each window of ``width`` seconds, resets included.

    Samples are ordered by time, then by ``order_by``. What a sample adds is its value
    less the one before it, or all of its value if it is lower: then the counter has
    begun anew. The step counts in the window of the later sample, also from one window
    to the next. Returns ``series``, ``window_start``, ``n_samples``, ``increase``, ``resets`` and
    ``per_sec``; windows without samples are not listed.

    A scan in two levels, so that no series meets in one task however long it is: inside
    each window, samples are compared with the one before; across windows only the
    last value of each is carried on, one narrow row for each window that has samples, and
    those of a series by spans of many windows in the same way.

    Samples without a time have a window of their own, the first, whose start is NULL.
    NULL values are counted as samples and otherwise passed over. NULL series are one series.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    start = micros - F.pmod(micros, F.lit(width * 1_000_000))
    rows = samples.select(
        F.col(series).alias("series"), start.alias("start"), F.col(value).alias("value"),
        F.struct(micros.alias("at"), *order_by).alias("place"))
    inside = Window.partitionBy("series", "start").orderBy("place")
    before = F.last("value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.withColumn("before", before)
    known = F.col("value").isNotNull()
    windows = steps.groupBy("series", "start").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(_growth(F.col("before"), F.col("value"))).alias("grown"),
        F.count_if(F.col("value") < F.col("before")).alias("fell"),
        F.min_by("value", F.when(known, F.col("place"))).alias("first"),
        F.max_by("value", F.when(known, F.col("place"))).alias("last"))
    carried = _carried(windows)
    first = F.col("first")
    increase = F.col("grown") + _growth(F.col("carried"), first)
    resets = F.col("fell") + F.when(first < F.col("carried"), 1).otherwise(0)
    return carried.select(
        "series", F.timestamp_micros("start").alias("window_start"), "n_samples",
        increase.alias("increase"), resets.alias("resets"),
        (increase / F.lit(float(width))).alias("per_sec"))


# Windows whose values are carried on inside one task: a week has 2,016 of 5 minutes.
SPAN_SECONDS = 7 * 24 * 3600


def _carried(windows: DataFrame) -> DataFrame:
    """``windows`` with the last value that their series had before them."""
    windows = windows.withColumn("span", F.floor(F.col("start") / F.lit(SPAN_SECONDS * 1_000_000)))
    so_far = F.last("last", ignorenulls=True)
    in_span = Window.partitionBy("series", "span").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = windows.groupBy("series", "span").agg(
        F.max_by("last", F.when(F.col("last").isNotNull(), F.struct("start"))).alias("last"))
    by_span = Window.partitionBy("series").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("series").alias("of"), F.col("span").alias("spanned"),
                         so_far.over(by_span).alias("earlier"))
    same = F.col("series").eqNullSafe(F.col("of")) & F.col("span").eqNullSafe(F.col("spanned"))
    return windows.withColumn("inside", so_far.over(in_span)).join(spans, same, "left").withColumn(
        "carried", F.coalesce("inside", "earlier"))
