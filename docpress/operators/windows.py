"""Rates, ratios and counts over event time.

Rows are first summed into narrow time buckets, with map-side combine, and only
bucket rows are copied into the overlapping windows they belong to. The same
definitions run on tables and on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpress.functions.sizes import size_ratio

RATE_WINDOW_SECONDS = 300
RATE_STEP_SECONDS = 30

_TOTALS = ("n_docs", "n_bytes", "ratio_sum", "ratio_count")


def _seconds(n: int) -> str:
    return f"{n} seconds"


def _bucket(rows: DataFrame, ts: str, seconds: int) -> Column:
    if rows.isStreaming:
        return F.window(ts, _seconds(seconds))
    # Spark's window() would drop the rows without a time.
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    start = micros - F.pmod(micros, F.lit(seconds * 1_000_000))
    return F.struct(F.timestamp_micros(start).alias("start"),
                    F.timestamp_micros(start + seconds * 1_000_000).alias("end"))


def time_buckets(documents: DataFrame, *, seconds: int = RATE_STEP_SECONDS, ts: str = "timestamp",
                 original: str = "original_size", ratio: str = "compression_ratio") -> DataFrame:
    """Additive totals of each ``seconds``-wide bucket (column ``bucket``).

    A mean cannot be added up over buckets, so it travels as sum and count. Documents
    of a table without a time have a bucket of their own, whose times are NULL; a
    stream with a watermark cannot place them and leaves them out.
    """
    return documents.groupBy(_bucket(documents, ts, seconds).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(original).alias("n_bytes"),
        F.sum(ratio).alias("ratio_sum"),
        F.count(ratio).alias("ratio_count"),
    )


def slide(buckets: DataFrame, *, width: int = RATE_WINDOW_SECONDS,
          step: int = RATE_STEP_SECONDS) -> DataFrame:
    """Totals of windows ``width`` seconds wide that start every ``step`` seconds."""
    if width % step:
        raise ValueError(f"window of {width} s is not a whole number of {step} s buckets")
    if buckets.isStreaming:
        window = F.window(F.col("bucket"), _seconds(width), _seconds(step)).alias("window")
        return buckets.groupBy(window).agg(*[F.sum(c).alias(c) for c in _TOTALS])
    interval = F.make_interval(secs=F.lit(step))
    first = F.col("bucket.start") - F.make_interval(secs=F.lit(width - step))
    starts = F.sequence(first, F.col("bucket.start"), interval)
    copies = buckets.select(F.explode_outer(starts).alias("start"), *_TOTALS)
    window = F.struct("start", (F.col("start") + F.make_interval(secs=F.lit(width))).alias("end"))
    return copies.groupBy(window.alias("window")).agg(*[F.sum(c).alias(c) for c in _TOTALS])


def rate_columns(windows: DataFrame, width: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Bytes per second and mean ratio of each window."""
    return windows.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "n_docs", "n_bytes",
        (F.col("n_bytes") / F.lit(float(width))).alias("bytes_per_sec"),
        size_ratio("ratio_sum", "ratio_count").alias("avg_ratio"),
    )


def processing_rate(documents: DataFrame, *, width: int = RATE_WINDOW_SECONDS,
                    step: int = RATE_STEP_SECONDS, **columns: str) -> DataFrame:
    """Bytes per second over the last ``width`` seconds, evaluated every ``step``.

    ``step == width`` gives adjoining windows.
    """
    buckets = time_buckets(documents, seconds=step, **columns)
    windows = (buckets.withColumnRenamed("bucket", "window") if width == step
               else slide(buckets, width=width, step=step))
    return rate_columns(windows, width)


def ratio_by_window(documents: DataFrame, *, width: int = RATE_WINDOW_SECONDS,
                    **columns: str) -> DataFrame:
    """Mean compression ratio and document count per adjoining window."""
    return processing_rate(documents, width=width, step=width, **columns).select(
        "window_start", "avg_ratio", "n_docs")


def documents_total(documents: DataFrame, *, width: int = RATE_WINDOW_SECONDS,
                    ts: str = "timestamp") -> DataFrame:
    """Running number of documents at each window that has any.

    Windows add up inside their day, days add up among themselves: the
    un-partitioned window sees one row per calendar day, however many documents
    there are. Documents without a time come first, with a NULL window, so that
    the series ends with all documents.
    """
    counts = documents.groupBy(_bucket(documents, ts, width).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_docs"))
    return running_total(counts)


def running_total(buckets: DataFrame) -> DataFrame:
    """The series of :func:`documents_total` from buckets (``bucket``, ``n_docs``)."""
    counts = (buckets.select(F.col("bucket.start").alias("window_start"), "n_docs")
              .withColumn("_day", F.to_date("window_start")))
    earlier_days = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (counts.groupBy("_day").agg(F.sum("n_docs").alias("_n"))
            .select("_day", F.coalesce(F.sum("_n").over(earlier_days), F.lit(0)).alias("_before")))
    within_day = Window.partitionBy("_day").orderBy("window_start")
    # A left join leaves both sides with the same plan below, so the counts are
    # computed once and their shuffle is reused.
    days = days.withColumnRenamed("_day", "_known_day")
    return counts.join(days, F.col("_day").eqNullSafe(F.col("_known_day")), "left").select(
        "window_start", "n_docs",
        (F.col("_before") + F.sum("n_docs").over(within_day)).alias("total_docs"))
