"""Rates over a running stream, with a bound on late data."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docpress.operators.windows import (
    RATE_STEP_SECONDS, RATE_WINDOW_SECONDS, rate_columns, running_total, slide, time_buckets)
from docpress.streaming.ingest import TRIGGER_SECONDS, triggered

VERSION = "version"
_SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def rate_stream(documents: DataFrame, *, late_seconds: int, width: int = RATE_WINDOW_SECONDS,
                step: int = RATE_STEP_SECONDS, ts: str = "timestamp", **columns: str) -> DataFrame:
    """Rates of closed windows, for append mode.

    A window closes once the newest event is ``late_seconds`` past its end; rows
    that arrive later are dropped. Two chained aggregations keep state for
    buckets and open windows only.
    """
    bounded = (documents.withColumn(ts, F.col(ts).cast("timestamp"))
               .withWatermark(ts, f"{late_seconds} seconds"))
    buckets = time_buckets(bounded, seconds=step, ts=ts, **columns)
    windows = (buckets.withColumnRenamed("bucket", "window") if width == step
               else slide(buckets, width=width, step=step))
    return rate_columns(windows, width)


def start_rates(documents: DataFrame, path: str, checkpoint: str, *, complete: bool = False,
                late_seconds: int = 600, width: int = RATE_WINDOW_SECONDS,
                step: int = RATE_STEP_SECONDS, ts: str = "timestamp",
                trigger_seconds: int = TRIGGER_SECONDS, available_now: bool = False,
                state_partitions: int | None = None, **columns: str) -> StreamingQuery:
    """Store rates as they are computed.

    Append mode adds each window once, when it closes. Complete mode writes all
    windows after every micro-batch, as a version of their own (:func:`read_rates`),
    and drops no late row: readers always find a whole series, and a crash leaves the
    one before. Its state is one narrow row per time bucket, and the overlapping
    windows are derived from those rows by the same operator that serves tables.

    Start such queries one at a time: ``state_partitions`` is set for the session while
    a query starts. It is fixed for the life of a checkpoint; by default it is
    the session's ``spark.sql.shuffle.partitions``. The state is narrow, so few do.
    """
    if not complete:
        rates = rate_stream(documents, late_seconds=late_seconds, width=width, step=step,
                            ts=ts, **columns)
        writer = rates.writeStream.format("parquet").outputMode("append").option("path", path)
    else:
        buckets = time_buckets(documents.withColumn(ts, F.col(ts).cast("timestamp")),
                               seconds=step, ts=ts, **columns)

        def rewrite(batch: DataFrame, batch_id: int) -> None:
            windows = (batch.withColumnRenamed("bucket", "window") if width == step
                       else slide(batch, width=width, step=step))
            (rate_columns(windows, width).write.mode("overwrite")
             .parquet(f"{path}/{VERSION}={batch_id:020d}"))
            drop_versions(batch.sparkSession, path, batch_id - 1)

        writer = buckets.writeStream.foreachBatch(rewrite).outputMode("complete")
    writer = triggered(writer.option("checkpointLocation", checkpoint), available_now,
                       trigger_seconds)
    with _shuffle_partitions(documents.sparkSession, state_partitions):
        return writer.start()


def start_totals(documents: DataFrame, path: str, checkpoint: str, *,
                 width: int = RATE_WINDOW_SECONDS, ts: str = "timestamp",
                 trigger_seconds: int = TRIGGER_SECONDS, available_now: bool = False,
                 state_partitions: int | None = None) -> StreamingQuery:
    """Store the running number of documents, whole after every micro-batch.

    The state is one count for each window that has documents; a late document raises
    the totals of all later windows, so each trigger adds them up anew, by day and then
    over the days (:func:`docpress.operators.windows.running_total`). Rows without a
    time have the first window. Readers use :func:`read_rates`.
    """
    stamped = documents.withColumn(ts, F.col(ts).cast("timestamp"))
    # A stream's windows leave rows without a time out; as a plain start they stay.
    micros = F.unix_micros(ts)
    start = F.timestamp_micros(micros - F.pmod(micros, F.lit(width * 1_000_000)))
    counts = stamped.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("n_docs"))

    def rewrite(batch: DataFrame, batch_id: int) -> None:
        buckets = batch.select(F.struct("start").alias("bucket"), "n_docs")
        (running_total(buckets).write.mode("overwrite")
         .parquet(f"{path}/{VERSION}={batch_id:020d}"))
        drop_versions(batch.sparkSession, path, batch_id - 1)

    writer = counts.writeStream.foreachBatch(rewrite).outputMode("complete")
    writer = triggered(writer.option("checkpointLocation", checkpoint), available_now,
                       trigger_seconds)
    with _shuffle_partitions(documents.sparkSession, state_partitions):
        return writer.start()


def drop_versions(spark: SparkSession, path: str, before: int) -> None:
    """Delete the versions older than ``before``; readers are at the newest or the one before."""
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(jvm.Path(path)):
        name = status.getPath().getName()
        if name.startswith(f"{VERSION}=") and int(name.removeprefix(f"{VERSION}=")) < before:
            files.delete(status.getPath(), True)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole series that complete mode wrote."""
    newest = latest_version(spark, path)
    return spark.read.parquet(f"{path}/{VERSION}={newest:020d}")


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version whose write was finished."""
    done = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(path))
    number = F.regexp_extract("path", rf"/{VERSION}=(\d+)/", 1).cast("bigint")
    return done.agg(F.max(number)).first()[0]


@contextmanager
def _shuffle_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Start a query with its own setting: it copies the session's when it starts."""
    if partitions is None:
        yield
        return
    before = spark.conf.get(_SHUFFLE_PARTITIONS)
    spark.conf.set(_SHUFFLE_PARTITIONS, partitions)
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_PARTITIONS, before)
