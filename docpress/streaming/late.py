"""A stream that keeps what comes too late for its windows, and says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docpress.operators.sinks import replace_partitions
from docpress.sources.collection import read_collection
from docpress.streaming.ingest import TRIGGER_SECONDS, triggered
from docpress.streaming.rates import VERSION, drop_versions

BATCH, QUERY, LATE = "batch_id", "query_id", "late"

_MARKS = T.StructType([T.StructField("high", T.LongType()), T.StructField(QUERY, T.StringType()),
                       T.StructField(VERSION, T.LongType())])
_SECOND = 1_000_000


def window_start(ts: Column | str, width: int) -> Column:
    """Start of the window of ``width`` seconds that holds ``ts``; NULL without a time."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width * _SECOND)))


def has_closed(start: Column, high: int | None, late_seconds: int, width: int) -> Column:
    """Whether a window ended ``late_seconds`` or more before the newest event, ``high``."""
    if high is None:
        return F.lit(False)
    end = F.unix_micros(start) + width * _SECOND
    return F.coalesce(end <= high - late_seconds * _SECOND, F.lit(False))


def start_timely(documents: DataFrame, path: str, marks: str, checkpoint: str, *,
                 late_seconds: int, width: int, ts: str = "timestamp",
                 trigger_seconds: int = TRIGGER_SECONDS, available_now: bool = False
                 ) -> StreamingQuery:
    """Store every row, rows that are too late for their window apart, in folders ``late=true``.

    A window closes once the newest event of the batches before is ``late_seconds`` past its
    end; rows of closed windows are late. On time and late rows together are all rows. A row
    without a time is on time. The state is the newest event time, one number
    for each batch below ``marks``; batches that run again find the number they had, so
    they decide alike and replace what they stored. One write a batch, no shuffle.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = F.col(QUERY) == query_id
        before = _marks(spark, marks).where(own & (F.col(VERSION) < batch_id)).agg(
            F.max("high")).first()[0]
        seen = Observation()
        rows = batch.withColumn(
            LATE, has_closed(window_start(ts, width), before, late_seconds, width)).observe(
                seen, F.max(F.unix_micros(ts)).alias("high"))
        replace_partitions(rows.withColumns({QUERY: F.lit(query_id), BATCH: F.lit(batch_id)}),
                           path, [QUERY, BATCH, LATE])
        known = [m for m in (before, seen.get["high"]) if m is not None]
        folder = f"{marks}/{QUERY}={query_id}"
        (spark.createDataFrame([(max(known, default=None),)], "high long").coalesce(1)
         .write.mode("overwrite").parquet(f"{folder}/{VERSION}={batch_id:020d}"))
        drop_versions(spark, folder, batch_id - 1)

    stamped = documents.withColumn(ts, F.col(ts).cast("timestamp"))
    writer = (stamped.writeStream.foreachBatch(store).outputMode("append")
              .option("checkpointLocation", checkpoint))
    return triggered(writer, available_now, trigger_seconds).start()


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return read_collection(spark, path, schema=_MARKS)


def read_timely(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`start_timely` stored; a filter on ``late`` leaves out the other folders."""
    return read_collection(spark, path).withColumn(LATE, F.col(LATE).cast("boolean"))


def window_account(rows: DataFrame, marks: str, *, late_seconds: int, width: int,
                   ts: str = "timestamp") -> DataFrame:
    """Each window of the rows of :func:`read_timely`: ``n_docs`` on time, ``n_late``
    after it had closed, and whether it has ``closed`` by now."""
    high = _marks(rows.sparkSession, marks).agg(F.max("high")).first()[0]
    counts = rows.groupBy(window_start(ts, width).alias("window_start")).agg(
        F.count_if(~F.col(LATE)).alias("n_docs"), F.count_if(F.col(LATE)).alias("n_late"))
    return counts.withColumn(
        "closed", has_closed(F.col("window_start"), high, late_seconds, width))
