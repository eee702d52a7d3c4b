"""Event-time series, on the table and on the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docpress.catalog.registry import (
    EVENT_SLICES_SQL, SIZED_EVENTS_SQL, SLICES, mean_digits, mean_digits_sql, query, replay_events, seconds,
    sized_events, table)
from docpress.operators import windows as W
from docpress.operators.counters import counter_rate
from docpress.scratch import scratch_path
from docpress.streaming.late import read_timely, start_timely, window_account
from docpress.streaming.rates import read_rates, start_rates, start_totals

DAY = 24 * 3600
# The events span 30 days.
LATE_DAYS = -(-30 // SLICES) + 1

_SLIDING_SQL = f"""
    select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n_docs,
           sum(original_size)::bigint as n_bytes, sum(original_size)::double / 300.0 as bytes_per_sec,
           {mean_digits_sql("avg(compression_ratio)")} as avg_ratio
    from (select original_size, compression_ratio,
                 unnest(range(time_bucket(interval '30 seconds', ts) - interval '270 seconds',
                              time_bucket(interval '30 seconds', ts) + interval '30 seconds',
                              interval '30 seconds')) as w
          from ({SIZED_EVENTS_SQL}))
    group by w
"""


def _tumbling_sql(interval: str, width: int) -> str:
    return f"""
        select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n_docs,
               sum(original_size)::bigint as n_bytes,
               sum(original_size)::double / {float(width)} as bytes_per_sec,
               {mean_digits_sql("avg(compression_ratio)")} as avg_ratio
        from (select time_bucket(interval '{interval}', ts) as w, * from ({SIZED_EVENTS_SQL}))
        group by w
    """


def _shown(rates: DataFrame) -> DataFrame:
    return rates.select(
        seconds("window_start").alias("window_start"), "n_docs", "n_bytes", "bytes_per_sec",
        mean_digits("avg_ratio").alias("avg_ratio"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_events(table(spark, sf_dir, "events"))


@query("processing_rate_sliding", _SLIDING_SQL)
def processing_rate_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(W.processing_rate(_events(spark, sf_dir)))


@query("processing_rate_tumbling", _tumbling_sql("5 minutes", 300))
def processing_rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(W.processing_rate(_events(spark, sf_dir), step=W.RATE_WINDOW_SECONDS))


@query("ratio_by_window", f"""
    select window_start, avg_ratio, n_docs from ({_tumbling_sql("5 minutes", 300)})
""")
def ratio_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ratio_by_window(_events(spark, sf_dir)).select(
        seconds("window_start").alias("window_start"),
        mean_digits("avg_ratio").alias("avg_ratio"), "n_docs")


_TOTAL_SQL = """
    select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, n_docs,
           (sum(n_docs) over (order by w))::bigint as total_docs
    from (select time_bucket(interval '5 minutes', ts) as w, count(*) as n_docs
          from events group by 1)
"""


@query("documents_total", _TOTAL_SQL)
def documents_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.documents_total(_events(spark, sf_dir)).withColumn(
        "window_start", seconds("window_start"))


@query("documents_total_untimed", """
    select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, n_docs,
           (sum(n_docs) over (order by w nulls first))::bigint as total_docs
    from (select time_bucket(interval '5 minutes', ts) as w, count(*) as n_docs
          from (select case when event_type <> 'error' then ts end as ts from events) group by 1)
""")
def documents_total_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events have lost their time; the series ends with all documents all the same."""
    events = table(spark, sf_dir, "events").withColumn(
        "ts", F.when(F.col("event_type") != "error", F.col("ts")))
    return W.documents_total(sized_events(events)).withColumn(
        "window_start", seconds("window_start"))


# Events are dealt to a few counters, one of which has a third of them and more; a value
# below the one before it means that the counter began anew.
_SERIES = 5


@query("counter_rate", f"""
    with samples as (
        select case when user_id % 2 = 0 then 0 else user_id % {_SERIES} end as series, ts, event_id,
               cast(floor(value * 100) as bigint) as total from events),
    steps as (
        select *, lag(total) over (partition by series order by ts nulls first, event_id) as before
        from samples),
    grown as (
        select series, time_bucket(interval '5 minutes', ts) as w,
               case when before is null then 0 when total >= before then total - before
                    else total end as increase,
               case when total < before then 1 else 0 end as reset
        from steps)
    select series, strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n_samples,
           sum(increase)::bigint as increase, sum(reset)::bigint as resets,
           sum(increase)::double / 300.0 as per_sec
    from grown group by series, w
""")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("user_id") % _SERIES).alias("series"),
        "ts", "event_id", F.floor(F.col("value") * 100).alias("total"))
    rates = counter_rate(samples, series="series", value="total", ts="ts", order_by=["event_id"])
    return rates.withColumn("window_start", seconds("window_start"))


def _stream_rates(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    path, checkpoint = scratch_path(spark, "rates"), scratch_path(spark, "rates-checkpoint")
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                     2 * spark.sparkContext.defaultParallelism)

    def start(events: DataFrame) -> StreamingQuery:
        return start_rates(sized_events(events), path, checkpoint, available_now=True,
                           state_partitions=partitions, **options)

    replay_events(spark, sf_dir, start)
    return _shown(read_rates(spark, path) if options.get("complete") else spark.read.parquet(path))


@query("stream_rate_complete", _SLIDING_SQL)
def stream_rate_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_rates(spark, sf_dir, complete=True)


@query("stream_rate_append", f"""
    select * from ({_tumbling_sql("1 day", DAY)})
    where window_start::timestamp + interval '1 day'
          <= (select max(ts) - interval '{LATE_DAYS} days' from events)
""")
def stream_rate_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the bound on late data has closed.

    Files of a slice come in any order, so the bound is longer than a slice.
    """
    return _stream_rates(spark, sf_dir, width=DAY, step=DAY, late_seconds=LATE_DAYS * DAY)


@query("stream_documents_total", _TOTAL_SQL)
def stream_documents_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running total after the last of four slices, each of them a restart."""
    path, checkpoint = scratch_path(spark, "totals"), scratch_path(spark, "totals-checkpoint")
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                     2 * spark.sparkContext.defaultParallelism)

    def start(events: DataFrame) -> StreamingQuery:
        return start_totals(sized_events(events), path, checkpoint, available_now=True,
                            state_partitions=partitions)

    replay_events(spark, sf_dir, start)
    return read_rates(spark, path).withColumn("window_start", seconds("window_start"))


# One event in seven arrives a slice after its time; a window of an hour waits for a day.
_POSTPONED, _HOUR = 7, 3600

_ARRIVED_SQL = f"""
    with arrived as (
        select event_id, ts, least(slice + (event_id % {_POSTPONED} = 0)::int, {SLICES - 1}) as batch
        from ({EVENT_SLICES_SQL})),
    marks as (
        select batch, max(max(ts)) over (order by batch rows between unbounded preceding
                                         and 1 preceding) as high
        from arrived group by batch),
    judged as (
        select event_id, ts, batch, time_bucket(interval '1 hour', ts) as w,
               coalesce(time_bucket(interval '1 hour', ts) + interval '1 hour'
                        <= high - interval '1 day', false) as late
        from arrived join marks using (batch))
"""


def _late_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    path, marks, checkpoint = (scratch_path(spark, f"timely-{x}") for x in ("rows", "marks", "at"))

    def start(events: DataFrame) -> StreamingQuery:
        documents = events.select("event_id", F.col("ts").alias("timestamp"))
        return start_timely(documents, path, marks, checkpoint, late_seconds=DAY, width=_HOUR,
                            available_now=True)

    replay_events(spark, sf_dir, start, max_files_per_trigger=None, arrival=lambda number: F.least(
        number + (F.col("event_id") % _POSTPONED == 0).cast("int"), F.lit(SLICES - 1)))
    return read_timely(spark, path), marks


@query("stream_late_rows", _ARRIVED_SQL + """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, batch::bigint as batch_id
    from judged where late
""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that came too late for their window, and with which batch."""
    rows, _ = _late_stream(spark, sf_dir)
    return rows.where("late").select("event_id", seconds("timestamp").alias("ts"),
                                     F.col("batch_id").cast("bigint").alias("batch_id"))


@query("stream_window_account", _ARRIVED_SQL + """
    select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, count(*) filter (not late) as n_docs,
           count(*) filter (late) as n_late,
           coalesce(w + interval '1 hour' <= (select max(ts) from events) - interval '1 day', false)
               as closed
    from judged group by w
""")
def stream_window_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on time and late of each window; together they are all events."""
    rows, marks = _late_stream(spark, sf_dir)
    return window_account(rows, marks, late_seconds=DAY, width=_HOUR).withColumn(
        "window_start", seconds("window_start"))
