"""Registration of named queries, and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docpress.functions.parsing import FRAME_ID
from docpress.functions.payload import TIMESTAMP_FORMAT, row_json
from docpress.functions.sizes import original_size, size_ratio
from docpress.operators.layout import partitions_for_bytes, planned_bytes
from docpress.scratch import scratch_path
from docpress.sources.messages import file_frames

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Files in which a slice of the event stream lands, at least.
FILES_PER_SLICE = 3

# Processing time of every checked run.
AS_OF = "2024-02-01 00:00:00"
AS_OF_TEXT = "2024-02-01 00:00:00.000000"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows can be checked."""
    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function
    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def micros(ts: Column | str) -> Column:
    """A timestamp as text, so that it compares equal in every engine."""
    return F.date_format(ts, TIMESTAMP_FORMAT)


def seconds(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# Engines add up doubles in different orders, so the last bits of their means differ;
# they are compared to so many digits.
MEAN_DIGITS = 9


def mean_digits(value: Column | str) -> Column:
    return F.round(value, MEAN_DIGITS)


def mean_digits_sql(value: str) -> str:
    return f"round({value}, {MEAN_DIGITS})"


# Message frames made from the events table: one sensor reading per event. The
# event id is outside the parsed schema, so it survives in the raw text only.
def sensor_frames(events: DataFrame) -> DataFrame:
    own_id = [FRAME_ID] if FRAME_ID in events.columns else []
    reading = events.select(
        "ts",
        micros("ts").alias("timestamp"),
        F.concat(F.lit("sensor_"), F.col("user_id")).alias("sensor_id"),
        F.col("value").alias("temperature"),
        F.struct(
            F.col("event_type").alias("type"),
            F.get_json_object("props", "$.k").cast("int").alias("quality"),
        ).alias("metadata"),
        "event_id", *own_id,
    )
    return reading.select(
        F.col("sensor_id").cast("binary").alias("key"),
        row_json([c for c in reading.columns if c not in ("ts", FRAME_ID)]).cast("binary")
        .alias("value"),
        F.col("ts").alias("timestamp"),
        *own_id,
    )


FRAMES_SQL = """
    select concat('sensor_', user_id) as key, ts, event_id, user_id, event_type, value,
           cast(props->>'k' as int) as quality,
           to_json(struct_pack(
               "timestamp" := strftime(ts, '%Y-%m-%d %H:%M:%S.%f'),
               sensor_id := concat('sensor_', user_id),
               temperature := value,
               metadata := struct_pack(type := event_type, quality := cast(props->>'k' as int)),
               event_id := event_id))::varchar as raw_value
    from events
"""


# The events arrive in this many slices of event time.
SLICES = 4
_SLICE = "(us - lo) * {n} {div} (hi - lo + 1)"
EVENT_SLICES_SQL = f"""
    select e.*, coalesce({_SLICE.format(n=SLICES, div="//")}, 0) as slice
    from (select *, epoch_us(ts) as us from events) e,
         (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events)
"""


def replay_events(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame], StreamingQuery],
                  *, max_files_per_trigger: int | None = 1000,
                  arrival: Callable[[Column], Column] = lambda number: number) -> None:
    """Stream the events: each slice of event time lands as files and is drained.

    However many files and micro-batches a slice makes, in whatever order, the events
    of a later slice come later. ``start`` starts a query over the stream of all files,
    each time with the same checkpoint. ``arrival`` says in which slice an event
    arrives, from that of its time.
    """
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    # Events without a time come with the first slice.
    number = arrival(F.coalesce(F.expr(_SLICE.format(n=SLICES, div="div")), F.lit(0)))
    sliced = events.withColumns({"us": us, "lo": F.lit(bounds["lo"]), "hi": F.lit(bounds["hi"])}
                                ).withColumn("slice", number).drop("us", "lo", "hi")
    path = scratch_path(spark, "event-slices")
    files = max(FILES_PER_SLICE, partitions_for_bytes(planned_bytes(events) // SLICES))
    for n in range(SLICES):
        (sliced.where(F.col("slice") == n).drop("slice").repartition(files)
         .write.mode("append").parquet(path))
        frames = file_frames(spark, path, schema=events.schema,
                             max_files_per_trigger=max_files_per_trigger)
        start(frames).awaitTermination()


# Documents with stand-in sizes, which SQL can compute: the byte length of a text
# as its original size and its character length as its compressed size.
def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("_id"),
        original_size("text").alias("original_size"),
        original_size("text", "chars").alias("compressed_size"),
    )
    return sized.withColumn(
        "compression_ratio", size_ratio("original_size", "compressed_size"))


SIZED_DOCUMENTS_SQL = """
    select doc_id::varchar as _id, strlen(text)::bigint as original_size,
           length(text)::bigint as compressed_size,
           strlen(text)::double / nullif(length(text), 0) as compression_ratio
    from documents
"""


# Events as sized documents with an event time; the stand-in compressed size is
# the byte length of ``props``.
def sized_events(events: DataFrame) -> DataFrame:
    sized = events.select(
        F.col("event_id").cast("string").alias("_id"),
        F.col("ts").alias("timestamp"),
        original_size(row_json(["event_id", "user_id", "event_type"])).alias("original_size"),
        original_size("props").alias("compressed_size"),
    )
    return sized.withColumn(
        "compression_ratio", size_ratio("original_size", "compressed_size"))


SIZED_EVENTS_SQL = """
    select event_id::varchar as _id, ts, b::bigint as original_size, p::bigint as compressed_size,
           b::double / nullif(p, 0) as compression_ratio
    from (select event_id, ts, strlen(props) as p,
                 strlen(to_json(struct_pack(event_id, user_id, event_type))::varchar) as b
          from events)
"""

# The row payload of the events and documents tables.
EVENT_PAYLOAD_SQL = """
    select event_id, to_json(q)::varchar as payload
    from (select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type,
                 value, props from events) q
"""

DOCUMENT_PAYLOAD_SQL = f"""
    select doc_id, to_json(q)::varchar as payload
    from (select doc_id, text, lang, source, n_chars,
                 '{AS_OF_TEXT}' as process_timestamp from documents) q
"""
