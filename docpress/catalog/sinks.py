"""Writing collections and reading them back."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docpress.catalog.registry import (
    AS_OF, DOCUMENT_PAYLOAD_SQL, EVENT_PAYLOAD_SQL, EVENT_SLICES_SQL, FRAMES_SQL,
    SIZED_DOCUMENTS_SQL, SIZED_EVENTS_SQL, query, replay_events, sensor_frames, sized_documents,
    sized_events, table, table_path)
from docpress.functions.dictionary import load_dictionary, store_dictionary, train_dictionary
from docpress.functions.payload import row_json
from docpress.functions.sizes import original_size
from docpress.operators.documents import batch_documents, frame_documents, stamp, tag_batch, unpack
from docpress.operators.compaction import compact_batches
from docpress.operators.layout import (
    keyed_options, read_by_id, read_ids, read_spread, store_bounds, write_by_id_hash,
    write_by_metric, write_by_metrics)
from docpress.operators.publish import publish_ordered
from docpress.operators.ranked import metric_range, top_k_by_bounds
from docpress.operators.sinks import append_documents, write_micro_batch
from docpress.operators.stats import storage_stats
from docpress.operators.unique import UniqueAppend, unique_append
from docpress.scratch import scratch_path
from docpress.sources.collection import read_collection
from docpress.streaming.unique import start_unique


@query("collection_scan", f"""
    select doc_id::varchar as _id, strlen(payload)::bigint as original_size, 'zlib' as algorithm
    from ({DOCUMENT_PAYLOAD_SQL})
""")
def collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    rows = stamp(read_spread(spark, table_path(sf_dir, "documents")), AS_OF)
    append_documents(batch_documents(rows, id_col="doc_id", as_of=AS_OF), path)
    return read_collection(spark, path).select("_id", "original_size", "metadata.algorithm")


@query("write_then_scan", """
    select c_custkey::varchar as _id, strlen(to_json(c)::varchar)::bigint as original_size
    from customer c
    union all
    select s_suppkey::varchar, strlen(to_json(s)::varchar)::bigint from supplier s
""")
def write_then_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of different shape appended to one collection."""
    path = scratch_path(spark, "documents")
    for name, id_col in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        append_documents(batch_documents(table(spark, sf_dir, name), id_col=id_col), path)
    return read_collection(spark, path).select("_id", "original_size")


_KEYED_EVENTS_SQL = """
    with incoming as (
        select user_id::varchar as _id, event_id,
               strlen(to_json(struct_pack(user_id, event_type, value))::varchar)::bigint
                   as original_size,
               row_number() over (partition by user_id order by event_id) as place,
               user_id in (select s_suppkey from supplier) as taken
        from events)
    select _id, event_id, original_size from incoming
"""


def _append_events(spark: SparkSession, sf_dir: str) -> UniqueAppend:
    """Events keyed by user, appended where the supplier keys are already taken."""
    path = scratch_path(spark, "keyed")
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("_id"),
        F.lit(None).cast("bigint").alias("event_id"),
        original_size(row_json(["s_suppkey"])).alias("original_size"))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("_id"), "event_id",
        original_size(row_json(["user_id", "event_type", "value"])).alias("original_size"))
    append_documents(supplier, path)
    return unique_append(events, path, order_by=["event_id"])


@query("unique_append_accepted", _KEYED_EVENTS_SQL + " where place = 1 and not taken")
def unique_append_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append_events(spark, sf_dir).accepted


@query("unique_append_rejected", _KEYED_EVENTS_SQL + " where place > 1 or taken")
def unique_append_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append_events(spark, sf_dir).rejected


# A slice of event time is a batch; of a user's events the first of the first slice wins.
_STREAMED_SQL = f"""
    with incoming as (
        select user_id::varchar as _id, event_id, value, slice::bigint as batch_id,
               row_number() over (partition by user_id order by slice, event_id) as place,
               user_id in (select s_suppkey from supplier) as taken
        from ({EVENT_SLICES_SQL}))
    select _id, event_id, value, batch_id from incoming
"""


def _stream_unique(spark: SparkSession, sf_dir: str, wanted: str) -> DataFrame:
    """Events keyed by user, streamed to where a batch job has stored the supplier keys.

    Each slice of events is drained by a query of its own with the same checkpoint.
    """
    path, rejected, checkpoint = (scratch_path(spark, f"unique-{x}") for x in ("kept", "rest", "at"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("_id"), F.lit(None).cast("bigint").alias("event_id"),
        F.lit(None).cast("double").alias("value"), F.lit("batch job").alias("query_id"),
        F.lit(-1).cast("bigint").alias("batch_id"))
    supplier.write.partitionBy("query_id", "batch_id").parquet(path)

    def start(events: DataFrame) -> StreamingQuery:
        documents = events.select(F.col("user_id").cast("string").alias("_id"), "event_id", "value")
        return start_unique(documents, path, rejected, checkpoint, order_by=["event_id"],
                            available_now=True)

    replay_events(spark, sf_dir, start, max_files_per_trigger=None)
    rows = read_collection(spark, path if wanted == "accepted" else rejected)
    return rows.where(F.col("query_id") != "batch job").select(
        "_id", "event_id", "value", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("stream_unique_accepted", _STREAMED_SQL + " where place = 1 and not taken")
def stream_unique_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_unique(spark, sf_dir, "accepted")


@query("stream_unique_rejected", _STREAMED_SQL + " where place > 1 or taken")
def stream_unique_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_unique(spark, sf_dir, "rejected")


@query("publish_frames", """
    select coalesce(sensor_id, 'default_' || (row_number() over (order by event_id) - 1)::varchar)
               as key,
           to_json(struct_pack(sensor_id, event_id, temperature))::varchar as value
    from (select case when event_type <> 'error' then concat('sensor_', user_id) end as sensor_id,
                 event_id, value as temperature from events)
""")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of error events have lost their sensor id."""
    records = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "error",
               F.concat(F.lit("sensor_"), F.col("user_id"))).alias("sensor_id"),
        "event_id", F.col("value").alias("temperature"))
    frames = publish_ordered(records, ["event_id"])
    return frames.select(F.col("key").cast("string").alias("key"),
                         F.col("value").cast("string").alias("value"))


def _range_sql(metric: str, low: float, high: float) -> str:
    return f"""
        select _id, original_size, compression_ratio from ({SIZED_DOCUMENTS_SQL})
        where {metric} >= {low} and {metric} < {high}
    """


def _range(spark: SparkSession, sf_dir: str, metric: str, low: float, high: float) -> DataFrame:
    path = scratch_path(spark, f"by-{metric}")
    write_by_metric(sized_documents(spark, sf_dir), path, metric)
    return metric_range(read_collection(spark, path), metric, low, high).select(
        "_id", "original_size", "compression_ratio")


@query("range_lookup", _range_sql("original_size", 1000, 5000))
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range(spark, sf_dir, "original_size", 1000, 5000)


@query("range_lookup_compressed_size", _range_sql("compressed_size", 500, 2000))
def range_lookup_compressed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range(spark, sf_dir, "compressed_size", 500, 2000)


@query("range_lookup_ratio", _range_sql("compression_ratio", 1.0, 1.05))
def range_lookup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range(spark, sf_dir, "compression_ratio", 1.0, 1.05)


@query("range_lookup_time", f"""
    select _id, original_size from ({SIZED_EVENTS_SQL})
    where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'
""")
def range_lookup_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "by-time")
    write_by_metric(sized_events(table(spark, sf_dir, "events")), path, "timestamp")
    return metric_range(read_collection(spark, path), "timestamp",
                        datetime(2024, 1, 10), datetime(2024, 1, 12)).select("_id", "original_size")


@query("hash_layout_keeps_rows", f"select _id, original_size from ({SIZED_DOCUMENTS_SQL})")
def hash_layout_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "by-id")
    write_by_id_hash(sized_documents(spark, sf_dir), path,
                     shards=spark.sparkContext.defaultParallelism)
    return read_collection(spark, path).select("_id", "original_size")


_WANTED = ["0", "7", "42", "99", "no such id"]


@query("hash_lookup", f"""
    select _id, original_size from ({SIZED_DOCUMENTS_SQL})
    where _id in ({", ".join(f"'{i}'" for i in _WANTED)})
""")
def hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some ids, from a collection of which a part has another number of shards."""
    path = scratch_path(spark, "by-id")
    documents = sized_documents(spark, sf_dir)
    odd = F.col("_id").cast("bigint") % 2 == 1
    write_by_id_hash(documents.where(odd), path, shards=7)
    write_by_id_hash(documents.where(~odd), path, shards=4, mode="append")
    return read_by_id(spark, path, _WANTED).select("_id", "original_size")


@query("storage_size", """
    select count(*) as n_docs, count(distinct (source, doc_id % 4)) as n_files, true as has_bytes
    from documents
""")
def storage_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with four files for each source: documents, files and bytes on disk."""
    rows = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "by-source")
    documents = batch_documents(rows, id_col="doc_id", as_of=AS_OF)
    parts = rows.select(F.col("doc_id").cast("string").alias("_id"), "source",
                        (F.col("doc_id") % 4).alias("salt"))
    (documents.join(parts, "_id").repartition("source", "salt")
     .write.partitionBy("source", "salt").parquet(path))
    return storage_stats(spark, path).select(
        "n_docs", "n_files", (F.col("disk_bytes") > F.col("logical_bytes")).alias("has_bytes"))


# One collection of events in a common order of four metrics, read by each of them.
_METRICS = ("timestamp", "original_size", "compressed_size", "compression_ratio")


def _common(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "by-all")
    write_by_metrics(sized_events(table(spark, sf_dir, "events")), path, _METRICS,
                     partitions=4 * spark.sparkContext.defaultParallelism)
    return path


@query("range_lookup_common", f"""
    with d as ({SIZED_EVENTS_SQL})
    select 'timestamp' as metric, _id from d
    where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'
    union all select 'original_size', _id from d where original_size >= 53 and original_size < 54
    union all select 'compressed_size', _id from d where compressed_size >= 8 and compressed_size < 9
    union all select 'compression_ratio', _id from d
    where compression_ratio >= 6 and compression_ratio < 6.2
""")
def range_lookup_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of four metrics from one stored order."""
    ranges = zip(_METRICS, (datetime(2024, 1, 10), 53, 8, 6.0), (datetime(2024, 1, 12), 54, 9, 6.2))
    rows = read_collection(spark, _common(spark, sf_dir))
    return reduce(DataFrame.unionAll, (
        metric_range(rows, metric, low, high).select(F.lit(metric).alias("metric"), "_id")
        for metric, low, high in ranges))


@query("topk_by_bounds", f"""
    with d as ({SIZED_EVENTS_SQL})
    select * from (select 'newest' as list, _id, original_size from d
                   order by ts desc nulls last, _id limit 100)
    union all select * from (select 'largest', _id, original_size from d
                             order by original_size desc nulls last, _id limit 100)
    union all select * from (select 'least', _id, original_size from d
                             order by compression_ratio nulls last, _id limit 100)
""")
def topk_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists from one stored order; the bounds of its files tell what to read."""
    path, bounds_path = _common(spark, sf_dir), scratch_path(spark, "bounds")
    store_bounds(spark, path, bounds_path, _METRICS)
    rows, bounds = read_collection(spark, path), spark.read.parquet(bounds_path)
    lists = (("newest", "timestamp", False), ("largest", "original_size", False),
             ("least", "compression_ratio", True))
    return reduce(DataFrame.unionAll, (
        top_k_by_bounds(rows, bounds, metric, 100, ascending=ascending).select(
            F.lit(name).alias("list"), "_id", "original_size")
        for name, metric, ascending in lists))


@query("keyed_lookup", f"""
    select _id, original_size from ({SIZED_DOCUMENTS_SQL})
    where _id in ({", ".join(f"'{i}'" for i in _WANTED)})
""")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some ids, from a collection in no order at all; its files tell what they cannot hold."""
    path = scratch_path(spark, "keyed")
    documents = sized_documents(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)
    append_documents(documents, path, **keyed_options(1_000_000))
    return read_ids(spark, path, _WANTED).select("_id", "original_size")


# Batches of the compacted collection; events are dealt to them by their ids.
_BATCHES = 7


@query("compacted_batches", f"""
    with f as (select event_id % {_BATCHES} as batch_id, raw_value from ({FRAMES_SQL}))
    select batch_id::int as batch_id, count(*) as n_docs,
           sum(strlen(raw_value))::bigint as total_original,
           bit_xor(('0x' || left(md5(raw_value), 15))::bigint) as marks,
           batch_id < {_BATCHES - 1} as one_file
    from f group by 1, 5
""")
def compacted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of many small files, compacted: their rows, and which lie in one file now.

    The last batch is left alone. ``marks`` says that the texts are the same.
    """
    path = scratch_path(spark, "batches")
    events = table(spark, sf_dir, "events")
    for n in range(_BATCHES):
        frames = sensor_frames(events.where(F.col("event_id") % _BATCHES == n)).repartition(5)
        write_micro_batch(tag_batch(frame_documents(frames, as_of=AS_OF), n), path, "compacted")
    compact_batches(spark, path, target_bytes=1 << 40)
    documents = read_collection(spark, path).withColumn("file", F.col("_metadata.file_path"))
    texts = unpack(documents, ["batch_id", "file", "original_size"], data="compressed_data")
    mark = F.conv(F.substring(F.md5("payload"), 1, 15), 16, 10).cast("bigint")
    return texts.groupBy("batch_id").agg(
        F.count("*").alias("n_docs"), F.sum("original_size").alias("total_original"),
        F.bit_xor(mark).alias("marks"), (F.count_distinct("file") == 1).alias("one_file"))


@query("dictionary_roundtrip", f"""
    select event_id::varchar as _id, strlen(payload)::bigint as original_size,
           md5(payload) as md5, true as half_the_size
    from ({EVENT_PAYLOAD_SQL})
""")
def dictionary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed with a dictionary trained on them, and unpacked with the one stored.

    All of them together take less than half of what they take without it.
    """
    path, kept = scratch_path(spark, "documents"), scratch_path(spark, "dictionaries")
    events = table(spark, sf_dir, "events")
    trained = train_dictionary(events.select(row_json(events.columns).alias("payload")), "payload")
    store_dictionary(spark, kept, trained)
    append_documents(batch_documents(events, id_col="event_id", as_of=AS_OF, dictionary=trained), path)
    documents = read_collection(spark, path)
    named = documents.select("metadata.dictionary").first()
    plain = batch_documents(events, id_col="event_id", as_of=AS_OF).agg(
        F.sum("compressed_size").alias("plain"))
    packed = documents.agg(F.sum("compressed_size").alias("packed"))
    # One row each.
    half = plain.join(packed).select((F.col("packed") * 2 < F.col("plain")).alias("half_the_size"))
    dictionary = load_dictionary(spark, kept, named["dictionary"]) if named else trained
    texts = unpack(documents, ["_id", "original_size"], dictionary=dictionary)
    return texts.join(F.broadcast(half)).select(
        "_id", "original_size", F.md5("payload").alias("md5"), "half_the_size")
