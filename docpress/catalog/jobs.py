"""Whole jobs: batch, stream and the checked daily run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docpress.catalog.registry import (
    AS_OF, AS_OF_TEXT, DOCUMENT_PAYLOAD_SQL, EVENT_SLICES_SQL, FRAMES_SQL, micros, query,
    replay_events, sensor_frames, table, table_path)
from docpress.operators.documents import frame_documents, tag_batch, unpack
from docpress.operators.layout import write_files_of
from docpress.operators.sinks import write_micro_batch
from docpress.operators.stats import batch_stats
from docpress.plans.batch import run_batch
from docpress.plans.daily import checked_run
from docpress.plans.stream import run_stream
from docpress.scratch import scratch_path
from docpress.sources.collection import read_collection


@query("batch_job", f"""
    select doc_id::varchar as _id, strlen(payload)::bigint as original_size, md5(payload) as md5
    from ({DOCUMENT_PAYLOAD_SQL})
""")
def batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    run_batch(spark, table_path(sf_dir, "documents"), path, id_col="doc_id", as_of=AS_OF)
    texts = unpack(read_collection(spark, path), ["_id", "original_size"])
    return texts.select("_id", "original_size", F.md5("payload").alias("md5"))


@query("stream_ingest", f"""
    select key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as "timestamp", key as sensor_id,
           value as temperature, event_type as type, quality,
           strlen(raw_value)::bigint as original_size, md5(raw_value) as md5,
           '{AS_OF_TEXT}' as process_timestamp, 1::bigint as n_of_id
    from ({FRAMES_SQL})
""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")

    def start(events: DataFrame) -> StreamingQuery:
        return run_stream(spark, path, checkpoint, frames=sensor_frames(events),
                          available_now=True, as_of=AS_OF)

    replay_events(spark, sf_dir, start)
    stored = read_collection(spark, path)
    ids = stored.groupBy("_id").agg(F.count("*").alias("n_of_id"))
    texts = unpack(stored, ["_id", "key", "timestamp", "data", "original_size",
                            "process_timestamp"], data="compressed_data")
    return texts.join(ids, "_id").select(
        "key", micros("timestamp").alias("timestamp"), "data.sensor_id", "data.temperature",
        "data.metadata.type", "data.metadata.quality", "original_size",
        F.md5("payload").alias("md5"),
        micros("process_timestamp").alias("process_timestamp"), "n_of_id")


@query("stream_batch_stats", f"""
    select slice::bigint as batch_id, count(*) as n_docs,
           sum(strlen(raw_value))::bigint as total_original, true as adds_up
    from ({FRAMES_SQL}) f join (select event_id, slice from ({EVENT_SLICES_SQL})) s
         using (event_id)
    group by 1
""")
def stream_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the batches an ingest really stored: one for each drained slice."""
    path, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")

    def start(events: DataFrame) -> StreamingQuery:
        return run_stream(spark, path, checkpoint, frames=sensor_frames(events),
                          available_now=True, as_of=AS_OF)

    replay_events(spark, sf_dir, start, max_files_per_trigger=None)
    stored = read_collection(spark, path).withColumn(
        "stored_bytes", F.octet_length("compressed_data").cast("bigint"))
    stats = batch_stats(stored)
    actual = stored.groupBy("batch_id").agg(F.sum("stored_bytes").alias("stored_bytes"))
    return stats.join(actual, "batch_id").select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "n_docs", "total_original",
        (F.col("total_compressed") == F.col("stored_bytes")).alias("adds_up"))


@query("stream_replay", f"""
    select key, strlen(raw_value)::bigint as original_size, md5(raw_value) as md5
    from ({FRAMES_SQL})
""")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-batch that is written twice is stored once."""
    path = scratch_path(spark, "replayed")
    frames = sensor_frames(table(spark, sf_dir, "events"))
    for _ in range(2):
        write_micro_batch(tag_batch(frame_documents(frames, as_of=AS_OF), 0), path, "replayed")
    texts = unpack(read_collection(spark, path), ["key", "original_size"], data="compressed_data")
    return texts.select("key", "original_size", F.md5("payload").alias("md5"))


# As many files as there are languages; rows are dealt to them evenly.
_LANDED_SQL = f"""
    select lang, to_json(q)::varchar as payload
    from (select doc_id, text, lang, source, n_chars, lang as part,
                 '{AS_OF_TEXT}' as process_timestamp from documents) q
"""


@query("checked_run_report", f"""
    select floor, input_files, written_docs, n_docs, total_original, has_documents, ratio_ok,
           ratio_ok and has_documents as passed
    from (select count(distinct lang) as input_files, count(*) as written_docs,
                 count(*) as n_docs, sum(strlen(payload))::bigint as total_original,
                 count(*) > 0 as has_documents
          from ({_LANDED_SQL})),
         (values (0.0::double, true), (1e9::double, false)) as f(floor, ratio_ok)
""")
def checked_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run and its retry store one copy; a floor that is passed, and one that is not."""
    landed, path = scratch_path(spark, "landed"), scratch_path(spark, "documents")
    write_files_of(table(spark, sf_dir, "documents").withColumn("part", F.col("lang")), landed, "part")
    reports = [
        checked_run(spark, landed, path, id_col="doc_id", as_of=AS_OF, strict=False,
                    min_ratio=floor, format="parquet").select(
            F.lit(floor).alias("floor"), "input_files", "written_docs", "n_docs",
            "total_original", "has_documents", "ratio_ok", "passed")
        for floor in (0.0, 1e9)]
    return reports[0].unionByName(reports[1])
