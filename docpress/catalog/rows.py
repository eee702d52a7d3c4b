"""Row-local expressions: parsing, payloads, sizes, codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.catalog.registry import (
    AS_OF, AS_OF_TEXT, EVENT_PAYLOAD_SQL, FRAMES_SQL, SIZED_DOCUMENTS_SQL, micros, query,
    sensor_frames, sized_documents, table, table_path)
from docpress.functions.codec import compress
from docpress.functions.parsing import decode_frames, parse_json
from docpress.functions.payload import document_id, row_json
from docpress.functions.sizes import original_size
from docpress.operators.documents import batch_documents, classify_frames, stamp, unpack
from docpress.operators.layout import read_spread, spread


@query("frame_decode", f"""
    select key, raw_value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as "timestamp" from ({FRAMES_SQL})
""")
def frame_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = sensor_frames(table(spark, sf_dir, "events"))
    return decode_frames(frames).withColumn("timestamp", micros("timestamp"))


@query("json_parse", f"""
    select key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as reading_time, key as sensor_id,
           value as temperature, null::double as humidity, event_type as type, quality
    from ({FRAMES_SQL})
""")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = decode_frames(sensor_frames(read_spread(spark, table_path(sf_dir, "events"))))
    return frames.select("key", parse_json("raw_value").alias("data")).select(
        "key", F.col("data.timestamp").alias("reading_time"), "data.sensor_id",
        "data.temperature", "data.humidity", "data.metadata.type", "data.metadata.quality")


@query("json_parse_rejects", f"""
    with cut as (
        select key, case event_type when 'error' then left(raw_value, length(raw_value) - 1)
                                    else raw_value end as text, value, event_type
        from ({FRAMES_SQL}))
    select key, 'parsed' as outcome, value as temperature, null as corrupt_record
    from cut where json_valid(text)
    union all
    select key, 'rejected', null, text from cut where not json_valid(text)
""")
def json_parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of error events lose their last brace before they are parsed."""
    events = read_spread(spark, table_path(sf_dir, "events"))
    text = F.col("value").cast("string")
    cut = sensor_frames(events).withColumn("value", F.when(
        F.get_json_object(text, "$.metadata.type") == "error",
        F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text).cast("binary"))
    classified = classify_frames(cut)
    return classified.select(
        "key",
        F.when(F.col("corrupt_record").isNull(), "parsed").otherwise("rejected").alias("outcome"),
        F.col("data.temperature").alias("temperature"), "corrupt_record")


@query("stamp_as_of", f"""
    select * replace (strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts),
           '{AS_OF_TEXT}' as process_timestamp
    from events
""")
def stamp_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamp(table(spark, sf_dir, "events"), AS_OF).withColumns(
        {name: micros(name) for name in ("ts", "process_timestamp")})


@query("row_payload", EVENT_PAYLOAD_SQL)
def row_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", row_json(events.columns).alias("payload"))


@query("document_assemble", f"""
    select event_id::varchar as _id, strlen(payload)::bigint as original_size, payload,
           '{AS_OF_TEXT}' as stored_at, 9 as compression_level, 'zlib' as algorithm
    from ({EVENT_PAYLOAD_SQL})
""")
def document_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = batch_documents(read_spread(spark, table_path(sf_dir, "events")), id_col="event_id",
                                as_of=AS_OF)
    return unpack(documents, ["_id", "original_size", "metadata"]).select(
        "_id", "original_size", "payload",
        micros("metadata.timestamp").alias("stored_at"),
        "metadata.compression_level", "metadata.algorithm")


@query("document_id", "select o_orderkey::varchar as _id, o_custkey from orders")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(document_id(orders, "o_orderkey").alias("_id"), "o_custkey")


@query("repartition_keeps_rows", """
    select * replace (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') as l_shipdate) from lineitem
""")
def repartition_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", micros("l_shipdate"))
    return spread(lines, 2 * spark.sparkContext.defaultParallelism)


@query("compress_roundtrip", """
    select doc_id, md5(payload) as md5, strlen(payload)::bigint as n_bytes
    from (select doc_id, to_json(q)::varchar as payload from documents q)
""")
def compress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_spread(spark, table_path(sf_dir, "documents"))
    packed = documents.select("doc_id", compress(row_json(documents.columns)).alias("data"))
    return unpack(packed, ["doc_id"]).select(
        "doc_id", F.md5("payload").alias("md5"), original_size("payload").alias("n_bytes"))


@query("compress_text_roundtrip", """
    select doc_id, md5(text) as md5, strlen(text)::bigint as n_bytes from documents
""")
def compress_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_spread(spark, table_path(sf_dir, "documents"))
    packed = documents.select("doc_id", compress("text").alias("data"))
    return unpack(packed, ["doc_id"]).select(
        "doc_id", F.md5("payload").alias("md5"), original_size("payload").alias("n_bytes"))


@query("payload_sizes", """
    select doc_id, strlen(text)::bigint as n_bytes, length(text)::bigint as n_characters
    from documents
""")
def payload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", original_size("text").alias("n_bytes"),
        original_size("text", "chars").alias("n_characters"))


@query("size_ratio", f"select _id, compression_ratio from ({SIZED_DOCUMENTS_SQL})")
def size_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_documents(spark, sf_dir).select("_id", "compression_ratio")
