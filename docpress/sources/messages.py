"""Streams of message frames: ``key``, ``value`` (bytes) and ``timestamp``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpress.functions.parsing import FRAME_ID

DEFAULT_SERVERS = "kafka:9092"
DEFAULT_TOPIC = "data-feed"

FRAME_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("timestamp", T.TimestampType()),
])


def message_options(servers: str = DEFAULT_SERVERS, topic: str = DEFAULT_TOPIC, *,
                    starting_offsets: str = "earliest", max_offsets_per_trigger: int = 1_000_000,
                    fail_on_data_loss: bool = True,
                    min_partitions: int | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source; the cap bounds one micro-batch.

    A stream whose offsets have expired fails unless ``fail_on_data_loss`` is off.

    ``min_partitions`` lets more tasks than the topic has partitions read it.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "maxOffsetsPerTrigger": str(max_offsets_per_trigger),
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return options


def message_stream(spark: SparkSession, servers: str = DEFAULT_SERVERS,
                   topic: str = DEFAULT_TOPIC, **options: object) -> DataFrame:
    """Frames of a topic. Needs the Kafka connector package on the class path."""
    stream = spark.readStream.format("kafka").options(**message_options(servers, topic, **options))
    frame_id = F.concat_ws(":", "topic", "partition", "offset").alias(FRAME_ID)
    return stream.load().select(*FRAME_SCHEMA.names, frame_id)


def file_frames(spark: SparkSession, path: str, *, schema: T.StructType = FRAME_SCHEMA,
                max_files_per_trigger: int | None = 1000, **options: object) -> DataFrame:
    """Rows landing as Parquet files, a bounded number of files per micro-batch.

    None takes all files that are there. ``frame_id`` is the row's place.
    """
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    place = F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias(FRAME_ID)
    return reader.options(**options).load(path).select("*", place)
