"""The stream job: a topic into a collection of compressed documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docpress.sources.messages import DEFAULT_SERVERS, DEFAULT_TOPIC, message_stream
from docpress.streaming.ingest import start_ingest


def run_stream(spark: SparkSession, output_path: str | None, checkpoint_dir: str, *,
               kafka_servers: str = DEFAULT_SERVERS, topic: str = DEFAULT_TOPIC,
               frames: DataFrame | None = None,
               source_options: Mapping[str, object] | None = None,
               **ingest: object) -> StreamingQuery:
    """Start the job on a topic, or on any stream of ``key, value, timestamp``.

    ``source_options`` are those of :func:`docpress.sources.messages.message_options`.
    """
    source = frames if frames is not None else message_stream(
        spark, kafka_servers, topic, **(source_options or {}))
    return start_ingest(source, output_path, checkpoint_dir, **ingest)
