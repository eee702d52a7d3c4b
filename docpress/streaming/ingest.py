"""Message frames into a stored collection, one pass per micro-batch."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from docpress.functions.codec import DEFAULT_LEVEL, check_level
from docpress.functions.parsing import SENSOR_SCHEMA
from docpress.operators.documents import frame_documents, tag_batch
from docpress.operators.layout import spread
from docpress.operators.sinks import FILE_FORMATS, append_documents, write_micro_batch
from docpress.operators.stats import stats_columns

logger = logging.getLogger(__name__)

TRIGGER_SECONDS = 30

BatchListener = Callable[[int, Mapping[str, object]], None]


def log_batch(batch_id: int, stats: Mapping[str, object]) -> None:
    logger.info("batch %s stored: %s", batch_id, dict(stats))


def triggered(writer: DataStreamWriter, available_now: bool, seconds: int) -> DataStreamWriter:
    """Drain what is there and stop, or run for good at a fixed interval."""
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{seconds} seconds")


def start_ingest(frames: DataFrame, path: str | None, checkpoint: str, *,
                 schema: T.StructType = SENSOR_SCHEMA, level: int = DEFAULT_LEVEL,
                 size_unit: str = "bytes", partitions: int | None = None,
                 trigger_seconds: int = TRIGGER_SECONDS, available_now: bool = False,
                 as_of: datetime | str | None = None, output_format: str = "parquet",
                 output_options: Mapping[str, str] | None = None,
                 on_batch: BatchListener = log_batch) -> StreamingQuery:
    """Compress and store every micro-batch, and report its statistics.

    The statistics are observed while the batch is written, in the task that
    writes it, so the source is read and each text compressed once. A batch
    replayed after a failure replaces what it wrote before.

    ``partitions`` spreads each micro-batch before the CPU-heavy step; leave it
    unset where the source already has a partition per core. Files of any format
    get a folder for each batch; another ``output_format`` is a store, which takes
    its target from ``output_options`` and tells replayed documents by ``_id``.
    """
    check_level(level)
    options = dict(output_options or {})

    def store(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = spread(batch, partitions) if partitions else batch
        documents = tag_batch(
            frame_documents(rows, schema=schema, level=level, size_unit=size_unit, as_of=as_of),
            batch_id)
        seen = Observation()
        observed = documents.observe(seen, *stats_columns())
        if output_format in FILE_FORMATS:
            write_micro_batch(observed, path, query_id, format=output_format, **options)
        else:
            append_documents(observed, path, format=output_format, **options)
        on_batch(batch_id, seen.get)

    writer = (frames.writeStream.foreachBatch(store).outputMode("append")
              .option("checkpointLocation", checkpoint))
    return triggered(writer, available_now, trigger_seconds).start()
