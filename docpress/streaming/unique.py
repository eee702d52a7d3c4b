"""A stream whose ids may be taken only once, also by what a collection holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docpress.operators.sinks import write_micro_batch
from docpress.operators.unique import split_by_key
from docpress.scratch import release
from docpress.sources.collection import read_collection
from docpress.streaming.ingest import TRIGGER_SECONDS, triggered

BATCH, QUERY = "batch_id", "query_id"


def start_unique(documents: DataFrame, path: str, rejected_path: str, checkpoint: str, *,
                 key: str = "_id", order_by: Sequence[str] = (),
                 trigger_seconds: int = TRIGGER_SECONDS, available_now: bool = False
                 ) -> StreamingQuery:
    """Append each micro-batch's rows with new keys to ``path``, the others to ``rejected_path``.

    The collection itself is the state, whoever wrote it: ids of earlier batches, of a
    batch job or of another query are taken, before and after a restart and without
    a limit in time. Inside a batch the first row by ``order_by`` wins. Only the
    collection's key column is read, and only keys that the batch offers
    are joined (:func:`docpress.operators.unique.split_by_key`).

    A batch that runs again after a failure replaces what it stored: rows of the same
    query and batch do not count as taken. Two queries that append to one collection at
    the same time are not kept apart.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        held = _held_by_others(spark, path, documents, query_id, batch_id)
        split = split_by_key(batch, held, key=key, order_by=order_by)
        for rows, target in ((split.rejected, rejected_path), (split.accepted, path)):
            write_micro_batch(rows.withColumn(BATCH, F.lit(batch_id)), target, query_id)
        for folder in split.scratch:
            release(spark, folder)

    writer = (documents.writeStream.foreachBatch(store).outputMode("append")
              .option("checkpointLocation", checkpoint))
    return triggered(writer, available_now, trigger_seconds).start()


def _held_by_others(spark: SparkSession, path: str, documents: DataFrame, query_id: str,
                    batch_id: int) -> DataFrame:
    held = read_collection(spark, path, schema=documents.schema)
    if BATCH not in held.columns:
        return held
    own = (F.col(QUERY) == query_id) & (F.col(BATCH) == batch_id)
    return held.where(~F.coalesce(own, F.lit(False)))
