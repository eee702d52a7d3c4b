"""Appending documents to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FILE_FORMATS = ("parquet", "orc", "json")


def insert_options(batch_size: int = 1000) -> dict[str, str]:
    """How a document-store connector inserts: unordered, ``batch_size`` at a time."""
    return {"maxBatchSize": str(batch_size), "ordered": "false"}


def document_store_options(database: str, collection: str, batch_size: int = 1000) -> dict[str, str]:
    """Target and insert options for a document-store connector."""
    return {"database": database, "collection": collection, **insert_options(batch_size)}


def append_documents(documents: DataFrame, path: str | None, *, format: str = "parquet",
                     max_records_per_file: int | None = None, **options: object) -> None:
    """Append straight from the executors; nothing passes through the driver.

    ``max_records_per_file`` only caps file size: leave it unset for few, large
    files. ``path=None`` suits connectors that take their target from options.
    """
    writer = documents.write.format(format).mode("append").options(**options)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.save(path)


def write_micro_batch(documents: DataFrame, path: str, query_id: str, *,
                      format: str = "parquet", **options: object) -> None:
    """Write one micro-batch so that writing it again changes nothing.

    ``documents`` carry ``batch_id``. The folder of that query and batch is
    replaced, so a batch replayed after a failure is not stored twice; a new
    checkpoint means a new ``query_id`` and leaves older batches alone.
    """
    replace_partitions(documents.withColumn("query_id", F.lit(query_id)), path,
                       ["query_id", "batch_id"], format=format, **options)


def replace_partitions(documents: DataFrame, path: str, columns: list[str], *,
                       format: str = "parquet", **options: object) -> None:
    """Write folders by ``columns``; those that are there already are replaced, others stay."""
    (documents.write.format(format).mode("overwrite").options(**options)
     .option("partitionOverwriteMode", "dynamic").partitionBy(*columns).save(path))
