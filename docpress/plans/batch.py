"""The batch job: a dataset into a collection of compressed documents."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpress.functions.codec import DEFAULT_LEVEL, check_level
from docpress.operators.documents import batch_documents, stamp
from docpress.operators.layout import choose_partitions, spread
from docpress.operators.sinks import FILE_FORMATS, append_documents, replace_partitions
from docpress.operators.stats import collection_stats, stats_columns
from docpress.operators.unique import unique_append
from docpress.sources.collection import read_collection
from docpress.sources.files import detect_format, input_inventory, read_table

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class BatchRun:
    """What one run read and wrote, and the collection's statistics after it."""

    input: Row
    partitions: int | None
    written: dict[str, object]
    collection: DataFrame


def documents_of(df: DataFrame, *, level: int = DEFAULT_LEVEL, id_col: str | None = "id",
                 partitions: int | None = None, as_of: datetime | str | None = None) -> DataFrame:
    """The job's transformation: spread, stamp, render, compress."""
    rows = spread(df, partitions) if partitions else df
    return batch_documents(stamp(rows, as_of), level=level, id_col=id_col, as_of=as_of)


def run_batch(spark: SparkSession, input_path: str, output_path: str | None, *,
              compression_level: int = DEFAULT_LEVEL, partitions: int | None = None,
              max_records_per_file: int | None = None, id_col: str | None = "id",
              unique_ids: bool = False, run_id: str | None = None, format: str | None = None,
              schema: T.StructType | str | None = None, as_of: datetime | str | None = None,
              output_format: str = "parquet",
              output_options: dict[str, str] | None = None) -> BatchRun:
    """Read ``input_path``, append its documents to ``output_path``, report.

    ``partitions`` fixes the number of compressing tasks; by default it follows
    the input's size. ``unique_ids`` rejects documents whose id is already taken
    instead of storing them again. With ``run_id`` the documents lie in a folder of
    that run, and a run that is started again under its id replaces them: so a retry
    stores nothing twice. An input without files stores nothing. ``output_format`` names another file format,
    or a store whose connector is on the class path and takes ``output_options``.
    """
    check_level(compression_level)
    if unique_ids and output_format != "parquet":
        raise ValueError("unique_ids needs a Parquet collection; a store checks its own keys")
    if run_id and (unique_ids or output_format not in FILE_FORMATS):
        raise ValueError("run_id needs a collection of files without unique_ids")
    options = output_options or {}
    inventory = input_inventory(spark, input_path).first()
    if not inventory["n_files"]:
        empty = documents_of(spark.createDataFrame([], "id string"), level=compression_level)
        return BatchRun(inventory, None, collection_stats(empty).first().asDict(), collection_stats(
            read_collection(spark, output_path, format=output_format, schema=empty.schema,
                            **options)))
    if partitions is None:
        partitions = choose_partitions(inventory, spark.sparkContext.defaultParallelism)
    rows = read_table(spark, input_path, schema=schema,
                      format=format or detect_format(spark, input_path, inventory))
    documents = documents_of(rows, level=compression_level, id_col=id_col,
                             partitions=partitions, as_of=as_of)
    if unique_ids:
        written = unique_append(documents, output_path, observe=stats_columns()).written
    elif run_id:
        seen = Observation()
        replace_partitions(
            documents.observe(seen, *stats_columns()).withColumn("run_id", F.lit(run_id)),
            output_path, ["run_id"], format=output_format,
            **({"maxRecordsPerFile": max_records_per_file} if max_records_per_file else {}), **options)
        written = seen.get
    else:
        seen = Observation()
        append_documents(documents.observe(seen, *stats_columns()), output_path,
                         format=output_format, max_records_per_file=max_records_per_file,
                         **options)
        written = seen.get
    logger.info("stored %s documents in %s", written["n_docs"], output_path)
    return BatchRun(inventory, partitions, written,
                    collection_stats(read_collection(spark, output_path, format=output_format,
                                                     **options)))
