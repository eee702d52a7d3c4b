"""The checked daily run: inventory, batch job, statistics, gates."""

from __future__ import annotations

from datetime import date
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.operators.gates import MIN_RATIO, check, enforce
from docpress.operators.sinks import FILE_FORMATS
from docpress.plans.batch import run_batch


def checked_run(spark: SparkSession, input_path: str, output_path: str, *,
                min_ratio: float = MIN_RATIO, strict: bool = True, run_id: str | None = None,
                **batch: object) -> DataFrame:
    """Run the batch job and return a one-row report with the verdicts.

    ``strict`` raises when the collection does not pass; the documents are
    stored either way. When and how often to try again is the scheduler's part; a run
    that is tried again replaces what it stored. ``run_id`` names the run: by default
    the input path and the day. Collections with unique ids, and stores, tell
    documents by their ids instead. An input without files gets its report, too.
    """
    files = batch.get("output_format", "parquet") in FILE_FORMATS
    if run_id is None and files and not batch.get("unique_ids"):
        run_id = f"{date.today().isoformat()}-{sha256(input_path.encode()).hexdigest()[:12]}"
    run = run_batch(spark, input_path, output_path, run_id=run_id, **batch)
    report = check(run.collection, min_ratio).first()
    if strict:
        enforce(report, min_ratio)
    return spark.createDataFrame([report], check(run.collection, min_ratio).schema).select(
        F.lit(run.input["n_files"]).cast("bigint").alias("input_files"),
        F.lit(run.input["n_bytes"]).cast("bigint").alias("input_bytes"),
        F.lit(run.written["n_docs"]).cast("bigint").alias("written_docs"),
        "*",
    )
