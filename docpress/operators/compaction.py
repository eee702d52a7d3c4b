"""Fewer files for a collection that micro-batches have filled."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession, Window
from pyspark.sql import functions as F

from docpress.operators.layout import TARGET_PARTITION_BYTES

# Readers pass over names that begin with an underscore.
STAGE, COMPLETE = "_compacted", "_complete"
# Batches that one job rewrites; the driver knows their folders' names.
BATCHES_AT_ONCE = 10_000


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(files, path) -> Iterator:
    """Folders of ``path`` that are named after a column's value."""
    for status in files.listStatus(path):
        if status.isDirectory() and "=" in status.getPath().getName():
            yield status.getPath()


def _replace(files, staged, target) -> None:
    files.delete(target, True)
    if not files.rename(staged, target):
        raise OSError(f"cannot move {staged} to {target}")


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Bring to its end what a compaction that died has left, or undo it.

    Staged folders are complete or not used at all: from the time their mark is there the
    folders they stand for may be gone, and each is put in its place; before that the
    collection was not touched, and they are deleted.
    """
    files, stage = _files(spark, path), _path(spark, path, STAGE)
    if not files.exists(stage):
        return
    if files.exists(_path(spark, path, STAGE, COMPLETE)):
        for query in _folders(files, stage):
            for batch in _folders(files, query):
                _replace(files, batch, _path(spark, path, query.getName(), batch.getName()))
    files.delete(stage, True)


def _tasks(batches: list[Row], target_bytes: int) -> tuple[list[tuple[str, str, int, int]], int]:
    """For each batch its first task and how many it has: one for each of its files. Batches of
    one file share a task as long as all of them are no larger than a partition should be."""
    dealt, tasks, room = [], 0, 0
    for row in batches:
        if row["needed"] > 1 or row["bytes"] > room:
            dealt.append((row["query_id"], row["batch_id"], tasks, row["needed"]))
            tasks += row["needed"]
            room = 0 if row["needed"] > 1 else min(target_bytes, TARGET_PARTITION_BYTES) - row["bytes"]
        else:
            dealt.append((row["query_id"], row["batch_id"], tasks - 1, 1))
            room -= row["bytes"]
    return dealt, tasks


def compact_batches(spark: SparkSession, path: str, *,
                    target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Rewrite batches that lie in more files than their size asks for; how many were.

    A batch keeps its folder, so a collection is read as before. The latest batch of each query
    is left alone: it is the only one that its query may still replace. The rows of all such
    batches are shuffled, a task for each file that is to be, and staged, and when all are
    staged they take the place of the old folders one after the other. A run that dies
    is finished, or undone, by the next one or by :func:`finish_compaction`; until then the batch
    that was being replaced may be absent. Readers that have listed the old files must
    list them again. One compaction of a collection at a time.
    """
    finish_compaction(spark, path)
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
             .groupBy("query_id", "batch_id")
             .agg(F.count("*").alias("n"), F.sum("length").alias("bytes"),
                  F.first(F.regexp_replace("path", "/[^/]*$", "")).alias("folder")))
    last = F.max("batch_id").over(Window.partitionBy("query_id"))
    needed = F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1))
    # Names and sizes alone, one row for each batch.
    batches = found.withColumns({"last": last, "needed": needed}).where(
        (F.col("batch_id") < F.col("last")) & (F.col("n") > F.col("needed"))).select(
        F.col("query_id").cast("string"), F.col("batch_id").cast("string"),
        "folder", "bytes", "needed").collect()
    files, stage = _files(spark, path), f"{path.rstrip('/')}/{STAGE}"
    for start in range(0, len(batches), BATCHES_AT_ONCE):
        chosen = batches[start:start + BATCHES_AT_ONCE]
        rows = spark.read.option("basePath", path).parquet(*(row["folder"] for row in chosen))
        dealt, tasks = _tasks(chosen, target_bytes)
        places = F.broadcast(spark.createDataFrame(
            dealt, "of_query string, of_batch string, first int, files int"))
        at = (F.col("query_id").cast("string") == F.col("of_query")) & (
            F.col("batch_id").cast("string") == F.col("of_batch"))
        # No row is lost where folder names read otherwise one by one than together.
        task = F.coalesce(F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("files")),
                          F.lit(0)).cast("int")
        (rows.join(places, at, "left").withColumn("_task", task)
         .repartitionById(tasks, "_task").select(*rows.columns)
         .write.mode("overwrite").partitionBy("query_id", "batch_id").parquet(stage))
        files.create(_path(spark, stage, COMPLETE)).close()
        finish_compaction(spark, path)
    return len(batches)
