"""Statistics of stored documents, read from their size columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docpress.functions.sizes import size_ratio
from docpress.operators.sinks import replace_partitions
from docpress.sources.collection import read_collection
from docpress.sources.files import input_inventory


def stats_columns(original: str = "original_size", compressed: str = "compressed_size",
                  ratio: str = "compression_ratio") -> list[Column]:
    """Count, mean of the per-document ratios, and total sizes.

    The same aggregates serve a table, a group and an observed write.
    """
    return [
        F.count(F.lit(1)).alias("n_docs"),
        F.avg(ratio).alias("avg_ratio"),
        F.sum(original).alias("total_original"),
        F.sum(compressed).alias("total_compressed"),
    ]


def collection_stats(documents: DataFrame, **columns: str) -> DataFrame:
    """One row; ``avg_ratio`` weighs documents alike, ``overall_ratio`` weighs bytes."""
    return documents.agg(*stats_columns(**columns)).withColumn(
        "overall_ratio", size_ratio("total_original", "total_compressed"))


def batch_stats(documents: DataFrame, **columns: str) -> DataFrame:
    """The statistics of each micro-batch in a stored stream collection."""
    return documents.groupBy("batch_id").agg(*stats_columns(**columns))


def ratio_count_summary(documents: DataFrame, ratio: str = "compression_ratio") -> DataFrame:
    """Mean ratio and number of documents."""
    return documents.agg(F.avg(ratio).alias("avg_ratio"), F.count(F.lit(1)).alias("total_docs"))


def logical_size(documents: DataFrame, compressed: str = "compressed_size") -> DataFrame:
    """Document count and stored payload bytes, without reading a payload."""
    return documents.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(compressed), F.lit(0)).alias("logical_bytes"))


def storage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Document count, payload bytes, file count and bytes on disk of a Parquet
    collection, in one row."""
    on_disk = input_inventory(spark, path).select("n_files", F.col("n_bytes").alias("disk_bytes"))
    logical = logical_size(read_collection(spark, path))
    both = logical.unionByName(on_disk, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


COMMIT = "commit"
# Values a quantile sketch keeps: quantiles are off by about 1.3 % of the rows at 200.
SKETCH_K = 200
_PARTIAL = "n_docs long, n_ratios long, ratio_sum double, total_original long, " \
    "total_compressed long, ratio_sketch binary"


def append_with_partial(documents: DataFrame, path: str, partials: str, commit: str) -> None:
    """Store a commit and, from the same write, its part of the statistics.

    A commit owns a folder of the collection and one of ``partials``; storing it again, say
    after a failure between the two, replaces both. The partial is one row: exact counts and
    sums, and a quantile sketch of the ratios, so nothing is ever read again for statistics.
    """
    spark = documents.sparkSession
    seen = Observation()
    observed = documents.observe(
        seen, F.count(F.lit(1)).alias("n_docs"), F.count("compression_ratio").alias("n_ratios"),
        F.sum("compression_ratio").alias("ratio_sum"), F.sum("original_size").alias("total_original"),
        F.sum("compressed_size").alias("total_compressed"),
        F.kll_sketch_agg_double(F.col("compression_ratio").cast("double"), SKETCH_K)
        .alias("ratio_sketch"))
    replace_partitions(observed.withColumn(COMMIT, F.lit(commit)), path, [COMMIT])
    part = spark.createDataFrame([_row_of(seen.get)], _PARTIAL)
    replace_partitions(part.withColumn(COMMIT, F.lit(commit)).coalesce(1), partials, [COMMIT])


def _row_of(seen: dict[str, object]) -> tuple[object, ...]:
    """Values in the order of the partial's columns; a sketch of no values is left out."""
    sketch = bytearray(seen["ratio_sketch"]) if seen["n_ratios"] else None
    return (*(seen[c] for c in ("n_docs", "n_ratios", "ratio_sum", "total_original",
                                "total_compressed")), sketch)


def merged_stats(partials: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The statistics of a collection from the partials of its commits: one small row for each
    commit is read, no document. ``ratio_quantiles`` are those of the merged sketches."""
    sums = partials.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        (F.sum("ratio_sum") / F.sum("n_ratios")).alias("avg_ratio"),
        F.sum("total_original").alias("total_original"),
        F.sum("total_compressed").alias("total_compressed"),
        F.sum("n_ratios").alias("n_ratios"),
        F.kll_merge_agg_double("ratio_sketch").alias("sketch"))
    at = F.array(*(F.lit(float(q)) for q in quantiles))
    return sums.select(
        "n_docs", "avg_ratio", "total_original", "total_compressed",
        size_ratio("total_original", "total_compressed").alias("overall_ratio"),
        F.when(F.col("n_ratios") > 0, F.kll_sketch_get_quantile_double("sketch", at))
        .alias("ratio_quantiles"))
