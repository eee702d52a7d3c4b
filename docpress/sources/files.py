"""Batch inputs: Parquet, JSON lines (plain or gzip) and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File suffix -> reader format; ``.gz`` may follow json and csv.
FORMATS = {"parquet": "parquet", "json": "json", "csv": "csv"}
_SUFFIX = r"\.(parquet|json|csv)(?:\.gz)?$"


def _listing(spark: SparkSession, path: str) -> DataFrame:
    # Only listing columns are read, never file content. Spark packs files into
    # tasks by their size, which for a listing would mean one trivial task per
    # 128 MB of input; coalesce folds those into a few tasks per core.
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length"))
    return files.coalesce(4 * spark.sparkContext.defaultParallelism)


def input_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many files lie under ``path`` and how large they are.

    ``scan_splits`` is the number of tasks a scan can use at 128 MB each; a gzip
    file can only be read by one, so the largest of them is reported too.
    """
    split_bytes = 128 * 1024 * 1024
    gzipped = F.col("path").endswith(".gz")
    suffix = F.regexp_extract(F.lower("path"), _SUFFIX, 1)
    splits = F.when(gzipped, 1).otherwise(F.greatest(F.ceil(F.col("length") / split_bytes), F.lit(1)))
    return _listing(spark, path).agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum(F.when(gzipped, F.col("length"))), F.lit(0)).alias("gzip_bytes"),
        F.coalesce(F.max(F.when(gzipped, F.col("length"))), F.lit(0)).alias("largest_gzip"),
        F.coalesce(F.sum(splits), F.lit(0)).cast("bigint").alias("scan_splits"),
        # At most one entry per known format.
        F.sort_array(F.collect_set(F.nullif(suffix, F.lit("")))).alias("formats"),
    )


def detect_format(spark: SparkSession, path: str, inventory: Row | None = None) -> str:
    """Reader format from the path's suffix, else from the files inside it.

    A folder whose files carry no known suffix is taken as Parquet. Pass the
    folder's inventory, if there is one, to save listing it again.
    """
    name = path.rstrip("/").lower().removesuffix(".gz")
    suffix = name.rsplit(".", 1)[-1]
    if suffix in FORMATS:
        return FORMATS[suffix]
    found = (inventory or input_inventory(spark, path).first())["formats"]
    if len(found) > 1:
        raise ValueError(f"{path} mixes {found} files; pass format=")
    return FORMATS[found[0]] if found else "parquet"


def read_table(spark: SparkSession, path: str, *, format: str | None = None,
               schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """Read a dataset, choosing the reader by suffix unless ``format`` is given.

    Pass ``schema`` for JSON and CSV at scale: without it Spark reads the input
    once more to infer types.
    """
    chosen = format or detect_format(spark, path)
    reader = spark.read.format(chosen)
    if chosen == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)
