"""How rows are spread over tasks and files."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpress.functions.parcels import parceller, unparcel
from docpress.sources.files import detect_format, input_inventory, read_table

TARGET_PARTITION_BYTES = 128 * 1024 * 1024
SHARDS, SHARD = "shards", "shard"
# What a row takes in a sort beside its columns: its pointers, its place, lengths and marks.
ROW_BYTES = 48

# Row groups of files that are few and so may be large: a scan splits them no further.
ROW_GROUP_BYTES = 32 * 1024 * 1024

# Tasks per core when the input is small: enough to even out long and short texts.
TASKS_PER_CORE = 2
# Expected growth of gzip input once it is read.
GZIP_EXPANSION = 10
# Beyond this many shuffle partitions the bookkeeping costs more than it gains. Tasks
# stream their rows, so larger ones cost time and no memory.
MAX_PARTITIONS = 200_000


def partitions_for_bytes(n_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Number of partitions of about ``target_bytes`` each, at least one."""
    return max(1, math.ceil(n_bytes / target_bytes))


def choose_partitions(inventory: Row, cores: int,
                      target_bytes: int = TARGET_PARTITION_BYTES) -> int | None:
    """Tasks to spread the rows over before compressing; None to keep the scan's.

    Compression streams row by row, so a task may be large; what counts is that
    every core has work. A scan with enough tasks is left alone: shuffling would
    only move the whole input. The shuffle pays where the scan has fewer tasks
    than the cluster has use for, or where one gzip file, which no second task
    can read, outweighs a core's fair share.
    """
    enough = cores * TASKS_PER_CORE
    narrow = inventory["scan_splits"] < enough
    lopsided = inventory["largest_gzip"] > max(target_bytes, inventory["n_bytes"] / cores)
    if not (narrow or lopsided):
        return None
    text_bytes = inventory["n_bytes"] + inventory["gzip_bytes"] * (GZIP_EXPANSION - 1)
    return min(max(partitions_for_bytes(text_bytes, target_bytes), enough), MAX_PARTITIONS)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Round-robin over ``partitions`` tasks, whatever the rows hold."""
    return df.repartition(partitions)


def read_spread(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Read a dataset for CPU-heavy work, spread only where its scan is too narrow."""
    inventory = input_inventory(spark, path).first()
    partitions = choose_partitions(inventory, spark.sparkContext.defaultParallelism)
    if "format" not in options:
        options["format"] = detect_format(spark, path, inventory)
    rows = read_table(spark, path, **options)
    return spread(rows, partitions) if partitions else rows


def write_files_of(rows: DataFrame, path: str, column: str) -> None:
    """Write as many Parquet files as the text ``column`` has values, in equal parts of the rows.

    A file is written by one task. Were it the file of one value, that task would read
    all rows of the commonest; here each reads the same share, whatever the values' shares,
    and reads it compressed: the fewer files, the larger a share is. NULL counts as no
    value. The values themselves pass through the driver, one for each file, like the
    files' names.
    """
    named = rows.select(column).distinct().where(F.col(column).isNotNull())
    starts = {row[0]: place for place, row in enumerate(named.collect())}
    if not starts:
        # Without rows there are no files either.
        rows.write.partitionBy(column).parquet(path)
        return
    dealt = rows.mapInArrow(parceller(column, starts, len(starts)), "place int, parcel binary")
    (dealt.repartitionById(len(starts), "place").select("parcel")
     .mapInArrow(unparcel(), rows.schema)
     .write.options(**{"maxRecordsPerFile": 0, "parquet.block.size": ROW_GROUP_BYTES}).parquet(path))


def planned_bytes(df: DataFrame) -> int:
    """Size of a stored table in bytes, as Spark's plan knows it from the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _bytes_in_memory(fields: T.StructType, parent: str = "") -> Column:
    """Bytes of a row while it is sorted: what varies in length as long as it is."""
    sizes = []
    for field in fields:
        name = f"{parent}`{field.name.replace('`', '``')}`"
        if isinstance(field.dataType, T.StructType):
            sizes.append(_bytes_in_memory(field.dataType, f"{name}."))
            continue
        sizes.append(F.lit(8))
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.VariantType)):
            sizes.append(F.octet_length(F.coalesce(F.col(name).cast("string"), F.lit(""))))
    return reduce(Column.__add__, sizes, F.lit(ROW_BYTES))


def partitions_to_sort(documents: DataFrame) -> int:
    """Partitions whose rows take about ``TARGET_PARTITION_BYTES`` each while they are sorted.

    Files say little about that: columns of few values are small in them. One narrow pass.
    """
    size = F.sum(_bytes_in_memory(documents.schema).cast("bigint"))
    return partitions_for_bytes(documents.agg(size).first()[0] or 0)


def write_by_metric(documents: DataFrame, path: str, metric: str, *,
                    partitions: int | None = None, id_col: str = "_id",
                    mode: str = "overwrite") -> None:
    """Rewrite a collection in descending order of ``metric``.

    Files then cover separate value ranges and a range read skips the others by
    their min/max. The id and the stored position break ties, so one value, or
    one document stored very often, still splits over several files.

    Give it stored documents: the position is stable only for a repeatable scan, and
    the number of files follows the size of the rows unless ``partitions`` fixes it.
    """
    position = "_position"
    partitions = partitions or partitions_to_sort(documents)
    order = [F.col(metric).desc(), F.col(id_col), F.col(position)]
    (documents.withColumn(position, F.monotonically_increasing_id())
     .repartitionByRange(partitions, *order)
     .sortWithinPartitions(*order)
     .drop(position)
     .write.mode(mode).parquet(path))


# Finest grid of the common layout: this many bits of rank for each metric.
MOST_RANK_BITS = 6


def _rank(metric: str, bounds: Sequence[object]) -> Column:
    """How many of the ascending ``bounds`` a value reaches; 0 without a value."""
    reached = [F.coalesce((F.col(metric) >= F.lit(b)).cast("int"), F.lit(0)) for b in bounds]
    return reduce(Column.__add__, reached, F.lit(0))


def write_by_metrics(documents: DataFrame, path: str, metrics: Sequence[str], *,
                     partitions: int | None = None, id_col: str = "_id",
                     mode: str = "overwrite") -> None:
    """Rewrite a collection in one order that serves range reads of each of ``metrics``.

    Each value becomes its rank among the quantiles of its metric, so that skewed metrics
    fill the grid evenly; the bits of the ranks are interleaved (Z-order), and rows are
    sorted by that address. A file covers a small box, and a range of any metric
    leaves out the files whose boxes it does not meet. The quantiles are one narrow pass;
    at most ``2 ** MOST_RANK_BITS`` of them for each metric reach the driver. With m
    metrics that know nothing of each other, n files part each metric in about n ** (1/m)
    (sizes and ratios, which go together, in more): few files serve few metrics.

    Ties are broken as in :func:`write_by_metric`, so one address splits over files.
    """
    address, position = "_address", "_position"
    partitions = partitions or partitions_to_sort(documents)
    bits = min(MOST_RANK_BITS, math.ceil(math.log2(max(partitions, 2)) / len(metrics)) + 2)
    cells = 1 << bits
    shares = [n / cells for n in range(1, cells)]
    bounds = documents.agg(*[F.percentile_approx(m, shares, 100 * cells).alias(m)
                             for m in metrics]).first()
    ranks = {f"_rank_{n}": _rank(m, bounds[m] or []) for n, m in enumerate(metrics)}
    parts = [F.shiftleft(F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1)).cast("long"),
                         bit * len(metrics) + n)
             for bit in range(bits) for n, name in enumerate(ranks)]
    order = [F.col(address), F.col(id_col), F.col(position)]
    (documents.withColumn(position, F.monotonically_increasing_id()).withColumns(ranks)
     .withColumn(address, reduce(Column.bitwiseOR, parts)).drop(*ranks)
     .repartitionByRange(partitions, *order)
     .sortWithinPartitions(*order)
     .drop(address, position)
     .write.mode(mode).parquet(path))


def store_bounds(spark: SparkSession, path: str, bounds_path: str, metrics: Sequence[str]) -> None:
    """Note for each file that has no bounds yet the least and greatest value of each metric.

    One narrow pass over the new files. After a collection is written anew, its bounds
    need a new path as well.
    """
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), *metrics)
    if spark._jvm.org.apache.hadoop.fs.Path(bounds_path).getFileSystem(
            spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(bounds_path)):
        files = files.join(spark.read.parquet(bounds_path).select("file"), "file", "left_anti")
    cells = [F.struct(F.count(m).alias("n"), F.min(m).alias("low"), F.max(m).alias("high")).alias(m)
             for m in metrics]
    files.groupBy("file").agg(*cells).write.mode("append").parquet(bounds_path)


def keyed_options(expected_ids: int, id_col: str = "_id") -> dict[str, str]:
    """Write options by which every file tells at once which ids it cannot hold.

    Parquet then keeps a Bloom filter of ``id_col`` for each row group, made for
    ``expected_ids`` of them (more only let more lookups through), and no dictionary, which
    ids that differ do not profit from. Any append can carry them, in any layout.
    """
    return {f"parquet.bloom.filter.enabled#{id_col}": "true",
            f"parquet.bloom.filter.expected.ndv#{id_col}": str(expected_ids),
            f"parquet.enable.dictionary#{id_col}": "false"}


def read_ids(spark: SparkSession, path: str, ids: Sequence[str], *, id_col: str = "_id") -> DataFrame:
    """Documents of a few ids, from a collection in any layout.

    Each id is a comparison that reaches the files, so row groups written with
    :func:`keyed_options` are left out by their filters, others by their bounds alone.
    """
    same = (F.col(id_col) == F.lit(i) for i in ids)
    return spark.read.parquet(path).where(reduce(Column.__or__, same, F.lit(False)))


def _shard_of(column: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(column), shards).cast("int")


def write_by_id_hash(documents: DataFrame, path: str, *, shards: int,
                     id_col: str = "_id", mode: str = "overwrite") -> None:
    """Write a collection so that each id lives in exactly one shard folder.

    The number of shards is part of the folder's name, so a reader need not know it
    and documents appended with another number are found as well.

    The rebalance hint shuffles by shard and lets AQE split a shard that is too
    large over several tasks and files, so a heavy id stalls no task.
    """
    number = F.lit(shards)
    (documents.withColumns({SHARDS: number, SHARD: _shard_of(F.col(id_col), number)})
     .hint("rebalance", SHARD)
     .write.mode(mode).partitionBy(SHARDS, SHARD).parquet(path))


def read_by_id(spark: SparkSession, path: str, ids: str | Sequence[str], *,
               id_col: str = "_id") -> DataFrame:
    """Documents of one id or of a few: only the ids' shard folders are read."""
    wanted = [ids] if isinstance(ids, str) else list(ids)
    rows = spark.read.parquet(path)
    folders = reduce(Column.__or__, (F.col(SHARD) == _shard_of(F.lit(i), F.col(SHARDS))
                                     for i in wanted), F.lit(False))
    return rows.where(folders).where(F.col(id_col).isin(wanted)).drop(SHARDS, SHARD)
