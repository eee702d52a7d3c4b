"""Records into keyed message frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docpress.functions.payload import row_json
from docpress.scratch import scratch_path

_TIE = "_tie"


def with_positions(df: DataFrame, order_by: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of ``order_by``.

    A single global window would pull every row into one task. Here the rows are
    sorted by range into files, each file's rows are numbered where they lie and
    shifted by the sizes of the files before it. The only un-partitioned window
    runs over one row per written file. Rows that tie keep their input order, and
    however many tie they still split over several ranges.

    The input must be repeatable, such as a stored table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "positions")
    # One file per sort range; its name starts with the number of the range.
    (df.withColumn(_TIE, F.monotonically_increasing_id()).orderBy(*order_by, _TIE).drop(_TIE)
     .write.option("maxRecordsPerFile", 0).parquet(path))
    stored = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = stored.groupBy("_file").agg(F.count("*").alias("_rows"))
    before = Window.orderBy(_range_number("_file")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(
        "_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # At most spark.sql.shuffle.partitions rows, one per sort range.
    return (stored.join(F.broadcast(offsets), "_file")
            .withColumn(name, F.col("_offset") + F.col("_index"))
            .drop("_file", "_index", "_offset"))


def _range_number(file_name: str) -> Column:
    return F.regexp_extract(file_name, r"^part-(\d+)", 1).cast("int")


_ROW = "_row"


def publish_ordered(records: DataFrame, order_by: Sequence[str], *,
                    key_col: str = "sensor_id") -> DataFrame:
    """:func:`publish_frames` of records whose place is that in ``order_by``.

    Only records without a key need their place. All are numbered by their order
    columns alone; records without a key then fetch their number, and those with one
    are not shuffled. The input must be repeatable, such as a stored table.
    """
    named = records.withColumn(_ROW, F.monotonically_increasing_id())
    missing = F.col(key_col).isNull()
    numbers = with_positions(
        named.select(*order_by, _ROW, missing.alias("_missing")), order_by)
    wanted = numbers.where("_missing").select(_ROW, "position")
    keyed = named.where(~missing).withColumn("position", F.lit(None).cast("bigint"))
    keyless = named.where(missing).join(wanted, _ROW)
    rows = keyed.unionByName(keyless).drop(_ROW)
    return publish_frames(rows, key_col=key_col)


def publish_frames(records: DataFrame, *, key_col: str = "sensor_id",
                   position_col: str = "position") -> DataFrame:
    """``key``/``value`` frames: the key column, or ``default_<position>`` where it
    is missing, beside the whole record (without its position) as JSON.

    ``position_col`` is the record's place in its batch: a column the table has,
    or the one :func:`with_positions` adds.
    """
    default = F.concat(F.lit("default_"), F.col(position_col).cast("string"))
    key = F.col(key_col).cast("string") if key_col in records.columns else F.lit(None).cast("string")
    value = row_json([c for c in records.columns if c != position_col])
    return records.select(
        F.coalesce(key, default).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
    )


def publish_options(servers: str, topic: str) -> dict[str, str]:
    """Options of Spark's Kafka sink: compressed, and acknowledged by all replicas."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.compression.type": "gzip",
        "kafka.acks": "all",
    }


def write_frames(frames: DataFrame, path: str | None = None, *, format: str = "kafka",
                 **options: object) -> None:
    """Append frames to a topic (:func:`publish_options`), or to files for replay."""
    frames.write.format(format).mode("append").options(**options).save(path)
