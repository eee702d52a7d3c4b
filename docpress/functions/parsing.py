"""Message frames and typed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed schema of a sensor reading; fields outside it stay in the raw text only.
SENSOR_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("pressure", T.DoubleType()),
    T.StructField("data_array", T.ArrayType(T.DoubleType())),
    T.StructField("metadata", T.StructType([
        T.StructField("location", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("quality", T.IntegerType()),
    ])),
])

CORRUPT_FIELD = "_corrupt_record"

# Where a frame came from: stable over replays, and unique.
FRAME_ID = "frame_id"


def decode_frames(frames: DataFrame) -> DataFrame:
    """``key`` and ``value`` bytes as text (``raw_value``), ``timestamp`` unchanged.

    A frame's own id, if its source gives one, comes along.
    """
    own_id = [FRAME_ID] if FRAME_ID in frames.columns else []
    return frames.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("raw_value"),
        F.col("timestamp"), *own_id,
    )


def frame_id(frames: DataFrame) -> Column:
    """Stable id of a decoded frame: its place in the source, or else a hash of it.

    Without a place, frames equal in key, time and value have one id.
    """
    if FRAME_ID in frames.columns:
        return F.col(FRAME_ID)
    return F.sha2(F.to_json(F.struct("key", F.unix_micros(F.col("timestamp").cast("timestamp"))
                                     .alias("time"), "raw_value")), 256)


def parse_json(text: Column | str, schema: T.StructType = SENSOR_SCHEMA) -> Column:
    """Permissive parse: what does not fit the schema becomes NULL."""
    return F.from_json(text, schema)


def corrupt_aware(text: Column | str, schema: T.StructType = SENSOR_SCHEMA) -> Column:
    """Like :func:`parse_json`, with the bad text kept in ``_corrupt_record``."""
    with_reject = T.StructType([*schema.fields, T.StructField(CORRUPT_FIELD, T.StringType())])
    return F.from_json(text, with_reject, {"columnNameOfCorruptRecord": CORRUPT_FIELD})
