"""Rows and message frames into compressed documents.

Everything here is row-local: no shuffle, and one Arrow round trip for zlib.
Sizes are read off the compressed value, so each text is compressed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpress.functions.codec import (
    ALGORITHM, DEFAULT_LEVEL, PIECE_BYTES, check_level, compress, unpacker)
from docpress.functions.dictionary import Dictionary
from docpress.functions.parsing import (
    CORRUPT_FIELD, SENSOR_SCHEMA, corrupt_aware, decode_frames, frame_id, parse_json)
from docpress.functions.payload import document_id, row_json, timestamp_or_now
from docpress.functions.sizes import compressed_size, original_size, size_ratio

PROCESS_TIME = "process_timestamp"


def stamp(df: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Add the processing time to every row."""
    return df.withColumn(PROCESS_TIME, timestamp_or_now(as_of))


def tag_batch(df: DataFrame, batch_id: int | Column) -> DataFrame:
    """Add ``batch_id``: a micro-batch number, or an expression that yields one."""
    value = batch_id if isinstance(batch_id, Column) else F.lit(batch_id)
    return df.withColumn("batch_id", value.cast("bigint"))


def batch_documents(df: DataFrame, *, level: int = DEFAULT_LEVEL, id_col: str | None = "id",
                    as_of: datetime | str | None = None,
                    dictionary: Dictionary | None = None) -> DataFrame:
    """One document per row: the whole row as JSON, compressed, with its metrics.

    With a ``dictionary`` its id is in the metadata.
    """
    check_level(level)
    payload = df.select(
        document_id(df, id_col).alias("_id"),
        row_json(df.columns).alias("payload"),
    )
    packed = payload.withColumn("data", compress("payload", level, dictionary))
    sized = packed.select(
        "_id",
        original_size("payload").alias("original_size"),
        compressed_size("data").alias("compressed_size"),
        "data",
    )
    return sized.select(
        "_id", "original_size", "compressed_size",
        size_ratio("original_size", "compressed_size").alias("compression_ratio"),
        "data",
        F.struct(
            timestamp_or_now(as_of).alias("timestamp"),
            F.lit(level).alias("compression_level"),
            F.lit(ALGORITHM).alias("algorithm"),
            *([F.lit(dictionary.id).alias("dictionary")] if dictionary else []),
        ).alias("metadata"),
    )


def frame_documents(frames: DataFrame, *, schema: T.StructType = SENSOR_SCHEMA,
                    level: int = DEFAULT_LEVEL, size_unit: str = "bytes",
                    as_of: datetime | str | None = None) -> DataFrame:
    """One document per message: the parsed view beside the compressed raw text.

    ``_id`` is the frame's place in its source or a hash of it, so that a store
    which is given a replayed batch writes over what it has.

    The same function serves batch frames and micro-batches.
    """
    decoded = decode_frames(frames)
    packed = decoded.withColumn("compressed_data", compress("raw_value", level))
    sized = packed.select(
        frame_id(decoded).alias("_id"), "key",
        parse_json("raw_value", schema).alias("data"),
        "timestamp", "compressed_data",
        original_size("raw_value", size_unit).alias("original_size"),
        compressed_size("compressed_data").alias("compressed_size"),
    )
    with_ratio = sized.withColumn(
        "compression_ratio", size_ratio("original_size", "compressed_size"))
    return stamp(with_ratio, as_of)


def unpack(documents: DataFrame, columns: Sequence[str], *, data: str = "data",
           text: str = "payload", batch_bytes: int = PIECE_BYTES,
           dictionary: Dictionary | None = None) -> DataFrame:
    """The named columns and the text that ``data`` holds, whatever its ratio.

    Texts leave the Python worker in batches of about ``batch_bytes``, so a batch
    of small payloads may grow into any number of large texts. Documents that were
    packed with a ``dictionary`` need the same one; others may lie among them.
    """
    preset = dictionary.data if dictionary else None
    kept = documents.select(*columns, F.col(data))
    fields = [kept.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField("text", T.StringType())])
    rows = kept.mapInArrow(unpacker(data, list(columns), batch_bytes, preset), schema)
    return rows.withColumnRenamed("text", text)


def classify_frames(frames: DataFrame, schema: T.StructType = SENSOR_SCHEMA) -> DataFrame:
    """Parsed frames with ``corrupt_record``: the text that did not fit, or NULL.

    A missing or empty value is no misfit: it parses to a NULL ``data``. Each
    text is parsed once; write this frame, or a part of it, in one pass.
    """
    tried = decode_frames(frames).withColumn("parsed", corrupt_aware("raw_value", schema))
    return tried.select(
        "key", "raw_value", F.col("parsed").dropFields(CORRUPT_FIELD).alias("data"), "timestamp",
        F.col(f"parsed.{CORRUPT_FIELD}").alias("corrupt_record"))


def split_rejects(frames: DataFrame, schema: T.StructType = SENSOR_SCHEMA
                  ) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) frames; each of the two parses its input anew."""
    classified = classify_frames(frames, schema)
    bad = F.col("corrupt_record").isNotNull()
    return (classified.where(~bad).drop("corrupt_record"),
            classified.where(bad).select("key", "timestamp", "corrupt_record"))
