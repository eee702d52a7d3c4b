"""Row payload text, document ids and processing time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed format: full microseconds, so that no digit of a timestamp is lost.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

DEFAULT_ID = "id"

JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": TIMESTAMP_FORMAT,
    "timestampNTZFormat": TIMESTAMP_FORMAT,
}


def quoted(name: str) -> Column:
    """Top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_json(columns: Sequence[str]) -> Column:
    """One compact JSON object of the named columns; nulls and nesting are kept."""
    return F.to_json(F.struct(*[quoted(c) for c in columns]), JSON_OPTIONS)


def document_id(df: DataFrame, id_col: str | None = DEFAULT_ID) -> Column:
    """``id_col`` as text; a random UUID where it is NULL.

    Only the default column may be absent; any other name is taken as meant.
    """
    if id_col is None or (id_col == DEFAULT_ID and id_col not in df.columns):
        return F.uuid()
    if id_col not in df.columns:
        raise ValueError(f"no column {id_col!r} to take ids from; there are {df.columns}")
    return F.coalesce(quoted(id_col).cast("string"), F.uuid())


def timestamp_or_now(as_of: datetime | str | None = None) -> Column:
    """Processing time: ``as_of`` for reproducible runs, else the query's start."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
