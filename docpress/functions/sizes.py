"""Size metrics as JVM expressions; a missing value has size 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_UNITS = {"bytes": F.octet_length, "chars": F.char_length}


def original_size(text: Column | str, unit: str = "bytes") -> Column:
    """Size of a text in UTF-8 bytes, or in characters with ``unit="chars"``."""
    if unit not in SIZE_UNITS:
        raise ValueError(f"size unit must be one of {sorted(SIZE_UNITS)}, got {unit!r}")
    return F.coalesce(SIZE_UNITS[unit](text), F.lit(0)).cast("bigint")


def compressed_size(data: Column | str) -> Column:
    """Bytes of an already compressed value; nothing is compressed again."""
    return F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint")


def size_ratio(original: Column | str, compressed: Column | str) -> Column:
    """original / compressed, NULL where the compressed size is 0."""
    as_double = [F.col(c) if isinstance(c, str) else c for c in (original, compressed)]
    return F.try_divide(*[c.cast("double") for c in as_double])
