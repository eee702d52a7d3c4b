"""Column expressions: sizes, payload text, parsing, codec."""

from docpress.functions.codec import compress
from docpress.functions.parsing import SENSOR_SCHEMA, corrupt_aware, decode_frames, parse_json
from docpress.functions.payload import document_id, row_json, timestamp_or_now
from docpress.functions.sizes import compressed_size, original_size, size_ratio

__all__ = [
    "SENSOR_SCHEMA", "compress", "compressed_size", "corrupt_aware", "decode_frames",
    "document_id", "original_size", "parse_json", "row_json",
    "size_ratio", "timestamp_or_now",
]
