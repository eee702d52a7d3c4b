"""Readers: files, stored collections, message streams."""

from docpress.sources.collection import read_collection
from docpress.sources.files import detect_format, input_inventory, read_table
from docpress.sources.messages import file_frames, message_options, message_stream

__all__ = [
    "detect_format", "file_frames", "input_inventory", "message_options",
    "message_stream", "read_collection", "read_table",
]
