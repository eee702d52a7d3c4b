"""zlib over Arrow batches, the one step Spark has no expression for.

Each factory returns a UDF whose function is nested, so it pickles by value and
workers need no copy of this package.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpress.functions.dictionary import Dictionary

ALGORITHM = "zlib"
# What a Python worker holds beside the Arrow batch that came in.
PIECE_BYTES = 2 * 1024 * 1024
MIN_LEVEL, MAX_LEVEL, DEFAULT_LEVEL = 1, 9, 9


def check_level(level: int) -> int:
    if isinstance(level, bool) or not isinstance(level, int) or not MIN_LEVEL <= level <= MAX_LEVEL:
        raise ValueError(f"compression level must be {MIN_LEVEL}..{MAX_LEVEL}, got {level!r}")
    return level


def _compressor(level: int, preset: bytes | None = None, piece_bytes: int = PIECE_BYTES):
    def packed(raw: bytes) -> bytes:
        if not preset:
            return zlib.compress(raw, level)
        coder = zlib.compressobj(level, zdict=preset)
        return coder.compress(raw) + coder.flush()

    @F.arrow_udf(T.BinaryType())
    def zlib_compress(texts: pa.Array) -> pa.Array:
        # A string array is UTF-8 already: view it as bytes, do not re-encode. Python holds
        # one text at a time, and compressed ones of a piece before they are in Arrow.
        blobs, done, some, size = texts.cast(pa.binary()), [], [], 0
        for row in range(len(blobs)):
            raw = blobs[row].as_py()
            some.append(packed(raw) if raw else None)
            size += len(some[-1]) if raw else 0
            if size >= piece_bytes:
                done.append(pa.array(some, pa.binary()))
                some, size = [], 0
        done.append(pa.array(some, pa.binary()))
        return pa.concat_arrays(done) if len(done) > 1 else done[0]

    return zlib_compress


def unpacker(data: str, kept: Sequence[str], batch_bytes: int, preset: bytes | None = None):
    """Function for ``mapInArrow``: the kept columns and the text of ``data``.

    It emits a batch as soon as its texts reach ``batch_bytes``, however many rows
    came in at once.
    """
    def opened(raw: bytes) -> bytes:
        if not preset:
            return zlib.decompress(raw)
        coder = zlib.decompressobj(zdict=preset)
        text = coder.decompress(raw)
        if not coder.eof:
            raise zlib.error("incomplete or truncated stream")
        return text

    def pieces(batch):
        columns = [batch.column(name) for name in kept]
        blobs = batch.column(data)
        texts, size, start = [], 0, 0
        for row in range(batch.num_rows):
            raw = blobs[row].as_py()
            text = opened(raw) if raw is not None else None
            texts.append(text)
            size += len(text) if text else 0
            if size >= batch_bytes or row == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays(
                    [c.slice(start, len(texts)) for c in columns]
                    + [pa.array(texts, pa.binary()).cast(pa.string())],
                    names=[*kept, "text"])
                texts, size, start = [], 0, row + 1

    def unpack_batches(batches):
        for batch in batches:
            yield from pieces(batch)
            # The next one is read before the name is bound anew.
            del batch

    return unpack_batches


def compress(text: Column | str, level: int = DEFAULT_LEVEL,
             dictionary: Dictionary | None = None) -> Column:
    """Compressed UTF-8 bytes of ``text``; NULL and empty text give NULL.

    What a ``dictionary`` was used for needs the same one to be unpacked.
    """
    return _compressor(check_level(level), dictionary.data if dictionary else None)(text)
