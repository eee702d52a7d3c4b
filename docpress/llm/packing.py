"""Packing by power-of-two decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docpress.llm.common import narrow, slices, worker_cache
from docpress.llm.tokens import Encoder

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 1024
END_ID = 0

# Bytes of text encoded at once; a worker keeps for good what its largest slice took.
TEXT_AT_ONCE = 1 << 19

# A sequence id is its length class, then the task, then a running number.
_TASK_BITS, _NUMBER_BITS = 24, 34

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def piece_lengths(tokens: int, size: int) -> list[int]:
    """``tokens`` as whole sequences of ``size``, then its remaining binary digits."""
    whole, rest = divmod(tokens, size)
    return [size] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _packer(path: str, size: int, end_id: int):
    end = np.array([end_id], "<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder {path}", lambda: Encoder(path))
        task = TaskContext.get().partitionId() << _NUMBER_BITS
        numbers = [0] * size.bit_length()
        for batch in slices(batches, max_bytes=TEXT_AT_ONCE):
            ids, ends = encoder.encode(batch.column("text"))
            rows = []
            for n, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                tokens = np.append(ids[ends[n]:ends[n + 1]].astype("<u4"), end).tobytes()
                total, start = len(tokens) // 4, 0
                for length in piece_lengths(total, size):
                    kind = length.bit_length() - 1
                    rows.append((doc_id, start, length, tokens[4 * start:4 * (start + length)],
                                 total, kind << _TASK_BITS + _NUMBER_BITS | task | numbers[kind],
                                 0))
                    numbers[kind] += 1
                    start += length
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)]
            yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.fieldNames())

    return pack


_ARROW = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in SCHEMA]


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   tokenizer: str | None = None, size: int = SEQUENCE_TOKENS,
                   end_id: int = END_ID) -> DataFrame:
    """Token sequences of power-of-two lengths up to ``size``, each from one document.

    A document's ids and ``end_id`` are cut into whole sequences of ``size`` and one
    piece for each binary digit of what is left, longest first. Every piece is a
    sequence of its own (``offset`` 0), so none crosses documents and none is
    padded. The leading bits of ``sequence_id`` are the length class: sequences of
    one length form one bucket, a range of ids. Batches drawn from one bucket have
    equal lengths.

    One pass over the texts, without a shuffle: memory is bounded by a slice of
    texts, and a task that is run again makes the same rows. ``ids`` holds
    little-endian unsigned 32-bit ids; ``size`` is a power of two. ``tokenizer`` is
    a path that every executor can open; a public tokenizer's if none is given.

    NULL and empty text: one piece, the end id alone. Rows are packed one by one:
    repeated rows and NULL ids stay as they are. Other columns are not carried. An
    empty table gives no rows.
    """
    if size < 1 or size & (size - 1):
        raise ValueError(f"size must be a power of two, got {size}")
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    return narrow(docs, id_col, text_col).mapInArrow(_packer(path, size, end_id), SCHEMA)
