"""Rows on their way through a shuffle: many of them at once, compressed.

Functions for ``mapInArrow``, nested like those of the codec, so workers need no copy
of this package.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa

LEVEL = 6


def parceller(column: str, starts: Mapping[object, int], places: int, level: int = LEVEL):
    """Deal rows round over ``places`` and give for each place of a batch one parcel.

    In each task the rows of a value of ``column`` begin at the place that ``starts`` names,
    so each of these places gets a row wherever the value occurs.
    """
    def deal(batches):
        after = {}
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
        for batch in batches:
            dealt = {}
            for row, value in enumerate(batch.column(column).to_pylist()):
                place = after.get(value, starts.get(value, 0))
                dealt.setdefault(place, []).append(row)
                after[value] = (place + 1) % places
            for place, rows in dealt.items():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(batch.take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["place", "parcel"])
                del sink
            # The next one is read before the name is bound anew.
            del batch

    return deal


def unparcel(name: str = "parcel"):
    """The rows of parcels, one batch for each."""
    def opened(batches):
        for batch in batches:
            for parcel in batch.column(name):
                yield from pa.ipc.open_stream(parcel.as_buffer())
            del batch

    return opened
