"""What the operators of this package share: keys, scratch tables, Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.scratch import scratch_path

# Documents without an id come after all others and count as one document.
LAST_ID = 9223372036854775807


def order_id(column: Column | str) -> Column:
    """An id to group, join and order by: NULL is the last of all."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(LAST_ID))


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the cluster's shared scratch folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Marks to leave out are broadcast if they take less than this, else joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def row_mark(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row: what tells rows of one id, or of none, apart."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def by_row(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the mark of each row in the place of its id."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != id_col]
    return docs.select(row_mark(docs).alias(id_col), *others)


def without(docs: DataFrame, gone: DataFrame, mark: Column) -> DataFrame:
    """``docs``, all columns, without the rows whose ``mark`` is in ``gone`` (column ``key``).

    The marks are counted first: few of them spare the texts a shuffle.
    """
    marks = stored(gone.select("key").distinct(), "gone")
    few = marks.count() * 16 <= BROADCAST_BYTES
    side = F.broadcast(marks) if few else marks
    return docs.join(side, mark == marks["key"], "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """A value that lives as long as the Python worker, not only for one task.

    Functions of this package reach the workers by value, with copies of their
    modules' globals; what is to outlive a task hangs on the interpreter.
    """
    home = sys.modules.setdefault("_docpress_worker", types.ModuleType("_docpress_worker"))
    if name not in vars(home):
        setattr(home, name, make())
    return vars(home)[name]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``max_bytes`` of text at most.

    A text is never cut, so one longer text makes a slice of its own.
    """
    for batch in batches:
        column = batch.column(text)
        sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > max_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


# Size of a filter that every worker gets: this many bits for each value, and never more
# than 2**27 bits (16 MB). A fuller filter lets more through; it never loses a value.
FILTER_BITS_EACH = 32
FILTER_BITS_MOST = 27


def bitmap(values: DataFrame):
    """Broadcast bitmap of the longs in the only column; Spark sets the bits."""
    name = values.columns[0]
    wanted = max(1, values.count() * FILTER_BITS_EACH)
    power = min(FILTER_BITS_MOST, max(12, (wanted - 1).bit_length()))
    bit = F.col(name).bitwiseAND(F.lit((1 << power) - 1).cast("long"))
    rows = (values.select(F.shiftright(bit, 6).alias("word"),
                          F.call_function("shiftleft", F.lit(1).cast("long"),
                                          bit.bitwiseAND(F.lit(63).cast("long")).cast("int"))
                          .alias("set"))
            .groupBy("word").agg(F.bit_or("set").alias("set")).toArrow())
    table = np.zeros(1 << power - 6, np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("set").to_numpy().view(np.uint64)
    return values.sparkSession.sparkContext.broadcast(table)


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a :func:`bitmap` may hold."""
    bits = hashes & np.uint64(64 * len(table) - 1)
    return (table[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))
            & np.uint64(1)).astype(bool)
