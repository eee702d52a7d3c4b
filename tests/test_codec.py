from __future__ import annotations

import inspect
import subprocess
import sys
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docpress.functions import codec
from docpress.functions.codec import compress
from docpress.operators.documents import unpack
from docpress.operators import unpack
from docpress.functions.sizes import compressed_size, original_size, size_ratio
from tests.plans import physical

TEXTS = ["", "a", "not json", "aé漢😀", "x" * 5000, "\x00\n\t\"\\", None]


@pytest.mark.parametrize("level", [1, 6, 9])
def test_bytes_are_those_of_zlib(spark, level):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for text, data in df.select("text", compress("text", level).alias("data")).collect():
        expected = zlib.compress(text.encode(), level) if text else None
        assert (bytes(data) if data is not None else None) == expected


@pytest.mark.parametrize("level", [0, 10, -1, 1.5, True, None, "9"])
def test_other_levels_are_refused(level):
    with pytest.raises(ValueError, match="compression level"):
        compress("text", level)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"]), min_size=1), min_size=1,
                      max_size=30),
       level=st.integers(1, 9))
def test_round_trip_of_any_text(spark, texts, level):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    packed = df.withColumn("data", compress("text", level)).withColumnRenamed("text", "given")
    rows = (unpack(packed.withColumn("c", compressed_size("data")), ["given", "c"], text="back")
            .select("given", "back", original_size("given").alias("o"), "c").collect())
    for text, back, original, compressed in rows:
        assert back == text
        assert original == len(text.encode())
        assert compressed == len(zlib.compress(text.encode(), level))


def test_missing_and_empty_text_have_size_zero_and_no_ratio(spark):
    df = spark.createDataFrame([(None,), ("",), ("ab",)], "text string")
    sized = df.select(compress("text").alias("data"), "text").select(
        "data", original_size("text").alias("o"), compressed_size("data").alias("c"))
    rows = sized.withColumn("r", size_ratio("o", "c")).collect()
    assert [tuple(r) for r in rows[:2]] == [(None, 0, 0, None)] * 2
    assert rows[2]["r"] == 2 / len(zlib.compress(b"ab", 9))


def test_size_units(spark):
    row = spark.createDataFrame([("aé漢",)], "t string").select(
        original_size("t").alias("b"), original_size("t", "chars").alias("c")).first()
    assert tuple(row) == (6, 3)
    with pytest.raises(ValueError, match="size unit"):
        original_size("t", "words")


@pytest.mark.parametrize("udf, value, expected", [
    (codec._compressor(9), "ab", zlib.compress(b"ab", 9)),
])
def test_worker_needs_no_copy_of_the_package(tmp_path, udf, value, expected):
    worker = """
import pickle, sys
import pyarrow as pa
function, value, expected = pickle.loads(sys.stdin.buffer.read())
assert function(pa.array([value])).to_pylist() == [expected]
assert not [m for m in sys.modules if m.startswith("docpress")]
"""
    done = subprocess.run([sys.executable, "-c", worker], cwd=tmp_path, capture_output=True,
                          input=cloudpickle.dumps((udf.func, value, expected)), timeout=120)
    assert done.returncode == 0, done.stderr.decode()


def test_sizes_do_not_compress_again(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("t"))
    plan = physical(df.withColumn("z", compress("t")).select(
        "z", compressed_size("z").alias("c"), size_ratio(original_size("t"), compressed_size("z"))))
    assert plan.count("ArrowEvalPython [") == 1
    assert plan.count("zlib_compress(") == 1


def test_unpacked_batches_are_bounded_by_their_texts():
    texts = ["x" * 1000, None, "é" * 10, "y" * 5000, "z" * 10, "w"]
    batch = pa.RecordBatch.from_pydict({
        "_id": list(range(6)), "data": [t and zlib.compress(t.encode()) for t in texts]})
    batches = list(codec.unpacker("data", ["_id"], 2000)(iter([batch, batch.slice(0, 0), batch])))
    rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
    assert rows == [(i, t) for i, t in enumerate(texts)] * 2
    assert [b.num_rows for b in batches] == [4, 2, 4, 2]


def test_unpack_returns_every_text(spark):
    df = spark.range(200).select(
        F.col("id").cast("string").alias("_id"), F.struct("id").alias("nested"),
        F.when(F.col("id") % 7 > 0, F.repeat(F.lit("é"), F.col("id").cast("int"))).alias("t"))
    packed = df.withColumn("data", compress("t"))
    rows = unpack(packed, ["_id", "nested"], text="t", batch_bytes=500).collect()
    assert {r["_id"]: r["t"] for r in rows} == {
        str(i): "é" * i if i % 7 else None for i in range(200)}
    assert all(r["nested"]["id"] == int(r["_id"]) for r in rows)


def test_the_codec_holds_little_beside_its_batch():
    """Arrow gets compressed texts in pieces, and unpacked ones leave in pieces."""
    texts = pa.array([f"{n} " + "text of some length " * 5_000 for n in range(400)])
    packed = codec._compressor(1).func(texts)
    assert [zlib.decompress(b).decode() for b in packed.to_pylist()] == texts.to_pylist()
    tracemalloc.start()
    codec._compressor(1).func(texts)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    batch = pa.RecordBatch.from_pydict({"_id": list(range(400)), "data": packed})
    sizes = [b.nbytes for b in codec.unpacker("data", ["_id"], codec.PIECE_BYTES)(iter([batch]))]
    assert len(sizes) > 10 and max(sizes) < 4 << 20
    default = inspect.signature(unpack).parameters["batch_bytes"].default
    assert default == codec.PIECE_BYTES
