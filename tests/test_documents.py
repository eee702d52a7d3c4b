from __future__ import annotations

import datetime as dt
import json
import uuid
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docpress.functions.payload import document_id, row_json
from docpress.operators.documents import batch_documents, frame_documents, stamp, tag_batch, unpack
from tests.plans import physical

AS_OF = "2024-02-01 12:34:56.000789"


def test_payload_keeps_nulls_nesting_and_micros(spark):
    df = spark.sql("""select 1 as id, cast(null as string) as gone,
        named_struct('t', 2.5D, 'u', cast(null as int)) as nested, array('é', null) as list,
        map('m', 1) as m, timestamp_ntz'2024-01-02 03:04:05.000006' as at,
        cast(1.50 as decimal(4,2)) as price, date'2024-01-02' as day""")
    payload = df.select(row_json(df.columns)).first()[0]
    assert payload == ('{"id":1,"gone":null,"nested":{"t":2.5,"u":null},"list":["é",null],'
                       '"m":{"m":1},"at":"2024-01-02 03:04:05.000006","price":1.50,'
                       '"day":"2024-01-02"}')


def test_column_names_are_taken_literally(spark):
    df = spark.sql("select 1 as `a.b`, 2 as `c``d`")
    assert df.select(row_json(df.columns)).first()[0] == '{"a.b":1,"c`d":2}'


def test_id_is_text_or_a_random_uuid(spark):
    df = spark.createDataFrame([(7, "x"), (None, "y")], "id int, v string")
    ids = [r[0] for r in df.orderBy("v").select(document_id(df)).collect()]
    assert ids[0] == "7" and uuid.UUID(ids[1])
    no_id = df.drop("id")
    found = {r[0] for r in no_id.select(document_id(no_id)).collect()}
    assert len(found) == 2 and all(uuid.UUID(i) for i in found)


def test_document_fields(spark):
    rows = stamp(spark.createDataFrame([(1, "x" * 100), (2, "é")], "id int, v string"), AS_OF)
    documents = batch_documents(rows, level=3, as_of=AS_OF)
    assert dict(documents.dtypes) == {
        "_id": "string", "original_size": "bigint", "compressed_size": "bigint",
        "compression_ratio": "double", "data": "binary",
        "metadata": "struct<timestamp:timestamp,compression_level:int,algorithm:string>"}
    for row in documents.collect():
        raw = zlib.decompress(bytes(row["data"]))
        record = json.loads(raw)
        assert str(record["id"]) == row["_id"]
        assert record["process_timestamp"] == AS_OF
        assert row["original_size"] == len(raw)
        assert bytes(row["data"]) == zlib.compress(raw, 3)
        assert row["compression_ratio"] == len(raw) / row["compressed_size"]
        assert row["metadata"] == Row(timestamp=dt.datetime.fromisoformat(AS_OF),
                                      compression_level=3, algorithm="zlib")


def test_documents_of_an_empty_table(spark):
    assert batch_documents(spark.createDataFrame([], "id int, v string")).count() == 0


def test_stamp_uses_the_clock_unless_told(spark):
    row = stamp(spark.range(1)).select(
        (F.current_timestamp() - F.col("process_timestamp") < F.expr("interval 1 hour"))).first()
    assert row[0]


def test_batch_id_is_a_number_or_an_expression(spark):
    df = spark.range(4)
    assert {r["batch_id"] for r in tag_batch(df, 3).collect()} == {3}
    assert dict(tag_batch(df, 3).dtypes)["batch_id"] == "bigint"
    assert {r["batch_id"] for r in tag_batch(df, F.col("id") % 2).collect()} == {0, 1}


@pytest.mark.parametrize("make", [
    lambda df: batch_documents(df, id_col="key"),
    lambda df: frame_documents(df),
])
def test_one_pass_without_a_shuffle(spark, make):
    frames = spark.range(5).select(
        F.col("id").cast("string").cast("binary").alias("key"),
        F.lit("{}").cast("binary").alias("value"), F.current_timestamp().alias("timestamp"))
    plan = physical(make(frames))
    assert plan.count("ArrowEvalPython [") == 1
    assert "Exchange" not in plan


def test_only_the_default_id_column_may_be_absent(spark):
    with pytest.raises(ValueError, match="no column 'ide'"):
        document_id(spark.range(1), "ide")


def test_batch_and_stream_agree_on_payload_bytes(spark):
    frames = spark.createDataFrame([(bytearray(b"k"), bytearray('{"temperature": 1.5}'.encode()),
                                     dt.datetime(2024, 1, 1))],
                                   "key binary, value binary, timestamp timestamp")
    row = unpack(frame_documents(frames), ["key", "data"], data="compressed_data").select(
        "key", "data.temperature", "payload").first()
    assert tuple(row) == ("k", 1.5, '{"temperature": 1.5}')
