from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docpress.operators.documents import frame_documents
import docpress.operators.publish as publish
from docpress.operators.publish import (
    publish_frames, publish_options, publish_ordered, with_positions, write_frames)


def test_positions_follow_the_order(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    numbered = with_positions(rows, ["h"]).collect()
    expected = {r["id"]: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: r["h"]))}
    assert {r["id"]: r["position"] for r in numbered} == expected


def test_positions_with_a_common_order_value_are_still_unique(spark):
    rows = spark.range(300).select(F.lit(1).alias("same"), "id")
    assert sorted(r["position"] for r in with_positions(rows, ["same"]).collect()) == list(range(300))


@pytest.fixture
def many_ranges(spark, monkeypatch, at):
    """Keep every sort range, however small, and put the sorted files in sight."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(publish, "scratch_path", lambda _, label: at(label))
    spark.conf.set(name, "false")
    yield at("positions")
    spark.conf.set(name, "true")


def test_positions_run_on_across_files(spark, many_ranges):
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"), "id")
    found = with_positions(rows, ["h"]).orderBy("position").collect()
    assert spark.read.parquet(many_ranges).select("_metadata.file_name").distinct().count() > 1
    assert [r["position"] for r in found] == list(range(1000))
    assert [r["h"] for r in found] == sorted(r["h"] for r in found)


def test_a_common_order_value_splits_over_ranges(spark, many_ranges, at):
    spark.range(4000).select(F.lit(1).alias("same"), "id").repartition(4).write.parquet(at("in"))
    numbered = with_positions(spark.read.parquet(at("in")), ["same"])
    assert sorted(r["position"] for r in numbered.collect()) == list(range(4000))
    per_file = spark.read.parquet(many_ranges).groupBy("_metadata.file_name").count().collect()
    assert len(per_file) > 1 and max(r["count"] for r in per_file) < 2000


def test_positions_of_no_rows(spark):
    assert with_positions(spark.range(0), ["id"]).count() == 0


def test_key_is_the_sensor_or_the_position(spark):
    records = spark.createDataFrame([("s1", 1.0, 0), (None, 2.0, 1)],
                                    "sensor_id string, temperature double, position bigint")
    rows = {bytes(r["key"]).decode(): json.loads(bytes(r["value"])) for r in publish_frames(records).collect()}
    assert rows == {"s1": {"sensor_id": "s1", "temperature": 1.0},
                    "default_1": {"sensor_id": None, "temperature": 2.0}}


def test_records_without_a_key_column(spark):
    frames = publish_frames(spark.range(2).withColumn("position", F.col("id")), key_col="sensor_id")
    assert sorted(bytes(r["key"]).decode() for r in frames.collect()) == ["default_0", "default_1"]


def test_published_frames_can_be_ingested(spark, at):
    records = spark.createDataFrame([("s1", 21.5, 0)], "sensor_id string, temperature double, position int")
    frames = publish_frames(records).withColumn("timestamp", F.current_timestamp())
    write_frames(frames, at("frames"), format="parquet")
    stored = spark.read.parquet(at("frames"))
    assert tuple(frame_documents(stored).select("key", "data.temperature").first()) == ("s1", 21.5)


def test_publish_options():
    assert publish_options("b:1", "t") == {
        "kafka.bootstrap.servers": "b:1", "topic": "t",
        "kafka.compression.type": "gzip", "kafka.acks": "all"}


def test_only_order_columns_are_sorted(spark, at):
    rows = [(f"s{i}" if i % 3 else None, i, "wide" * 50) for i in range(90)]
    spark.createDataFrame(rows, "sensor_id string, n long, wide string").write.parquet(at("in"))
    records = spark.read.parquet(at("in"))
    frames = publish_ordered(records, ["n"])
    found = {r[0] for r in frames.select(F.col("key").cast("string")).collect()}
    assert found == {f"s{i}" if i % 3 else f"default_{i}" for i in range(90)}
    values = {r[0] for r in frames.select(F.col("value").cast("string")).collect()}
    assert values == {r[0] for r in records.select(F.to_json(
        F.struct("*"), {"ignoreNullFields": "false"})).collect()}
