from __future__ import annotations

import pytest

from docpress.__main__ import main, output_options, parser, stream_options
from docpress.errors import QualityGateError


def test_defaults():
    batch = parser().parse_args(["batch", "--input-path", "in", "--output-path", "out"])
    assert (batch.compression_level, batch.partitions, batch.id_col) == (9, None, "id")
    stream = parser().parse_args(["stream", "--output-path", "out", "--checkpoint-dir", "s3a://b/c"])
    assert (stream.kafka_servers, stream.topic) == ("kafka:9092", "data-feed")
    with pytest.raises(SystemExit):
        parser().parse_args(["stream", "--output-path", "out"])


def test_stream_command_passes_its_options_on():
    given = stream_options(parser().parse_args([
        "stream", "--checkpoint-dir", "c", "--output-format", "mongodb", "--output-option",
        "database=db", "--starting-offsets", "latest", "--max-offsets-per-trigger", "7",
        "--min-partitions", "40", "--no-fail-on-data-loss", "--compression-level", "3",
        "--partitions", "12", "--trigger-seconds", "5"]))
    assert given["source_options"] == {
        "starting_offsets": "latest", "max_offsets_per_trigger": 7, "min_partitions": 40,
        "fail_on_data_loss": False}
    assert (given["level"], given["partitions"], given["trigger_seconds"]) == (3, 12, 5)
    assert (given["output_format"], given["output_options"]["database"]) == ("mongodb", "db")


def test_batch_size_is_for_document_stores():
    batch = ["batch", "--input-path", "in"]
    store = ["--output-format", "mongodb", "--output-option", "database=db", "--batch-size", "50"]
    assert output_options(parser().parse_args(batch)) == {}
    assert output_options(parser().parse_args(batch + store)) == {
        "database": "db", "maxBatchSize": "50", "ordered": "false"}


def test_input_is_required():
    with pytest.raises(SystemExit):
        parser().parse_args(["batch", "--output-path", "out"])


def test_batch_command_stores_documents(spark, at):
    spark.range(20).write.parquet(at("in.parquet"))
    arguments = ["batch", "--input-path", at("in.parquet"), "--output-path", at("out")]
    main([*arguments, "--compression-level", "3", "--partitions", "2"])
    stored = spark.read.parquet(at("out"))
    assert stored.count() == 20
    assert stored.select("metadata.compression_level").distinct().collect() == [(3,)]
    with pytest.raises(QualityGateError):
        main([*arguments, "--check"])
