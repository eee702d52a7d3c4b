from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import docpress.catalog.jobs as jobs
from docpress.catalog import oracle_sql
from docpress.errors import QualityGateError
from docpress.operators.documents import unpack
from docpress.operators.gates import check, enforce
from docpress.plans.batch import run_batch
from docpress.plans.daily import checked_run
from tests import oracle

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture
def landing(spark, at):
    """Gzip JSON lines like the sample data: mostly filler, ids repeat."""
    rows = spark.range(60).select(
        (F.col("id") % 50).alias("id"), F.lit("EU").alias("location"),
        F.struct((F.col("id") + 0.5).alias("temperature")).alias("sensor_data"),
        F.repeat(F.lit("x"), 3000).alias("data"))
    rows.repartition(3).write.option("compression", "gzip").json(at("landing"))
    return at("landing")


@pytest.fixture
def sensors(spark, at):
    """Readings that compress badly."""
    (spark.range(30).select("id", F.sha2(F.col("id").cast("string"), 512).alias("raw"))
     .write.parquet(at("sensors.parquet")))
    return at("sensors.parquet")


def test_batch_job_reports_what_it_stored(spark, landing, at):
    run = run_batch(spark, landing, at("out"), as_of=AS_OF)
    assert run.input["n_files"] == 3 and run.partitions == 16
    assert run.written["n_docs"] == 60 and run.written["avg_ratio"] > 5
    stats = run.collection.first()
    assert (stats["n_docs"], stats["total_original"]) == (60, run.written["total_original"])
    payload = unpack(spark.read.parquet(at("out")), ["_id"]).first()["payload"]
    assert payload.startswith('{"data":"xxx') and '"sensor_data":{"temperature":' in payload


def test_batch_job_appends(spark, sensors, at):
    for n in (30, 60):
        assert run_batch(spark, sensors, at("out")).collection.first()["n_docs"] == n


def test_batch_job_can_refuse_taken_ids(spark, landing, at):
    run = run_batch(spark, landing, at("out"), unique_ids=True)
    assert run.written["n_docs"] == 50 and run.collection.first()["n_docs"] == 50
    again = run_batch(spark, landing, at("out"), unique_ids=True)
    assert again.written["n_docs"] == 0 and again.collection.first()["n_docs"] == 50


def test_batch_job_writes_other_formats(spark, sensors, at):
    run = run_batch(spark, sensors, at("out"), output_format="orc",
                    output_options={"compression": "zlib"})
    assert run.collection.first()["n_docs"] == spark.read.orc(at("out")).count() == 30
    with pytest.raises(ValueError, match="Parquet"):
        run_batch(spark, sensors, at("out"), output_format="orc", unique_ids=True)


def test_batch_job_takes_a_fixed_number_of_partitions(spark, sensors, at, tmp_path):
    run = run_batch(spark, sensors, at("out"), partitions=5, compression_level=1)
    assert run.partitions == 5
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 5
    assert {r[0] for r in spark.read.parquet(at("out")).select("metadata.compression_level").collect()} == {1}


def test_batch_job_checks_its_level_first(spark, sensors, at):
    with pytest.raises(ValueError, match="compression level"):
        run_batch(spark, sensors, at("out"), compression_level=10)


def test_daily_run_passes(spark, landing, at):
    report = checked_run(spark, landing, at("out")).first()
    assert report["passed"] and report["input_files"] == 3 and report["written_docs"] == 60


def test_daily_run_fails_on_a_low_ratio(spark, sensors, at):
    with pytest.raises(QualityGateError, match="below 5"):
        checked_run(spark, sensors, at("out"))
    assert spark.read.parquet(at("out")).count() == 30
    report = checked_run(spark, sensors, at("other"), strict=False).first()
    assert report["has_documents"] and not report["passed"]
    assert checked_run(spark, sensors, at("third"), min_ratio=1).first()["passed"]


@pytest.mark.parametrize("n, ratio, has, ok", [
    (10, 4.999, True, False), (10, 5.0, True, True), (10, 5.001, True, True),
    (10, None, True, False), (0, None, False, False),
])
def test_gate_verdicts(spark, n, ratio, has, ok):
    stats = spark.createDataFrame([(n, ratio)], "n_docs bigint, avg_ratio double")
    row = check(stats).first()
    assert (row["has_documents"], row["ratio_ok"], row["passed"]) == (has, ok, has and ok)
    if row["passed"]:
        assert enforce(row) is row
    else:
        with pytest.raises(QualityGateError):
            enforce(row)


def test_daily_run_that_is_tried_again_stores_one_copy(spark, landing, at):
    for _ in range(2):
        report = checked_run(spark, landing, at("out"), as_of=AS_OF).first()
        assert (report["n_docs"], report["written_docs"]) == (60, 60)
    other = checked_run(spark, landing, at("out"), as_of=AS_OF, run_id="another").first()
    assert (other["n_docs"], other["written_docs"]) == (120, 60)


def test_input_without_files_is_reported(spark, tmp_path, at):
    (tmp_path / "nothing").mkdir()
    report = checked_run(spark, at("nothing"), at("out"), strict=False).first()
    assert (report["input_files"], report["n_docs"], report["has_documents"]) == (0, 0, False)
    with pytest.raises(QualityGateError, match="no documents"):
        checked_run(spark, at("nothing"), at("out"))


def test_run_id_needs_a_collection_of_files(spark, landing):
    with pytest.raises(ValueError, match="run_id"):
        run_batch(spark, landing, None, run_id="r", output_format="mongodb")


@pytest.mark.parametrize("common, second, third", [("en", "de", "fr"), ("01", "2", "")])
def test_daily_run_lands_a_common_language_in_files_of_one_size(spark, at, monkeypatch, common,
                                                                second, third):
    """Languages may read like numbers, or be empty or missing."""
    last = F.col("id") % 10
    lang = F.when(last < 7, common).when(last == 7, second).when(last == 8, third)
    (spark.range(2_000, numPartitions=3).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("word "), 40)).alias("text"),
        lang.alias("lang"), F.lit("src").alias("source"), F.lit(200).cast("bigint").alias("n_chars"))
     .write.parquet(at("sf/documents.parquet")))
    monkeypatch.setattr(jobs, "scratch_path", lambda spark, label: at(label))
    report = jobs.checked_run_report(spark, at("sf"))
    con = oracle.connect(at("none"))
    con.execute(f"create view documents as select * from '{at('sf/documents.parquet')}/*.parquet'")
    assert oracle.spark_rows(report) == oracle.sql_rows(con, oracle_sql()["checked_run_report"])
    files = spark.read.parquet(at("landed")).groupBy("_metadata.file_path").count().collect()
    assert len(files) == 3 and max(f["count"] for f in files) < 700
