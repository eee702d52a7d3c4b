from __future__ import annotations

import pytest

from docpress.functions.payload import JSON_OPTIONS
from docpress.operators.layout import choose_partitions
from docpress.scratch import scratch_path
from docpress.errors import ScratchLocationError
from docpress.session import BASE_CONF, STREAM_CONF, object_store_conf
from docpress.sources.collection import read_collection
from docpress.sources.files import detect_format, input_inventory, read_table
from docpress.sources.messages import message_options
from tests.plans import physical

MB = 1024 * 1024


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, None, -0.25)], "id bigint, name string, v double")


def contents(df):
    return sorted(map(tuple, df.select("id", "name", "v").collect()))


@pytest.mark.parametrize("suffix, writer", [
    (".json", "json"), (".csv", "csv"), (".parquet", "parquet"), ("", "parquet"),
])
def test_suffix_chooses_the_reader(spark, rows, at, suffix, writer):
    path = at("table" + suffix)
    rows.write.format(writer).option("header", "true").save(path)
    assert contents(read_table(spark, path, schema=rows.schema)) == contents(rows)


def test_types_are_inferred_without_a_schema(spark, rows, at):
    rows.write.json(at("t.json"))
    assert dict(read_table(spark, at("t.json")).dtypes) == {"id": "bigint", "name": "string", "v": "double"}
    rows.write.option("header", "true").csv(at("t.csv"))
    assert dict(read_table(spark, at("t.csv")).dtypes) == {"id": "int", "name": "string", "v": "double"}


@pytest.mark.parametrize("writer, gzip", [("json", True), ("json", False), ("csv", True), ("parquet", False)])
def test_folder_is_known_by_its_files(spark, rows, at, writer, gzip):
    options = {"header": "true", **({"compression": "gzip"} if gzip else {})}
    rows.write.format(writer).options(**options).save(at("landing"))
    assert detect_format(spark, at("landing")) == writer
    assert contents(read_table(spark, at("landing"), schema=rows.schema)) == contents(rows)


def test_mixed_folder_needs_a_format(spark, rows, at):
    rows.write.json(at("mixed"))
    rows.write.mode("append").option("header", "true").csv(at("mixed"))
    with pytest.raises(ValueError, match="format="):
        read_table(spark, at("mixed"))


def test_explicit_format_wins(spark, rows, at):
    rows.write.json(at("odd.csv"))
    assert contents(read_table(spark, at("odd.csv"), format="json")) == contents(rows)


def test_landing_records_keep_their_nesting(spark, at):
    landing = spark.sql("""select 5 as id, named_struct('temperature', 21.5D, 'humidity', 40.0D,
        'pressure', 1000.0D) as sensor_data, 'EU' as location, repeat('x', 1000) as data""")
    landing.write.option("compression", "gzip").options(**JSON_OPTIONS).json(at("landing"))
    row = read_table(spark, at("landing")).first()
    assert row["sensor_data"]["pressure"] == 1000.0 and len(row["data"]) == 1000


def test_inventory_counts_files_and_bytes(spark, rows, at, tmp_path):
    rows.repartition(2).write.option("compression", "gzip").json(at("landing"))
    row = input_inventory(spark, at("landing")).first()
    files = list((tmp_path / "landing").glob("*.gz"))
    sizes = [f.stat().st_size for f in files]
    assert (row["n_files"], row["n_bytes"], row["gzip_bytes"]) == (len(files), sum(sizes), sum(sizes))
    assert (row["largest_gzip"], row["scan_splits"], row["formats"]) == (max(sizes), len(files), ["json"])


def test_inventory_reads_no_content(spark, rows, at):
    rows.write.json(at("landing"))
    assert "content" not in physical(input_inventory(spark, at("landing")))


@pytest.mark.parametrize("n_bytes, gzip, largest, splits, expected", [
    (100_000_000 * MB, 0, 0, 800_000, None),                    # 100 TB of Parquet: no shuffle
    (10_000_000 * MB, 10_000_000 * MB, 1000 * MB, 10_000, None),  # many gzip files: enough tasks
    (10_000 * MB, 10_000 * MB, 10_000 * MB, 1, 800),            # one gzip file
    (100_000 * MB, 100_000 * MB, 33_000 * MB, 70_000, 8000),    # one holds a third
    (15 * MB, 0, 0, 1, 128),                                    # small input: a task or two per core
])
def test_rows_are_spread_only_where_it_pays(n_bytes, gzip, largest, splits, expected):
    inventory = {"n_bytes": n_bytes, "gzip_bytes": gzip, "largest_gzip": largest, "scan_splits": splits}
    cores = 64
    found = choose_partitions(inventory, cores)
    if expected is None:
        assert found is None
    else:
        assert found == pytest.approx(expected, rel=0.05)


def test_collection_reads_only_the_named_columns(spark, rows, at):
    rows.write.parquet(at("c"))
    assert "ReadSchema: struct<id:bigint>" in physical(read_collection(spark, at("c")).select("id"))


def test_absent_collection_reads_as_empty_when_its_schema_is_known(spark, rows, at):
    assert read_collection(spark, at("none"), schema=rows.schema).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_collection(spark, at("none"))


def test_message_options():
    assert message_options("b:1", "t", min_partitions=40) == {
        "kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "1000000", "failOnDataLoss": "true", "minPartitions": "40"}


def test_object_store_settings_hold_no_keys():
    conf = object_store_conf("http://store:9000", credentials_provider="some.Provider")
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.aws.credentials.provider"] == "some.Provider"
    assert not [k for k in {**conf, **BASE_CONF, **STREAM_CONF} if "secret" in k or "access.key" in k]


def test_scratch_lies_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(base)


def session_without_setting(master_url):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = master_url

    return Session


def test_scratch_on_a_cluster_needs_the_shared_folder():
    with pytest.raises(ScratchLocationError, match="spark.checkpoint.dir"):
        scratch_path(session_without_setting("k8s://host"), "x")


def test_local_session_without_the_setting_has_a_folder_of_its_own():
    first, second = (scratch_path(session_without_setting("local[2]"), "x") for _ in range(2))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
