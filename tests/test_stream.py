from __future__ import annotations

import datetime as dt
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docpress.operators.documents import frame_documents
from docpress.operators.stats import batch_stats
from docpress.operators.windows import documents_total, processing_rate
from docpress.plans.stream import run_stream
from docpress.sources.messages import file_frames
from docpress.streaming.late import read_timely, start_timely, window_account
from docpress.streaming.rates import read_rates, start_rates, start_totals
from docpress.streaming.unique import start_unique

AS_OF = "2024-02-01 00:00:00"
START = dt.datetime(2024, 1, 1)


def land(spark, path, first, n, minutes=0):
    """One more file of ``n`` frames."""
    rows = [(bytearray(f"s{i}".encode()), bytearray(f'{{"sensor_id":"s{i}","temperature":{i}.5}}'.encode()),
             START + dt.timedelta(minutes=minutes, seconds=i)) for i in range(first, first + n)]
    spark.createDataFrame(rows, "key binary, value binary, timestamp timestamp") \
        .coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def ingest(spark, at):
    def run(checkpoint="checkpoint", **options):
        seen = {}
        query = run_stream(
            spark, at("out"), at(checkpoint), available_now=True, as_of=AS_OF,
            frames=file_frames(spark, at("in"), max_files_per_trigger=1),
            on_batch=lambda batch_id, stats: seen.update({batch_id: dict(stats)}), **options)
        query.awaitTermination(120)
        return query, seen
    return run


def stored(spark, at):
    return spark.read.parquet(at("out"))


def test_every_file_is_a_batch_with_its_statistics(spark, at, ingest):
    for i in range(3):
        land(spark, at("in"), 10 * i, 10)
    query, seen = ingest()
    documents = stored(spark, at)
    assert documents.count() == 30
    assert {r["query_id"] for r in documents.select("query_id").distinct().collect()} == {query.id}
    expected = {r["batch_id"]: r.asDict() for r in batch_stats(documents).collect()}
    assert seen.keys() == expected.keys() == {0, 1, 2}
    for batch_id, stats in seen.items():
        assert stats["n_docs"] == expected[batch_id]["n_docs"] == 10
        assert stats["avg_ratio"] == pytest.approx(expected[batch_id]["avg_ratio"])
        assert stats["total_compressed"] == expected[batch_id]["total_compressed"]


def test_stream_and_batch_store_the_same_documents(spark, at, ingest):
    land(spark, at("in"), 0, 25)
    ingest(partitions=4)
    batch = frame_documents(spark.read.parquet(at("in")), as_of=AS_OF)
    batch = batch.drop("_id")  # a table's frames have no place in a stream
    streamed = stored(spark, at).select(batch.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    row = streamed.where("key = 's3'").first()
    assert zlib.decompress(bytes(row["compressed_data"])) == b'{"sensor_id":"s3","temperature":3.5}'


def test_restart_continues_and_a_lost_commit_duplicates_nothing(spark, at, ingest, tmp_path):
    land(spark, at("in"), 0, 10)
    land(spark, at("in"), 10, 10)
    ingest()
    # As after a crash between writing the batch and committing it.
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    _, seen = ingest()
    assert 1 in seen and 0 not in seen
    assert stored(spark, at).count() == 20
    land(spark, at("in"), 20, 10)
    _, seen = ingest()
    assert list(seen) == [2] and stored(spark, at).count() == 30


def test_new_checkpoint_keeps_the_older_documents(spark, at, ingest):
    land(spark, at("in"), 0, 10)
    ingest()
    ingest(checkpoint="second")
    assert stored(spark, at).count() == 20
    assert stored(spark, at).select("query_id").distinct().count() == 2


def test_empty_batch_is_reported_and_harmless(spark, at, ingest):
    land(spark, at("in"), 0, 0)
    _, seen = ingest()
    assert all(s["n_docs"] == 0 and s["avg_ratio"] is None for s in seen.values())


def test_level_is_checked_before_the_stream_starts(spark, at, ingest):
    land(spark, at("in"), 0, 1)
    with pytest.raises(ValueError, match="compression level"):
        ingest(level=0)


def sized(frames):
    return frames.select("timestamp", F.octet_length("value").cast("bigint").alias("original_size"),
                         F.lit(2.0).alias("compression_ratio"))


def rates(spark, at, **options):
    stream = sized(file_frames(spark, at("in"), max_files_per_trigger=1))
    query = start_rates(stream, at("rates"), at("rates-checkpoint"), available_now=True, **options)
    query.awaitTermination(120)
    return read_rates(spark, at("rates")) if options.get("complete") else spark.read.parquet(at("rates"))


def test_complete_rates_equal_the_table(spark, at):
    for i in range(3):
        land(spark, at("in"), 40 * i, 40, minutes=3 * i)
    found = rates(spark, at, complete=True)
    expected = processing_rate(sized(spark.read.parquet(at("in"))))
    assert found.count() == expected.count()
    assert found.exceptAll(expected).count() == 0


def test_append_emits_closed_windows_and_drops_late_rows(spark, at):
    land(spark, at("in"), 0, 10)
    rates(spark, at, late_seconds=60)
    land(spark, at("in"), 0, 10, minutes=30)
    rates(spark, at, late_seconds=60)
    land(spark, at("in"), 0, 5)                 # 30 minutes late
    land(spark, at("in"), 0, 10, minutes=90)
    found = rates(spark, at, late_seconds=60)
    by_start = {r["window_start"]: r["n_docs"] for r in found.collect()}
    first = START - dt.timedelta(seconds=270)
    assert by_start[first] == 10
    assert len(by_start) == found.count() == 20   # ten windows each; the last file's are open
    assert max(by_start) < START + dt.timedelta(minutes=31)


def test_append_with_adjoining_windows(spark, at):
    land(spark, at("in"), 0, 10)
    land(spark, at("in"), 0, 10, minutes=60)
    found = rates(spark, at, late_seconds=60, width=300, step=300)
    assert [(r["window_start"], r["n_docs"], r["avg_ratio"]) for r in found.collect()] == [(START, 10, 2.0)]


def test_state_partitions_belong_to_the_query(spark, at, tmp_path):
    land(spark, at("in"), 0, 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rates(spark, at, complete=True, state_partitions=2)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before != "2"
    state = tmp_path / "rates-checkpoint" / "state" / "0"
    assert {p.name for p in state.iterdir() if p.name.isdigit()} == {"0", "1"}


def test_crash_between_versions_leaves_the_series_before(spark, at, tmp_path):
    land(spark, at("in"), 0, 10)
    before = rates(spark, at, complete=True).collect()
    (tmp_path / "rates" / "version=00000000000000000099" / "_temporary").mkdir(parents=True)
    assert read_rates(spark, at("rates")).collect() == before


def test_stream_writes_other_files_and_names_each_frame(spark, at, ingest):
    land(spark, at("in"), 0, 10)
    land(spark, at("in"), 0, 10)
    ingest(output_format="json")
    ids = [r["_id"] for r in spark.read.json(at("out")).select("_id").collect()]
    assert len(set(ids)) == len(ids) == 20


def test_frames_without_a_place_are_named_by_what_they_hold(spark, at):
    land(spark, at("in"), 0, 3)
    frames = spark.read.parquet(at("in"))
    first, again = (sorted(r["_id"] for r in frame_documents(frames).select("_id").collect())
                    for _ in range(2))
    assert first == again and len(set(first)) == 3


def _land(spark, path, rows):
    spark.createDataFrame(rows, "_id string, n long, at string").selectExpr(
        "_id", "n", "cast(at as timestamp) as timestamp").coalesce(1).write.mode("append").parquet(path)


def _from(spark, path):
    return spark.readStream.schema("_id string, n long, timestamp timestamp").parquet(path)


def test_stream_ids_are_taken_once(spark, at):
    """By a batch job, by earlier batches, and inside a batch; a batch that runs again changes nothing."""
    source, kept, rest, checkpoint = at("in"), at("kept"), at("rest"), at("checkpoint")
    spark.createDataFrame([("a", 0)], "_id string, n long").write.parquet(f"{kept}/query_id=job/batch_id=0")
    for rows in ([("a", 1), ("b", 2), ("b", 3)], [("b", 4), ("c", 5), (None, 6), (None, 7)]):
        _land(spark, source, [(i, n, None) for i, n in rows])
        start_unique(_from(spark, source), kept, rest, checkpoint, order_by=["n"],
                     available_now=True).awaitTermination()

    def numbers(path):
        return sorted(r["n"] for r in spark.read.parquet(path).select("n").collect())

    assert numbers(kept) == [0, 2, 5, 6] and numbers(rest) == [1, 3, 4, 7]
    # The last batch's commit is lost: it runs again after the restart.
    Path(f"{checkpoint}/commits/1").unlink()
    Path(f"{checkpoint}/commits/.1.crc").unlink(missing_ok=True)
    start_unique(_from(spark, source), kept, rest, checkpoint, order_by=["n"],
                 available_now=True).awaitTermination()
    assert numbers(kept) == [0, 2, 5, 6] and numbers(rest) == [1, 3, 4, 7]


def test_running_total_counts_late_and_untimed_rows(spark, at):
    source, path, checkpoint = at("in"), at("totals"), at("checkpoint")
    day = "2024-01-0{} 00:0{}:00".format
    batches = ([day(2, 1), day(2, 7), None], [day(1, 0), day(2, 8)], [day(3, 0)], [None])
    rows = [("x", n, t) for n, t in enumerate(t for b in batches for t in b)]
    for batch in batches:
        _land(spark, source, [rows.pop(0) for _ in batch])
        start_totals(_from(spark, source), path, checkpoint, available_now=True,
                     state_partitions=2).awaitTermination()
        found = read_rates(spark, path)
        everything = spark.read.parquet(source)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(
            map(tuple, documents_total(everything).collect()), key=str)
    assert found.agg({"total_docs": "max"}).first()[0] == 7
    # Older versions go; the one before the newest stays for its readers.
    assert len(list(Path(path).glob("version=*"))) == 2


def test_late_rows_are_kept_apart_and_a_lost_commit_decides_alike(spark, at, tmp_path):
    """Batches of minutes 0, 10 and 1; windows of a minute close five minutes later."""
    def drain():
        frames = file_frames(spark, at("in"), max_files_per_trigger=1)
        start_timely(frames.select("key", "timestamp"), at("rows"), at("marks"), at("checkpoint"),
                     late_seconds=300, width=60, available_now=True).awaitTermination(120)

    def rows():
        return {(r["n"], r["batch_id"], r["late"]) for r in read_timely(spark, at("rows")).groupBy(
            "batch_id", "late").agg(F.count("*").alias("n")).collect()}

    for minutes, n in ((0, 3), (10, 4), (1, 5)):
        land(spark, at("in"), 0, n, minutes)
        drain()
    expected = {(3, 0, False), (4, 1, False), (5, 2, True)}
    assert rows() == expected
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    drain()
    assert rows() == expected
    account = window_account(read_timely(spark, at("rows")), at("marks"), late_seconds=300, width=60)
    assert {(r["window_start"].minute, *r[1:]) for r in account.collect()} == {
        (0, 3, 0, True), (10, 4, 0, False), (1, 0, 5, True)}


def test_rows_without_a_time_are_on_time(spark, at):
    for ts in (START, None):
        spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"), ts)],
                              "key binary, value binary, timestamp timestamp"
                              ).coalesce(1).write.mode("append").parquet(at("in"))
    frames = file_frames(spark, at("in"), max_files_per_trigger=1)
    start_timely(frames.select("key", "timestamp"), at("rows"), at("marks"), at("checkpoint"),
                 late_seconds=0, width=60, available_now=True).awaitTermination(120)
    assert [r["late"] for r in read_timely(spark, at("rows")).collect()] == [False, False]
