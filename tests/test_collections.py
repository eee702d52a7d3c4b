"""Appends, unique keys and layouts."""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docpress.errors import DuplicateKeyError
from docpress.functions.parcels import parceller, unparcel
from docpress.operators.documents import batch_documents
from docpress.operators.layout import (
    read_by_id, store_bounds, write_by_id_hash, write_by_metric, write_by_metrics, write_files_of)
from docpress.operators.ranked import metric_range, top_k, top_k_by_bounds
from docpress.operators.sinks import append_documents, document_store_options, write_micro_batch
from docpress.operators.stats import (
    append_with_partial, batch_stats, collection_stats, logical_size, merged_stats,
    ratio_count_summary, storage_stats)
import docpress.operators.unique as unique
from docpress.operators.unique import split_by_key, unique_append
from tests.plans import physical


def keyed(spark, pairs):
    return spark.createDataFrame(pairs, "_id string, seq bigint")


def pairs(df):
    return sorted(map(tuple, df.select("_id", "seq").collect()))


def test_append_adds_to_the_collection(spark, at):
    rows = spark.range(10).select("id")
    for _ in range(2):
        append_documents(batch_documents(rows), at("c"))
    assert spark.read.parquet(at("c")).count() == 20


def test_append_can_cap_records_per_file(spark, at, tmp_path):
    append_documents(spark.range(10).coalesce(1), at("c"), max_records_per_file=3)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 4


def test_document_store_options():
    assert document_store_options("db", "docs") == {
        "database": "db", "collection": "docs", "maxBatchSize": "1000", "ordered": "false"}


def test_first_row_of_each_new_key_lands(spark, at):
    append_documents(keyed(spark, [("old", 0)]), at("c"))
    split = unique_append(keyed(spark, [("a", 3), ("a", 1), ("old", 2), ("b", 5), ("a", 2)]),
                          at("c"), order_by=["seq"])
    assert pairs(split.accepted) == [("a", 1), ("b", 5)]
    assert pairs(split.rejected) == [("a", 2), ("a", 3), ("old", 2)]
    assert pairs(spark.read.parquet(at("c"))) == [("a", 1), ("b", 5), ("old", 0)]


def test_first_append_creates_the_collection(spark, at):
    unique_append(keyed(spark, [("a", 1), ("a", 1)]), at("c"))
    assert pairs(spark.read.parquet(at("c"))) == [("a", 1)]


def test_second_append_of_the_same_rows_lands_nothing(spark, at):
    rows = keyed(spark, [(str(i), i) for i in range(50)])
    unique_append(rows, at("c"))
    again = unique_append(rows, at("c"))
    assert again.accepted.count() == 0 and again.rejected.count() == 50
    assert spark.read.parquet(at("c")).count() == 50


def test_strict_raises_after_the_accepted_rows_landed(spark, at):
    with pytest.raises(DuplicateKeyError):
        unique_append(keyed(spark, [("a", 1), ("a", 2)]), at("c"), order_by=["seq"], strict=True)
    assert pairs(spark.read.parquet(at("c"))) == [("a", 1)]
    unique_append(keyed(spark, [("b", 1)]), at("c"), strict=True)


def test_exact_copies_and_missing_keys_lose_no_row(spark):
    rows = keyed(spark, [("hot", 1)] * 40 + [(None, 2)] * 3 + [("x", 9)])
    held = keyed(spark, [("x", 0)] * 5)
    split = split_by_key(rows, held, order_by=["seq"])
    assert sorted(split.accepted.collect(), key=str) == sorted([("hot", 1), (None, 2)], key=str)
    assert split.rejected.groupBy("_id").count().orderBy("_id").collect() == [
        (None, 2), ("hot", 39), ("x", 1)]


def test_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("_id"),
        F.col("id").alias("seq"))
    split = split_by_key(rows, keyed(spark, [("1", 0)]), order_by=["seq"])
    accepted = split.accepted.agg(F.count("*"), F.min(F.when(F.col("_id") == "hot", F.col("seq")))).first()
    assert tuple(accepted) == (6000, 0)
    assert split.rejected.count() == 3000
    for part in (split.accepted, split.rejected):
        plan = physical(part)
        assert "Window" not in plan
        assert re.findall(r"(\w+Join) \[(\w+)#", plan) == [("BroadcastHashJoin", "_staged_row")]


@pytest.mark.parametrize("copies, fewer", [(1, "losers"), (5, "winners")])
def test_rows_meet_the_smaller_set_of_row_numbers(spark, copies, fewer):
    rows = spark.range(100).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(copies)))) \
        .select(F.col("id").cast("string").alias("_id"), F.col("n").cast("bigint").alias("seq"))
    split = split_by_key(rows, keyed(spark, [("7", 0)]), order_by=["seq"])
    assert f"/{fewer}-" in physical(split.accepted)
    assert (split.accepted.count(), split.rejected.count()) == (99, 100 * copies - 99)
    assert split.accepted.where("seq <> 1").count() == 0


@pytest.mark.parametrize("limit, join", [(unique.BROADCAST_BYTES, True), (0, False)])
def test_few_new_keys_spare_the_collection_a_shuffle(spark, monkeypatch, limit, join):
    monkeypatch.setattr(unique, "BROADCAST_BYTES", limit)
    held = keyed(spark, [(str(i), 0) for i in range(100)] + [(None, 0)])
    rows = keyed(spark, [("7", 1), ("new", 2), ("new", 3), (None, 4)])
    plan = physical(unique._relevant(held.select("_id"), rows.select("_id"), "_id"))
    assert ("LeftSemi, BuildRight" in plan) is join
    split = split_by_key(rows, held, order_by=["seq"])
    assert split.accepted.collect() == [("new", 2)]
    assert sorted(r["seq"] for r in split.rejected.collect()) == [1, 3, 4]


def test_replayed_batch_replaces_itself(spark, at):
    first = keyed(spark, [("a", 1), ("b", 2)]).withColumn("batch_id", F.lit(0))
    other = keyed(spark, [("c", 3)]).withColumn("batch_id", F.lit(1))
    write_micro_batch(first, at("c"), "q1")
    write_micro_batch(other, at("c"), "q1")
    write_micro_batch(first, at("c"), "q1")
    assert pairs(spark.read.parquet(at("c"))) == [("a", 1), ("b", 2), ("c", 3)]
    write_micro_batch(first, at("c"), "q2")
    assert spark.read.parquet(at("c")).count() == 5


def test_empty_batch_removes_nothing(spark, at):
    some = keyed(spark, [("a", 1)]).withColumn("batch_id", F.lit(0))
    write_micro_batch(some, at("c"), "q1")
    write_micro_batch(some.where("false").withColumn("batch_id", F.lit(1)), at("c"), "q1")
    assert spark.read.parquet(at("c")).count() == 1


@pytest.fixture
def sized(spark, at):
    """Stored documents; a third of them have the same size."""
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("_id"),
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("original_size"))
    rows.repartition(4).write.parquet(at("stored"))
    return spark.read.parquet(at("stored"))


def file_ranges(spark, path, metric="original_size"):
    return [tuple(r) for r in (
        spark.read.parquet(path).groupBy("_metadata.file_name")
        .agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.count("*").alias("n"))
        .orderBy(F.desc("hi"), F.desc("lo")).select("lo", "hi", "n").collect())]


def test_metric_layout_orders_files_and_splits_a_common_value(spark, sized, at):
    write_by_metric(sized, at("by-size"), "original_size", partitions=8)
    ranges = file_ranges(spark, at("by-size"))
    assert sum(n for _, _, n in ranges) == 3000
    assert len(ranges) == 8 and max(n for _, _, n in ranges) < 2 * 3000 / 8
    for (low, _, _), (_, high, _) in zip(ranges, ranges[1:]):
        assert high <= low


def test_metric_layout_splits_copies_of_one_document(spark, at):
    spark.range(2000).select(F.lit("same").alias("_id"), F.lit(7).alias("original_size")) \
        .repartition(4).write.parquet(at("stored"))
    write_by_metric(spark.read.parquet(at("stored")), at("by-size"), "original_size", partitions=4)
    counts = [n for _, _, n in file_ranges(spark, at("by-size"))]
    assert sum(counts) == 2000 and len(counts) == 4 and max(counts) < 1000


def test_range_reaches_the_scan(spark, sized, at):
    write_by_metric(sized, at("by-size"), "original_size", partitions=4)
    found = metric_range(spark.read.parquet(at("by-size")), "original_size", 100, 600)
    assert found.count() == sized.where("original_size >= 100 and original_size < 600").count()
    assert "GreaterThanOrEqual(original_size,100)" in physical(found)


def test_hash_layout_puts_each_id_in_one_shard(spark, sized, at):
    write_by_id_hash(sized, at("by-id"), shards=5)
    stored = spark.read.parquet(at("by-id"))
    assert stored.count() == 3000
    assert stored.groupBy("_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert stored.select("shard").distinct().count() == 5
    found = read_by_id(spark, at("by-id"), "42")
    assert [tuple(r) for r in found.collect()] == [("42", 500)]
    assert "PartitionFilters: [isnotnull(shard" in physical(found)


def test_hash_layout_splits_a_heavy_id_over_files(spark, at):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("data"))
    rows.repartition(8).write.parquet(at("stored"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "200k")
    try:
        write_by_id_hash(spark.read.parquet(at("stored")), at("by-id"), shards=4)
    finally:
        spark.conf.set(size, before)
    stored = spark.read.parquet(at("by-id"))
    assert stored.count() == 60_000
    hot = stored.where("_id = 'hot'")
    assert hot.select("shard").distinct().count() == 1
    files = [r["count"] for r in hot.groupBy("_metadata.file_name").count().collect()]
    assert len(files) >= 4 and max(files) < 10_000


def test_top_k_meets_only_k_rows_per_task(spark, sized):
    best = top_k(sized, "original_size", 3)
    assert [r["_id"] for r in best.collect()] == ["2999", "2998", "2996"]
    assert "TakeOrderedAndProject" in physical(best)
    assert [r["original_size"] for r in top_k(sized, "original_size", 2, ascending=True).collect()] == [1, 2]


def test_documents_without_the_metric_rank_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "_id string, compression_ratio double")
    for ascending in (True, False):
        assert top_k(df, "compression_ratio", 1, ascending=ascending).first()["_id"] == "b"


@pytest.fixture
def measured(spark):
    return spark.createDataFrame(
        [("a", 100, 10, 10.0, 0), ("b", 30, 10, 3.0, 0), ("c", 0, 0, None, 1)],
        "_id string, original_size bigint, compressed_size bigint, compression_ratio double, batch_id bigint")


def test_mean_of_ratios_is_not_ratio_of_totals(measured):
    assert tuple(collection_stats(measured).first()) == (3, 6.5, 130, 20, 6.5)
    skewed = measured.where("_id <> 'c'").union(measured.where("_id = 'a'"))
    row = collection_stats(skewed).first()
    assert (row["avg_ratio"], row["overall_ratio"]) == (pytest.approx(23 / 3), 230 / 30)
    assert tuple(ratio_count_summary(measured).first()) == (6.5, 3)


def test_statistics_of_nothing(measured):
    nothing = measured.where("false")
    assert tuple(collection_stats(nothing).first()) == (0, None, None, None, None)
    assert tuple(logical_size(nothing).first()) == (0, 0)


def test_statistics_per_batch(measured):
    rows = {r["batch_id"]: tuple(r)[1:] for r in batch_stats(measured).collect()}
    assert rows == {0: (2, 6.5, 130, 20), 1: (1, None, 0, 0)}


def test_storage_statistics(spark, at, tmp_path):
    append_documents(batch_documents(spark.range(100)), at("c"))
    row = storage_stats(spark, at("c")).first()
    files = list((tmp_path / "c").glob("*.parquet"))
    payload = spark.read.parquet(at("c")).agg(F.sum(F.octet_length("data"))).first()[0]
    assert tuple(row) == (100, payload, len(files), sum(f.stat().st_size for f in files))


def test_statistics_never_read_the_payload(spark, at):
    append_documents(batch_documents(spark.range(10)), at("c"))
    plan = physical(collection_stats(spark.read.parquet(at("c"))))
    assert "data:binary" not in plan and "original_size:bigint" in plan


def test_reader_need_not_know_the_number_of_shards(spark, at):
    documents = spark.range(100).select(F.col("id").cast("string").alias("_id"))
    write_by_id_hash(documents.where("_id < 50"), at("mixed"), shards=3)
    write_by_id_hash(documents.where("_id >= 50"), at("mixed"), shards=8, mode="append")
    wanted = [str(i) for i in range(40, 60)]
    assert sorted(r[0] for r in read_by_id(spark, at("mixed"), wanted).collect()) == wanted


@pytest.fixture
def measures(spark):
    """Four metrics, one skewed, one with a value that a third of all rows have, some NULL."""
    return spark.range(20_000).select(
        F.col("id").cast("string").alias("_id"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("a"),
        F.exp(F.rand(1) * 12).alias("b"), F.when(F.col("id") % 3 > 0, F.rand(2)).otherwise(0.5).alias("c"),
        F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") * 60)).alias("d"))


def _boxes(spark, path, metric):
    return spark.read.parquet(path).groupBy("_metadata.file_path").agg(
        F.min(metric).alias("low"), F.max(metric).alias("high"))


def test_common_layout_serves_ranges_of_each_metric(spark, measures, at):
    """Four metrics that know nothing of each other: 256 files part each in four."""
    stored = [(m, *measures.agg(F.percentile_approx(m, [0.4, 0.5])).first()[0]) for m in "abd"]
    stored.append(("c", *measures.agg(F.percentile_approx("c", [0.1, 0.2])).first()[0]))
    write_by_metrics(measures, at("z"), ["a", "b", "c", "d"], partitions=256)
    back = spark.read.parquet(at("z"))
    assert back.columns == measures.columns and back.count() == 20_000
    assert back.exceptAll(measures).isEmpty()
    for metric, low, high in stored:
        boxes = _boxes(spark, at("z"), metric)
        met = boxes.where((F.col("low") < F.lit(high)) & (F.col("high") >= F.lit(low)))
        assert boxes.count() == 256 and met.count() < 128, metric


@pytest.mark.parametrize(("metric", "ascending"), [("a", False), ("b", True), ("c", False), ("d", True)])
def test_top_k_by_bounds_reads_few_files(spark, measures, at, metric, ascending):
    write_by_metrics(measures, at("z"), ["a", "b", "c", "d"], partitions=64)
    store_bounds(spark, at("z"), at("bounds"), ["a", "b", "c", "d"])
    rows, bounds = spark.read.parquet(at("z")), spark.read.parquet(at("bounds"))
    found = top_k_by_bounds(rows, bounds, metric, 20, ascending=ascending)
    assert found.collect() == top_k(rows, metric, 20, ascending=ascending).collect()
    limit = physical(found).split("PushedFilters: [")[1]
    assert f"OrEqual({metric}," in limit
    edge = found.agg(F.min(metric), F.max(metric)).first()
    assert _boxes(spark, at("z"), metric).where(
        F.col("low") <= F.lit(edge[1]) if ascending else F.col("high") >= F.lit(edge[0])).count() < 64
    # More than there are values: rows without one follow.
    assert top_k_by_bounds(rows, bounds, "d", 19_999).count() == 19_999


def test_bounds_of_new_files_only(spark, measures, at):
    measures.limit(10).write.parquet(at("x"))
    store_bounds(spark, at("x"), at("bounds"), ["a"])
    measures.limit(10).write.mode("append").parquet(at("x"))
    store_bounds(spark, at("x"), at("bounds"), ["a"])
    bounds = spark.read.parquet(at("bounds"))
    assert bounds.count() == bounds.select("file").distinct().count() == len(
        spark.read.parquet(at("x")).inputFiles())


def test_partials_of_commits_make_the_statistics(spark, at):
    documents = spark.range(30_000).select(
        F.col("id").cast("string").alias("_id"), F.col("id").alias("original_size"),
        (F.col("id") % 7 + 1).alias("compressed_size"),
        F.when(F.col("id") % 10 > 0, F.exp(F.rand(3) * 5)).alias("compression_ratio"))
    for n in (0, 1, 2, 1):  # the second commit is stored twice
        append_with_partial(documents.where(F.col("original_size") % 3 == n), at("docs"),
                            at("parts"), f"run-{n}")
    append_with_partial(documents.limit(0), at("docs"), at("parts"), "nothing")
    row = merged_stats(spark.read.parquet(at("parts")), (0.1, 0.5, 0.9)).first()
    stored = spark.read.parquet(at("docs"))
    exact = collection_stats(stored).first()
    assert stored.count() == row["n_docs"] == 30_000
    for name in ("total_original", "total_compressed", "overall_ratio"):
        assert row[name] == exact[name]
    assert row["avg_ratio"] == pytest.approx(exact["avg_ratio"], rel=1e-12)
    for share, value in zip((0.1, 0.5, 0.9), row["ratio_quantiles"]):
        below = stored.where(F.col("compression_ratio") <= value).count() / 27_000
        assert abs(below - share) < 0.03


def test_partials_of_nothing(spark, at):
    documents = spark.createDataFrame(
        [], "_id string, original_size long, compressed_size long, compression_ratio double")
    append_with_partial(documents, at("docs"), at("parts"), "first")
    assert merged_stats(spark.read.parquet(at("parts"))).first() == (0, None, None, None, None, None)


def test_files_follow_the_size_of_rows_that_are_small_on_disk(spark, at):
    rows = spark.range(200_000).select(
        F.lit("same").alias("_id"), (F.col("id") % 3).alias("n"),
        F.struct(F.repeat(F.lit("x"), 1500).alias("text"), F.array("id").alias("ids")).alias("data"))
    rows.write.parquet(at("stored"))
    stored = spark.read.parquet(at("stored"))
    for write, by in ((write_by_metric, "n"), (write_by_metrics, ["n"])):
        write(stored, at(write.__name__), by)
        assert len(list(Path(at(write.__name__)).glob("*.parquet"))) >= 3
    assert spark.read.parquet(at("write_by_metric")).count() == 200_000
    write_by_metric(stored.limit(0), at("none"), "n")
    assert spark.read.parquet(at("none")).count() == 0


def rows_by_file(spark, path):
    return sorted(r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").count().collect())


def test_files_of_values_are_of_one_size_and_keep_the_rows(spark, at):
    rows = spark.range(5_000, numPartitions=3).select(
        "id", F.when(F.col("id") % 100 > 9, "en").when(
            F.col("id") % 10 > 0, F.concat(F.lit("l"), F.col("id") % 10)).alias("lang"),
        F.when(F.col("id") % 3 > 0, F.struct(F.timestamp_micros("id").alias("at"), F.array(
            F.lit(""), F.lit(None).cast("string")).alias("texts"))).alias("more"),
        F.col("id").cast("decimal(20,3)").alias("exact"), F.lit(b"\x00\xff").alias("raw"))
    write_files_of(rows, at("f"), "lang")
    stored = spark.read.parquet(at("f"))
    assert stored.dtypes == rows.dtypes
    assert stored.exceptAll(rows).count() == rows.exceptAll(stored).count() == 0
    counts = rows_by_file(spark, at("f"))
    assert len(counts) == 10 and counts[-1] - counts[0] < 50


@pytest.mark.parametrize("values, files", [
    ([], 0), (["a"], 1), (["a", None, None], 1), ([f"v{n}" for n in range(16)], 16), (["", "a", "a"], 2)])
def test_as_many_files_as_values_however_few_the_rows(spark, at, values, files):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n long, v string")
    write_files_of(rows.repartition(16) if values else rows, at("f"), "v")
    assert len(list(Path(at("f")).rglob("*.parquet"))) == files
    if values:
        assert sorted(map(tuple, spark.read.parquet(at("f")).collect()), key=repr) == sorted(
            map(tuple, rows.collect()), key=repr)


def test_parcels_are_small_and_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({
        "lang": ["en"] * 900 + ["de", None] * 50, "text": [f"text {n % 50} " * 100 for n in range(1_000)]})
    parcels = list(parceller("lang", {"en": 0, "de": 1}, 2)([batch, batch]))
    assert sum(p.nbytes for p in parcels) * 20 < batch.nbytes
    rows = list(unparcel()(parcels))
    assert {p["place"][0].as_py() for p in parcels} == {0, 1}
    assert all(abs(r.num_rows - 500) <= 2 for r in rows)
    assert sorted(t for r in rows for t in r["text"].to_pylist()) == sorted(2 * batch["text"].to_pylist())
