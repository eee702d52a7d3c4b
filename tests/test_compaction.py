"""Compaction, keyed reads and shared dictionaries."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import docpress.operators.compaction as compaction
from docpress.functions.dictionary import (
    Dictionary, load_dictionary, store_dictionary, train_dictionary)
from docpress.functions.payload import row_json
from docpress.operators.documents import batch_documents, unpack
from docpress.operators.layout import keyed_options, read_ids
from docpress.operators.sinks import append_documents, write_micro_batch


def filled(spark, path, batches=4, files=6):
    for query in ("first", "second"):
        for n in range(batches):
            rows = spark.range(20).select(F.col("id").cast("string").alias("_id"),
                                          F.lit(n).alias("batch_id")).repartition(files)
            write_micro_batch(rows, path, query)
    return spark.read.parquet(path)


def content(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("query_id", "batch_id", "_id").collect()))


def files_of(spark, path):
    counted = spark.read.parquet(path).groupBy("query_id", "batch_id").agg(
        F.count_distinct("_metadata.file_path").alias("n"))
    return {(r["query_id"], r["batch_id"]): r["n"] for r in counted.collect()}


def test_compaction_keeps_rows_and_leaves_the_last_batch_alone(spark, at):
    filled(spark, at("c"))
    before = content(spark, at("c"))
    assert compaction.compact_batches(spark, at("c")) == 6
    assert content(spark, at("c")) == before
    files = files_of(spark, at("c"))
    assert all(n == 1 for (_, batch), n in files.items() if batch < 3)
    assert all(n > 1 for (_, batch), n in files.items() if batch == 3)
    assert compaction.compact_batches(spark, at("c")) == 0


def test_a_batch_lies_in_as_many_files_as_its_size_asks_for(spark, at, monkeypatch):
    """Also a batch that is larger than what AQE takes for one task."""
    monkeypatch.setattr(compaction, "TARGET_PARTITION_BYTES", 20_000)
    rows = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("_id"),
                                      F.pmod("id", F.lit(6)).alias("batch_id"))
    write_micro_batch(rows.repartition(7), at("c"), "first")
    before = content(spark, at("c"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50000")
    try:
        assert compaction.compact_batches(spark, at("c"), target_bytes=1 << 40) == 5
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert files_of(spark, at("c")) == {("first", n): 7 if n == 5 else 1 for n in range(6)}
    assert content(spark, at("c")) == before
    # A batch has some 700 KB.
    write_micro_batch(rows.where("batch_id < 5").repartition(7), at("c"), "first")
    assert compaction.compact_batches(spark, at("c"), target_bytes=300_000) == 5
    assert set(files_of(spark, at("c")).values()) == {3, 7}
    assert content(spark, at("c")) == before


def test_a_replayed_last_batch_is_stored_once_after_compaction(spark, at):
    filled(spark, at("c"))
    before = content(spark, at("c"))
    compaction.compact_batches(spark, at("c"))
    write_micro_batch(spark.range(20).select(F.col("id").cast("string").alias("_id"),
                                             F.lit(3).alias("batch_id")), at("c"), "second")
    assert content(spark, at("c")) == before


@pytest.mark.parametrize("survived", [0, 1, 4])
def test_a_compaction_that_dies_while_replacing_is_finished(spark, at, monkeypatch, survived):
    filled(spark, at("c"))
    before, done, replace = content(spark, at("c")), [], compaction._replace

    def dying(files, staged, target):
        if len(done) == survived:
            files.delete(target, True)
            raise RuntimeError("lost")
        done.append(target)
        replace(files, staged, target)

    with monkeypatch.context() as patch:
        patch.setattr(compaction, "_replace", dying)
        with pytest.raises(RuntimeError, match="lost"):
            compaction.compact_batches(spark, at("c"))
    assert len(content(spark, at("c"))) == len(before) - 20
    compaction.finish_compaction(spark, at("c"))
    assert content(spark, at("c")) == before
    assert compaction.compact_batches(spark, at("c")) == 0


def test_a_compaction_that_dies_while_staging_changes_nothing(spark, at):
    filled(spark, at("c"))
    before = content(spark, at("c"))
    spark.range(3).write.parquet(at("c") + f"/{compaction.STAGE}/query_id=first/batch_id=0")
    assert content(spark, at("c")) == before
    assert compaction.compact_batches(spark, at("c")) == 6
    assert content(spark, at("c")) == before


def scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_keyed_reads_scan_few_row_groups(spark, at):
    rows = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("_id"), "id").repartition(20)
    append_documents(rows, at("keyed"), **keyed_options(4_000))
    append_documents(rows, at("plain"))
    ids = [r["_id"] for r in rows.where("id in (5, 30000)").collect()]
    found = read_ids(spark, at("keyed"), [*ids, "no such id"])
    assert sorted(r["id"] for r in found.collect()) == [5, 30000]
    assert scanned(found) <= 8_000
    # Random ids: bounds alone leave every row group in.
    assert scanned(read_ids(spark, at("keyed"), ["8" * 32])) <= 4_000
    assert read_ids(spark, at("plain"), ids).count() == 2
    assert read_ids(spark, at("keyed"), []).count() == 0


def frames(spark, n=500):
    return spark.range(n).select("id", F.concat(F.lit('{"station":"north-west","unit":"celsius","v":'),
                                                F.round(F.rand(7), 2), F.lit("}")).alias("text"))


def test_dictionary_shrinks_short_payloads_and_gives_them_back(spark, at):
    rows = frames(spark)
    # What is compressed is the payload, so that is what the dictionary is made of.
    trained = train_dictionary(rows.select(row_json(rows.columns).alias("payload")), "payload")
    assert rb'\"unit\":\"celsius\"' in trained.data
    plain, packed = batch_documents(rows), batch_documents(rows, dictionary=trained)
    sizes = [d.agg(F.sum("compressed_size")).first()[0] for d in (plain, packed)]
    assert sizes[1] * 2 < sizes[0]
    assert packed.select("metadata.dictionary").distinct().collect() == [(trained.id,)]
    store_dictionary(spark, at("d"), Dictionary(b"another"))
    store_dictionary(spark, at("d"), trained)
    again = load_dictionary(spark, at("d"), trained.id)
    texts = [sorted(map(tuple, unpack(d, ["_id"], dictionary=again).collect())) for d in (plain, packed)]
    assert texts[0] == texts[1]
    with pytest.raises(KeyError):
        load_dictionary(spark, at("d"), "unknown")


def test_another_dictionary_is_refused(spark):
    packed = batch_documents(frames(spark, 3), dictionary=Dictionary(b'{"station":"north-west"'))
    raw = bytes(packed.first()["data"])
    with pytest.raises(zlib.error):
        zlib.decompressobj(zdict=b"another").decompress(raw)


def test_dictionary_is_bounded_and_empty_without_common_text(spark):
    assert len(train_dictionary(frames(spark), "text", most_bytes=100).data) <= 100
    odd = spark.createDataFrame([(None,), ("",), ("short",), ("once upon a time there was",)], "text string")
    assert train_dictionary(odd, "text").data == b""
    with pytest.raises(ValueError):
        train_dictionary(odd, "text", most_bytes=40_000)


def test_dictionary_halves_payloads_whose_ids_and_times_have_many_values(spark):
    """What stands between values is common, though hardly any 16 characters around it are."""
    n, mixed = F.col("id"), lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))
    rows = spark.range(30_000).select(
        (n * 701).alias("event_id"),
        F.timestamp_micros(mixed(1, 1800 * 86_400_000_000) + 1_704_067_200_000_000).alias("ts"),
        mixed(2, 90_000).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("click", "view", "error"))), (mixed(3, 3) + 1).cast("int"))
        .alias("event_type"),
        (mixed(4, 15_000) / 100).alias("value"),
        F.format_string('{"k": %d}', mixed(5, 100)).alias("props"))
    trained = train_dictionary(rows.select(row_json(rows.columns).alias("payload")), "payload")
    sizes = [batch_documents(rows, id_col="event_id", dictionary=d).agg(
        F.sum("compressed_size")).first()[0] for d in (None, trained)]
    assert sizes[1] * 2 < sizes[0]
