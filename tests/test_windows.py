from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docpress.operators.counters import counter_rate
from docpress.operators.windows import (
    documents_total, processing_rate, ratio_by_window, slide, time_buckets)
from tests.plans import final, physical

START = dt.datetime(2024, 1, 1, 23, 50)


@pytest.fixture
def events(spark):
    """(seconds after START, bytes, ratio); two days, one bucket with a third of all rows."""
    rows = [(i * 17, 10 + i, 1.0 + i % 3) for i in range(100)]
    rows += [(600, 5, None)] * 50
    return spark.createDataFrame(
        [(START + dt.timedelta(seconds=s), b, r) for s, b, r in rows],
        "timestamp timestamp_ntz, original_size bigint, compression_ratio double")


def brute(rows, width, step):
    """Sum every row into every window that covers it."""
    totals = defaultdict(lambda: [0, 0, 0.0, 0])
    epoch = dt.datetime(1970, 1, 1)
    for ts, size, ratio in rows:
        at = (ts - epoch).total_seconds()
        start = at // step * step
        while start > at - width:
            t = totals[epoch + dt.timedelta(seconds=start)]
            t[0] += 1
            t[1] += size
            if ratio is not None:
                t[2] += ratio
                t[3] += 1
            start -= step
    return {w: (n, b, b / width, pytest.approx(r / c) if c else None)
            for w, (n, b, r, c) in totals.items()}


@pytest.mark.parametrize("width, step", [(300, 30), (300, 300), (60, 20), (86400, 3600)])
def test_rates_equal_brute_force(events, width, step):
    rates = processing_rate(events, width=width, step=step).collect()
    found = {r["window_start"]: (r["n_docs"], r["n_bytes"], r["bytes_per_sec"], r["avg_ratio"])
             for r in rates}
    assert found == brute(map(tuple, events.collect()), width, step)
    assert len(found) == len(rates)


def test_window_must_hold_whole_buckets(events):
    with pytest.raises(ValueError, match="whole number"):
        slide(time_buckets(events), width=100, step=30)


def test_rows_are_combined_before_they_are_multiplied(events):
    plan = physical(processing_rate(events))
    scan_side = plan[plan.index("Generate"):]
    assert "HashAggregate" in scan_side and "Exchange" in scan_side


def test_mean_ratio_and_count_per_window(events):
    rows = ratio_by_window(events, width=300).collect()
    assert sum(r["n_docs"] for r in rows) == 150
    assert rows[0].asDict().keys() == {"window_start", "avg_ratio", "n_docs"}


def test_running_total_crosses_days(events):
    rows = documents_total(events, width=300).orderBy("window_start").collect()
    assert len({r["window_start"].date() for r in rows}) == 2
    running = 0
    for row in rows:
        running += row["n_docs"]
        assert row["total_docs"] == running
    assert running == 150


def test_running_total_counts_documents_once(events, spark, at):
    events.repartition(4).write.parquet(at("e"))
    plan = final(documents_total(spark.read.parquet(at("e"))))
    ran = plan[:plan.index("Initial Plan")]
    assert ran.count("FileScan") == 1 and "ReusedExchange" in ran


def test_empty_input_has_no_windows(events):
    nothing = events.where(F.lit(False))
    assert processing_rate(nothing).count() == 0
    assert documents_total(nothing).count() == 0


def test_documents_without_a_time_are_kept(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:00:10", 5), (None, 7), (None, 1), ("2024-01-02 00:00:00", 2)],
        "timestamp string, original_size bigint").withColumn(
            "timestamp", F.col("timestamp").cast("timestamp")).withColumn(
            "compression_ratio", F.lit(2.0))
    totals = {r["window_start"]: r["total_docs"] for r in documents_total(df).collect()}
    assert totals[None] == 2 and max(totals.values()) == 4
    for step in (30, 300):
        untimed = processing_rate(df, step=step).where("window_start is null").collect()
        assert [(r["n_docs"], r["n_bytes"]) for r in untimed] == [(2, 8)]


def test_counter_rate_over_windows_spans_and_resets(spark):
    """Against one scan of each series; NULL times, values and series included."""
    rng = random.Random(1)
    rows = []
    for n in range(3000):
        series = rng.choice(["hot", "hot", "hot", "cold", None])
        at = None if rng.random() < 0.05 else rng.randrange(60 * 86400)
        rows.append((series, at, None if rng.random() < 0.05 else rng.randrange(1000), n))
    want, last = {}, {}
    for series, at, value, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        window = None if at is None else at - at % 300
        cell = want.setdefault((series, window), [0, 0, 0])
        cell[0] += 1
        if value is not None:
            before = last.get(series)
            if before is not None:
                cell[1] += value - before if value >= before else value
                cell[2] += value < before
            last[series] = value
    df = spark.createDataFrame(rows, "series string, at long, value long, n long").selectExpr(
        "series", "timestamp_seconds(at) as timestamp", "value", "n")
    found = counter_rate(df, series="series", value="value", order_by=["n"]).selectExpr(
        "series", "unix_seconds(window_start) as at", "n_samples", "increase", "resets", "per_sec")
    got = {(r["series"], r["at"]): [r["n_samples"], r["increase"], r["resets"]] for r in found.collect()}
    assert got == want
    assert counter_rate(df.limit(0), series="series", value="value").collect() == []
