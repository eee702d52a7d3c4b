from __future__ import annotations

import datetime as dt

import pytest

from docpress.operators.documents import frame_documents, split_rejects

AT = dt.datetime(2024, 1, 1)

# value -> (temperature, quality, type, data is NULL)
EDGES = {
    None: (None, None, None, True),
    "": (None, None, None, True),
    "not json": (None, None, None, False),
    '{"temperature":1': (None, None, None, False),
    '[{"temperature":2}]': (None, None, None, False),
    '{"temperature":"abc","metadata":{"type":"x"}}': (None, None, "x", False),
    '{"temperature":1.5,"metadata":{"quality":3,"type":"é"}}': (1.5, 3, "é", False),
    '{"temperature":2,"extra":{"a":[1]},"metadata":{"tags":["t"],"quality":4}}': (2.0, 4, None, False),
    "{}": (None, None, None, False),
}
REJECTED = {"not json", '{"temperature":1', '[{"temperature":2}]',
            '{"temperature":"abc","metadata":{"type":"x"}}'}


@pytest.fixture
def frames(spark):
    rows = [(bytearray(f"k{i}".encode()), None if v is None else bytearray(v.encode()), AT)
            for i, v in enumerate(EDGES)]
    return spark.createDataFrame(rows, "key binary, value binary, timestamp timestamp")


def test_documents_of_edge_values(frames):
    rows = {r["key"]: r for r in frame_documents(frames).collect()}
    for i, (value, expected) in enumerate(EDGES.items()):
        row = rows[f"k{i}"]
        temperature, quality, kind, missing = expected
        assert row["timestamp"] == AT
        if missing:
            assert row["data"] is None
            assert row["compressed_data"] is None
            assert (row["original_size"], row["compressed_size"], row["compression_ratio"]) == (0, 0, None)
            continue
        assert row["data"]["temperature"] == temperature, value
        metadata = row["data"]["metadata"]
        assert (metadata and metadata["quality"], metadata and metadata["type"]) == (quality, kind), value
        assert row["original_size"] == len(value.encode())
        assert row["compressed_size"] > 0


def test_size_unit_of_the_stream(frames):
    text = '{"temperature":1.5,"metadata":{"quality":3,"type":"é"}}'
    place = list(EDGES).index(text)
    row = frame_documents(frames, size_unit="chars").where(f"key = 'k{place}'").first()
    assert row["original_size"] == len(text) == len(text.encode()) - 1


def test_rejects_carry_their_text(frames):
    parsed, rejected = split_rejects(frames)
    assert {r["corrupt_record"] for r in rejected.collect()} == REJECTED
    assert {r["raw_value"] for r in parsed.collect()} == set(EDGES) - REJECTED
    assert "_corrupt_record" not in parsed.select("data.*").columns
    assert parsed.count() + rejected.count() == frames.count()
