"""Stages of the pipeline against plain versions, on rows with known verdicts."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from docpress.llm import decontamination
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], COLUMNS)


def edited(rng, text, likeness):
    """``text`` with its last words new, so that about ``likeness`` of the shingles stay."""
    words = text.split()
    # n shingles, k of them lost on either side: (n - k) / (n + k) is the likeness.
    lost = int((len(words) - 4) * (1 - likeness) / (1 + likeness))
    return " ".join(words[:len(words) - lost] + [f"n{rng.randrange(10**9)}" for _ in range(lost)])


def test_near_dedup_keeps_one_of_each_component(spark, small):
    rng = random.Random(5)
    rows = list(small[1])
    for n, (_, text) in enumerate(small[1][:40]):
        rows += [(10**6 + 10 * n + k, edited(rng, text or "", likeness))
                 for k, likeness in enumerate((0.8, 0.9, 0.97, 1.0))]
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, frame(spark, rows), SF).collect()}
    assert kept == {head for _, _, head in brute.fingerprint_components(rows, 4, 4)}
    assert len(kept) < len(rows) - 40


def texts_after(stage, spark, rows):
    found = stage(spark, frame(spark, rows), SF).select("doc_id", "text").collect()
    return sorted(((r["doc_id"], r["text"]) for r in found), key=str)


def test_near_dedup_judges_rows(spark):
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(104)) for x in "abcd")
    near = a + " "
    rows = [(1, a), (None, near), (None, b), (None, b), (None, c),  # a bad row, copies, a clean row
            (7, near), (7, d), (7, d), (7, c)]
    assert texts_after(corpus_pipeline.dedup_near, spark, rows) == sorted(
        [(1, a), (None, b), (7, d), (7, c)], key=str)


def test_decontamination_judges_rows(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    bad, one, other = f"New words here. {leak} And more.", "A clean text.", "Another clean text."
    rows = [(None, bad), (None, one), (3, bad), (3, other), (4, bad), (5, one)]
    assert texts_after(corpus_pipeline.decontaminate, spark, rows) == sorted(
        [(None, one), (3, other), (5, one)], key=str)


def test_language_judges_rows(spark, small):
    one, other = (r["text"] for r in small[0].where("lang = 'en' and n_chars > 300").orderBy(
        "doc_id").limit(2).collect())
    strange = "xqzjk wvkq zzxq jjqk qqx wvvk"
    rows = [(None, strange), (None, one), (-5, other), (-5, strange), (-5, "")]
    docs = frame(spark, rows).unionByName(small[0])
    kept = corpus_pipeline.identify(spark, docs, SF).where("doc_id is null or doc_id < 0")
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(None, one), (-5, other)}


def test_leaks_with_distant_fingerprints_are_found(docs):
    """op4: a passage 0.8 alike whose SimHash is more than 16 bits from the item's."""
    rng = random.Random(9)

    def print_of(texts):
        batch = pa.RecordBatch.from_pydict({"item_id": list(range(len(texts))), "text": texts})
        found = {}
        for out in decontamination._items(iter([batch])):
            found |= dict(zip(out.column("item_id").to_pylist(), out.column("fp").to_pylist()))
        return np.array([found[n] for n in range(len(texts))]).view(np.uint64)

    items = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(24)) for _ in range(6000)]
    near_by = [t.rsplit(" ", 2)[0] + f" x{n} y{n}" for n, t in enumerate(items)]  # 18 of 22
    apart = np.bitwise_count(print_of(items) ^ print_of(near_by))
    at = np.flatnonzero((apart > 16) & (apart <= 23))[:5].tolist()
    assert at
    found = decontamination.contaminated(
        docs([(n, near_by[n]) for n in at]),
        docs([(n, items[n]) for n in at]).withColumnRenamed("doc_id", "item_id"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(n, n) for n in at}


class Shared:
    """A broadcast value on the driver."""

    def __init__(self, value):
        self.value = value


def test_a_text_that_repeats_an_item_takes_bounded_memory(monkeypatch):
    """op4: 2 MB of one 100-word item; every word starts a window that is alike."""
    rng = random.Random(4)
    item = " ".join(f"word{rng.randrange(10**6)}" for _ in range(100))
    batch = pa.RecordBatch.from_pydict({"item_id": [1], "text": [item]})
    plain = next(decontamination._items(iter([batch]))).column("plain").flatten().to_numpy()
    grams = plain.view(np.uint64)
    table = np.zeros(1 << 10, np.uint64)
    for h in (*grams, *decontamination._sized(grams, 100)):
        table[int(h) % (1 << 16) >> 6] |= np.uint64(1) << (h & np.uint64(63))
    text = pa.RecordBatch.from_pydict({"key": [7], "text": [" ".join([item] * (2 * 10**6 // len(item)))]})
    tracemalloc.start()
    out = list(decontamination._window_maker(Shared(table), [100], 0.8)(iter([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    starts = np.concatenate([b.column("start").to_numpy() for b in out])
    assert starts.tolist() == list(range(100))  # one rotation of the item each

    monkeypatch.setattr(decontamination, "PIECE", 1000)
    pieces = list(decontamination._window_maker(Shared(table), [100], 0.8)(iter([text])))
    assert len(pieces) > 5 and pa.Table.from_batches(pieces).equals(pa.Table.from_batches(out))
