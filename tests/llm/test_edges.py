"""Nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import ast
import random
import re
import time
from pathlib import Path

import pytest

import corpus_pipeline
from docpress.llm import catalog, language, licenses, pii, sharding, simhash, sketches, substrings
from docpress.llm.decontamination import contaminated
from docpress.llm.lines import drop_repeated_lines
from docpress.llm.packing import pack_documents


def leaks(df):
    return contaminated(df, df.selectExpr("doc_id as item_id", "text", "'x' as key"))


def languages(df):
    return language.identify_languages(df, language.fit(df), declared_col="lang", host_col="source")


ONE_ROW_EACH = {
    "sharding": lambda df: sharding.shard_documents(df, shards=3),
    "licenses": licenses.scan_licenses,
    "lines": lambda df: drop_repeated_lines(df, carry=["lang", "pos"]),
    "pii": pii.find_personal_data,
    "simhash": simhash.simhash_components,
    "fingerprints": sketches.fingerprint_documents,
    "edited": sketches.edited_fingerprints,
    "languages": languages,
    "windows": substrings.drop_repeated_windows,
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_odd_rows_are_all_returned(odd, name):
    ids = [r["doc_id"] for r in ONE_ROW_EACH[name](odd).select("doc_id").collect()]
    want = [r["doc_id"] for r in odd.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_empty_tables_give_no_rows(odd, name):
    assert ONE_ROW_EACH[name](odd.limit(0)).collect() == []


def test_odd_rows_are_packed(odd):
    rows = pack_documents(odd).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 9, 10, None}
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 1] == [1]
    assert pack_documents(odd.limit(0)).collect() == []


def test_odd_rows_leak_into_themselves(odd):
    found = {(r["doc_id"], r["item_id"]) for r in leaks(odd).collect()}
    assert {(4, 4), (5, 5), (9, 9), (None, None)} <= found and not {1, 2, 3} & {d for d, _ in found}
    assert leaks(odd.limit(0)).collect() == [] and contaminated(
        odd, odd.limit(0).selectExpr("doc_id as item_id", "text")).collect() == []


def test_odd_rows_have_defined_results(odd):
    lines = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"]) for r in
             drop_repeated_lines(odd).collect()}
    assert lines[1, ""] == (1, 0)
    assert lines[5, "the same line of text here\nthe same line of text here"] == (2, 0)
    prints = {r["doc_id"]: (r["fp"], r["component_id"]) for r in
              simhash.simhash_components(odd).where("doc_id < 5").collect()}
    assert prints[1] == prints[2] == prints[3] == (0, 1)
    windows = {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeated_windows(odd).collect()}
    assert windows[9] == 30_000 - 1 and windows[1] == 0
    spoken = {r["doc_id"]: (r["lang"], r["accepted"]) for r in languages(odd).collect()}
    assert not spoken[1][1] and not spoken[2][1] and spoken[9][1]


def test_pipeline_takes_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "lang", "source", "1L as n_chars")
    for rows in (docs, docs.limit(0)):
        current = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, current, "/root/testdata/sf0.001")
            assert after.dtypes == docs.dtypes, name
            current = after
        corpus_pipeline.STAGES[-1][1](spark, current, "/root/testdata/sf0.001").collect()


def test_pipeline_removes_copies_leaks_and_foreign_texts(spark, small):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leak = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    clean = base.orderBy("doc_id").limit(5).collect()
    planted = [
        (9001, clean[2]["text"], "en", "src1", 1),                      # an exact copy
        (9002, f"New words here. {leak} And more.", "en", "src1", 1),   # a benchmark passage
        (9003, "xqzjk wvkq zzxq jjqk qqx wvvk", "en", "src1", 1),       # no language
    ]
    docs = base.unionByName(spark.createDataFrame(planted, base.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not kept & {9001, 9002, 9003}
    assert {r["doc_id"] for r in clean} <= kept


def test_native_operators_run_no_python():
    for name in ("sharding", "lines", "sketches"):
        source = Path(catalog.__file__).with_name(f"{name}.py").read_text()
        called = {n.attr for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Attribute)}
        assert not called & {"mapInArrow", "mapInPandas", "applyInPandas", "rdd", "udf",
                             "pandas_udf", "arrow_udf", "toPandas", "toArrow"}


def test_sql_of_line_dedup(spark):
    from tests import oracle
    sf_dir = "/root/testdata/sf0.01"
    for name, sql in catalog.oracle_sql().items():
        con = oracle.connect(sf_dir)
        df = catalog.queries()[name](spark, sf_dir)
        assert not oracle.type_differences(df, con, sql)
        assert oracle.spark_rows(df) == oracle.sql_rows(con, sql)


def test_pages_with_open_marks_are_read_in_one_scan():
    old = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)
    rng = random.Random(1)
    parts = ["<", ">", "<!--", "-->", "<script", "</script >", "<STYLE x>", "</style\n>", " a ", "/", "<b>"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert language.without_markup(page) == old.sub(" ", page), page
    began = time.time()
    for part in ("<!--", "<script ", "<", "<html ", "<html lang "):
        page = part * (5_000_000 // len(part))
        assert language.without_markup(page) == page and language.declared_language(page) is None
    assert time.time() - began < 20


def test_language_fit_is_bounded(spark):
    rows = [(None, "the same", "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # With every text alike, all that the model saw is one of them, however often it repeats.
    once = language.fit(docs.limit(1), texts=50)
    often = language.fit(docs, texts=50)
    assert (once.weights == often.weights).all()


def test_windows_of_rows_without_ids(docs):
    """Rows under one id, or none, are documents of their own."""
    rows = [(None, f"own{n} " + " ".join(f"w{n}x{k}" for k in range(30))) for n in range(4000)]
    passage = " ".join(f"p{k}" for k in range(25))
    rows += [(None, f"{passage} tail{n}") for n in range(50)] + [(3, passage), (3, "x " + passage)]
    found = substrings.drop_repeated_windows(docs(rows)).select("doc_id", "n_words", "n_removed").collect()
    assert len(found) == len(rows)
    removed = sorted(r["n_removed"] for r in found if r["n_words"] in (25, 26))
    # One of the two rows with an id keeps the passage, no other row does.
    assert removed == [0] + [25] * 51
    assert sum(r["n_removed"] for r in found) == 25 * 51
