"""Each operator against a plain version of it."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docpress.llm import crf, decontamination, language, licenses, pii, sharding, simhash, sketches
from docpress.llm import substrings
from docpress.llm.lines import drop_repeated_lines
from docpress.llm.packing import pack_documents, piece_lengths
from docpress.llm.tokens import Encoder
from tests.llm import brute


def test_shards_are_as_small_as_they_can_be(small, monkeypatch):
    df, rows = small
    groups = {}
    for i, text in sorted(rows):
        groups[text] = groups.get(text, 0) + len(text.encode()) + 16
    for shards, cells in ((7, 16_384), (3, 40)):  # few cells take several rounds
        monkeypatch.setattr(sharding, "SEARCH_CELLS", cells)
        found = sharding.shard_documents(df, shards=shards).collect()
        held = {}
        for r in found:
            held.setdefault(r["shard"], []).append(r)
        assert max(sum(r["size"] for r in rs) for rs in held.values()) == brute.smallest_capacity(
            list(groups.values()), shards)
        for rs in held.values():
            rs.sort(key=lambda r: r["slot"])
            assert [r["slot"] for r in rs] == list(range(len(rs)))
            assert [r["doc_id"] for r in rs] == sorted(r["doc_id"] for r in rs)
        text_of, shard_of = dict(rows), {}
        for r in found:
            assert shard_of.setdefault(text_of[r["doc_id"]], r["shard"]) == r["shard"]


@pytest.mark.parametrize("shards, cells", [(7, 16_384), (40, 16_384), (12, 60)])
@pytest.mark.parametrize("hot", [0, 300, 3000])
def test_shards_are_levelled_below_the_capacity(docs, monkeypatch, shards, cells, hot):
    monkeypatch.setattr(sharding, "SEARCH_CELLS", cells)
    monkeypatch.setattr(sharding, "CELLS_PER_SQUARED_SHARD", 1)
    rows = [(i, "x" * (i * 37 % 101) + str(i)) for i in range(600)]
    rows += [(1000 + i, "the same text in many rows") for i in range(hot)] + [(250, "the same text in many rows")]
    found = sharding.shard_documents(docs(rows), shards=shards).collect()
    text_of, groups = {}, {}
    for i, text in sorted(rows):
        groups[text] = groups.get(text, 0) + len(text) + 16
    plain = [sum(g) for g in brute.levelled_shards(list(groups.values()), shards)]
    held = [0] * shards
    for r in found:
        held[r["shard"]] += r["size"]
    assert held == plain
    assert min(held) > 0


def test_more_shards_than_groups_leave_some_empty(docs):
    found = sharding.shard_documents(docs([(1, "a"), (2, "a"), (3, "bb")]), shards=5).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in found) == [(1, 0), (2, 0), (3, 1)]


@pytest.mark.parametrize("expression, value", [
    ("MIT", (0.2, ["mit"])), ("mit or GPL-2.0-only", (0.2, ["gpl", "mit"])),
    ("MIT AND GPL-3.0+", (0.7, ["gpl", "mit"])),
    ("MIT OR GPL-2.0 AND AGPL-3.0", (0.2, ["agpl", "gpl", "mit"])),
    ("(MIT OR GPL-2.0) AND AGPL-3.0", (0.8, ["agpl", "gpl", "mit"])),
    ("GPL-2.0-only WITH Classpath-exception-2.0", (0.5, ["gpl"])),
    ("Apache-2.0 */ and so on", (0.2, ["apache"])), ("Apache-2.0 the rest is prose", (0.2, ["apache"])),
    ("", None), ("OR MIT", None), ("(MIT", None), ("MIT AND", None), (")", None),
])
def test_licence_expressions(expression, value):
    assert licenses.evaluate(expression) == value


def test_licence_places(docs):
    text = ("CC-BY cc by\nGNU General Public\tLicense!\nALL rights-reserved. "
            "SPDX-License-Identifier: MIT OR Apache-2.0\nrights reserved, cc  by-nc éall")
    row = licenses.scan_licenses(docs([(1, text)])).first()
    base = [(p["label"], p["word"]) for p in row["places"] if p["base"]]
    assert base == [("cc-by", 0), ("cc-by", 2), ("gpl", 5), ("reserved", 8), ("cc-by", 21)]
    assert row["labels"] == ["apache", "cc-by", "cc-by-nc", "gpl", "mit", "reserved"]
    assert (row["n_words"], row["score"]) == (25, 1.0)


def test_repeated_lines_go(small):
    df, rows = small
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        found = drop_repeated_lines(df, batches=batches, fanout=fanout).select(
            "doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
        assert set(map(tuple, found)) == brute.kept_lines(rows)


def test_line_keys(docs):
    rows = [(3, "\x0b A Line Of Ten\r\nÉtoiles du nord\nshort\nfresh and new line"),
            (1, "a line of ten\nétoiles du nord\nshort"), (7, "A LINE OF TEN\nA LINE OF TEN\n\n")]
    found = drop_repeated_lines(docs(rows), batches=2).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert set(map(tuple, found)) == brute.kept_lines(rows)


@pytest.mark.parametrize("width, radius", [(4, 4), (5, 7)])
def test_simhash_components(small, width, radius, monkeypatch):
    df, rows = small
    want = brute.fingerprint_components(rows, width, radius)
    for dense in (64, 0):  # none, and all, through shared points first
        monkeypatch.setattr(simhash, "DENSE", dense)
        found = simhash.simhash_components(df, width=width, radius=radius).collect()
        assert {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found} == want


def test_components_of_a_path_and_a_hub(spark):
    from docpress.llm.components import components
    path = [(i, i + 1) for i in range(100, 160)]
    links = spark.createDataFrame([*path, *[(7, i) for i in range(200, 260)], (5, 7)], "a long, b long")
    roots = dict(map(tuple, components(links).collect()))
    assert {roots[i] for i in range(100, 161)} == {100}
    assert {roots[i] for i in (5, 7, *range(200, 260))} == {5}


def test_thresholds_cost_least():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    costs = [np.vstack([np.zeros(50), np.sort(rng.random((3, 50)) * 100, axis=0)]) for _ in range(4)]
    units = simhash.allot(costs, 5)
    assert (units.sum(axis=0) == 5).all()
    for row in range(50):
        price = sum(c[u, row] for c, u in zip(costs, units[:, row]))
        assert price == pytest.approx(min(
            sum(c[u, row] for c, u in zip(costs, deal))
            for deal in itertools.product(range(4), repeat=4) if sum(deal) == 5))


def test_leaks_in_real_documents(spark, small):
    df, rows = small
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = decontamination.contaminated(df, bench).collect()
    assert {(*r[:4], round(r[4], 9)) for r in map(tuple, found)} == brute.leaks(
        rows, [tuple(r) for r in bench.collect()])


def test_leaks_of_all_sizes(spark, docs):
    rng = random.Random(5)

    def make(n):
        return [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n)]

    items = [(i, " ".join(make(rng.choice([1, 3, 5, 6, 12, 20, 40])))) for i in range(15)]
    items += [(30, None), (31, "")]
    rows = [(500, None)]
    for d in range(60):
        w, v = make(rng.randint(0, 40)), items[d % 15][1].split()
        if len(v) > 6 and d % 3:
            v[rng.randrange(len(v))] = "zz" if d % 2 else v[0]
        p = rng.randint(0, len(w))
        rows.append((d, " ".join(w[:p] + v + w[p:]) if d % 4 else " ".join(v[:-1])))
    found = decontamination.contaminated(
        docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(*r[:4], round(r[4], 9)) for r in map(tuple, found)} == brute.leaks(rows, items)


def test_patterns_of_personal_data():
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab.@1234567890-+ (). é\n") for _ in range(rng.randint(0, 80)))
           for _ in range(5000)]
    odd += ["4111 1111 1111 1111", "+1 (988) 555-2485 x", "0001.2.3.4 255.255.255.0256",
            "a@b.c@d.e.f", "1." * 3000, "a" * 3000 + "@", "9" * 3000]
    for text in odd:
        assert pii.base_spans(text) == brute.patterns(text, pii.luhn)


def test_field_learns_its_table_and_finds_more():
    field = crf.train()
    runs, labels = crf.labelled_runs(crf.LABELLED)
    assert all(list(a) == b for a, b in zip(field.decode(runs), labels))
    texts = ["Tel (0201) 555 1234 ok", "é mail jösé@post.example.de, 12", "v 1.2.3 on 2024-01-31"]
    found = pii.crf_spans(pa.array(texts), field)
    assert [[(k, t[a:b]) for a, b, k in s] for t, s in zip(texts, found)] == [
        [("phone", "(0201) 555 1234")], [("email", "jösé@post.example.de")], []]


def test_field_gradient_is_right():
    import numpy as np
    runs, labels = crf.labelled_runs(crf.LABELLED[:12])
    rng = np.random.default_rng(3)
    field = crf.Crf(rng.normal(size=(crf.FEATURES, 5)) * 0.1, rng.normal(size=(5, 5)) * 0.1)
    _, emission, transition = field.log_likelihood(runs, labels)
    feature = runs[0][0][0]
    for weights, gradient, at in ((field.emission, emission, (feature, 1)),
                                  (field.transition, transition, (0, 1))):
        weights[at] += 1e-5
        up = field.log_likelihood(runs, labels)[0]
        weights[at] -= 2e-5
        down = field.log_likelihood(runs, labels)[0]
        weights[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(gradient[at], abs=1e-4)


def test_personal_data_keeps_base_spans(small):
    df, rows = small
    texts = dict(rows)
    for r in pii.find_personal_data(df).collect():
        base = [(s["start"], s["end"], s["kind"]) for s in r["base"]]
        assert base == brute.patterns(texts[r["doc_id"]], pii.luhn)
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_edited_fingerprints(small):
    df, rows = small
    rows = sorted(rows)
    near = []
    for r in sketches.edited_fingerprints(df).collect():
        n = next(i for i, (d, _) in enumerate(rows) if d == r["doc_id"])
        text, after = rows[n][1], rows[(n + 1) % len(rows)][1]
        quarter = len(text) // 4
        assert r["n_chars"] == len(text)
        assert r["edited"] == text[:len(text) - quarter] + after[:quarter]

        def shingles(t):
            w = t.split()
            return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))}

        a, b = shingles(text), shingles(r["edited"])
        near.append(abs(len(a & b) / len(a | b) - r["near_edited"]))
    assert sum(near) / len(near) < 0.1


def test_sketches_merge_and_contain(spark):
    part, rest = " ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(4000))
    df = spark.createDataFrame([(part, f"{rest} {part}", rest)], "a string, b string, c string")
    row = df.select(*(sketches.sketch(F.col(c)).alias(c) for c in "abc")).select(
        sketches.containment(F.col("a"), F.col("b")).alias("inside"),
        sketches.containment(F.col("a"), F.col("c")).alias("outside"),
        F.size(F.array_except(sketches.merged(F.col("a"), F.col("c")), "b")).alias("lost")).first()
    assert (row["inside"], row["outside"], row["lost"]) == (1.0, 0.0, 0)


def test_language_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(df.where("doc_id % 2 = 0"), texts=50)
    found = language.identify_languages(df.where("doc_id % 2 = 1"), model, host_col="source")
    known = found.join(df.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert known.where("lang = truth and accepted").count() >= 0.99 * known.count()


def test_language_evidence_breaks_ties(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(df)
    pages = [(i, f"http://h.example.com/{lang}/{i}", f"<html lang='{lang}'><p>{text}</p>")
             for i, (lang, text) in enumerate([("de", "in"), ("fr", "in"), ("de", "xq zj kw qqx")])]
    found = language.identify_languages(
        spark.createDataFrame(pages, "page_id long, url string, html string"), model,
        id_col="page_id", text_col="html", url_col="url", html=True).collect()
    assert {r["doc_id"]: (r["declared"], r["suffix"], r["host"]) for r in found}[0] == (
        "de", "de", "h.example.com")


@pytest.mark.parametrize("width", [5, 20])
def test_repeated_windows_go(docs, width, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(90, None), (91, "a " * 50), (92, "b\n" * 40)]
    for hot in (2, 2_000):
        monkeypatch.setattr(substrings, "HOT", hot)
        found = substrings.drop_repeated_windows(docs(rows), width=width).collect()
        assert {(r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["text"]))
                for r in found} == brute.kept_words(rows, width)
        for r in found:
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_repeated_windows_of_real_documents(small):
    df, rows = small
    found = substrings.drop_repeated_windows(df).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["text"]))
            for r in found} == brute.kept_words(rows, 20)


def test_token_ids_are_those_of_whole_texts():
    import public_tokenizers
    rng = random.Random(1)
    texts = ["", " ", "a  b", " a", "a ", "a. \n\nB, c d.", "foo <|endoftext|> bar", "it's we'll",
             "a\tb c\td", "12,345.67 a1, b2. x;", "a×b÷c é× ß'll", "x" * 300 + " y"]
    texts += ["".join(rng.choice("ab é,.\n\t '1 　ß-×÷\x85\x1dÃs") for _ in range(rng.randint(0, 40)))
              for _ in range(3000)]
    for slots in (1 << 21, 1 << 8):  # with room for all words, and with hardly any
        encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), slots)
        for at in range(0, len(texts), 500):
            part = texts[at:at + 500]
            ids, ends = encoder.encode(pa.array(part))
            whole = encoder.tokenizer.encode_batch(part, add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in whole]


def test_pieces_make_up_their_documents(small):
    import numpy as np
    df, rows = small
    import public_tokenizers
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    found = pack_documents(df).collect()
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        assert r["length"] <= 1024 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
    assert len({r["sequence_id"] for r in found}) == len(found)
    for i, text in rows[:60]:
        own = sorted(pieces[i], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist()
        assert ids == [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:n]) for n in range(len(own))]


def test_piece_lengths():
    assert piece_lengths(1, 1024) == [1]
    assert piece_lengths(2048 + 5, 1024) == [1024, 1024, 4, 1]
    assert piece_lengths(1023, 1024) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1]
