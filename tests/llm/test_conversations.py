"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from docpress.llm import catalog, conversations
from docpress.llm.catalog import damaged
from docpress.llm.conversations import conversation_reports, repaired_turns

COLUMNS = "conv_id long, turn long, role string, text string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(symbols):
    """Best (cost, audit) by trying, before each row, up to two inserts and every edit."""
    best = {"": (0, "")}

    def inserted(ways):
        out = dict(ways)
        for _ in range(2):
            for state, (cost, audit) in list(out.items()):
                after = "a" if state == "u" else "u"
                out[after] = min(out.get(after, (10**9, "")), (cost + 3, audit + "I"))
        return out

    for row in symbols:
        ways = {}
        for state, (cost, audit) in inserted(best).items():
            found = [(state, cost + 4, audit + "D")]
            if row != "d":
                more = 3 if row.isupper() else 0
                if (state, row.lower()) in AFTER:
                    found.append((AFTER[state, row.lower()], cost + more, audit + "K"))
                found.append(("a" if state == "u" else "u", cost + more + 3, audit + "R"))
            for after, *way in found:
                ways[after] = min(ways.get(after, (10**9, "")), tuple(way))
        best = ways
    return min(w for s, w in inserted(best).items() if s in ("", "a"))


def plain(rows):
    """Results of the query for rows (conv_id, turn, role, text), by the rules' words."""
    out, convs = set(), {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                 hashlib.md5(r[2].encode()).digest()))
        seen, symbols, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            inside = re.sub("[\x20\x09-\x0d]", "", text)
            fault = ("blank" if not inside else "duplicate" if (role, text) in seen
                     else None if inside[-1] in ".!?" else "truncated")
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += ("d" if fault in ("blank", "duplicate")
                        else symbol.upper() if fault else symbol)
        cost, audit = cheapest(symbols)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                      for a, b in itertools.pairwise(kept))
        left, said, at = iter(kept), [], ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit in "IR":
                role = "assistant" if at == "u" else "user"
            if edit != "D":
                said.append(f"{role}:{text}")
                at = role[0]
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.add((conv, gaps, *faults.values(), illegal, cost, audit, digest))
    return out


def found(df):
    return {tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated",
                                        "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.fixture
def answer(spark, tmp_path):
    def run(rows):
        path = tmp_path / "conversations.parquet"
        spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as conv", "1 as kind").write.parquet(
            str(path))
        return catalog.queries()["op13_conversation_repair"](spark, str(tmp_path))
    return run


def test_cheapest_edits_of_all_short_conversations():
    for n in range(4):
        for rows in itertools.product("dsuaxSUAX", repeat=n):
            assert conversations.cheapest("".join(rows)) == cheapest(rows)


def test_pieces_give_what_the_whole_gives(monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 3)
    rng = random.Random(3)
    for _ in range(400):
        rows = "".join(rng.choice("dsuuuaaaxSUAX") for _ in range(rng.randrange(25)))
        search = conversations.Search()
        for row in rows:
            search.add(row)
        assert search.end() == cheapest(rows)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert found(catalog.queries()["op13_conversation_repair"](spark, sf_dir)) == plain(rows)


def test_odd_conversations(answer):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "cut of", "", " \n", None, "é?\x0b ", "more. and "]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = [(conv, rng.choice([0, 1, 2, 3, 4, 9, None]), rng.choice(roles), rng.choice(texts))
            for conv in [*range(60), None] for _ in range(rng.randrange(1, 9))]
    rows += rows[:40]
    # Conversations of which no row is left: all dropped, or all blank.
    gone = [(c, 1, "user", "Hi.") for c in range(100, 200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    assert gone
    rows += gone + [(200, 1, "user", " "), (201, None, None, None)]
    assert found(answer(rows)) == plain(rows)
    assert any(r[2:] == (0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in plain(gone))


def test_one_conversation_holds_most_rows(answer):
    rng = random.Random(5)
    rows = [(None, rng.randrange(900), rng.choice(["user", "assistant"]), f"Text {rng.randrange(700)}.")
            for _ in range(2000)] + [(n, 0, "user", "Hi.") for n in range(100)]
    assert found(answer(rows)) == plain(rows)


def test_empty_table_and_long_text(spark, answer):
    empty = spark.createDataFrame([], COLUMNS)
    reports = conversation_reports(empty)
    assert reports.collect() == [] == repaired_turns(empty, reports).collect()
    rows = [(7, 1, "user", "long " * 4_000_000 + "?"), (7, 2, "assistant", "Short.")]
    assert found(answer(rows)) == plain(rows)


def test_repaired_turns_are_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 2, "user", "And?"),
                                  (1, 3, "assistant", "Well.")], COLUMNS)
    reports = conversation_reports(rows)
    assert [tuple(r)[1:] for r in reports.collect()] == [(3, 1, 0, 0, 0, 1, 3, "KIKK")]
    turns = repaired_turns(rows, reports).select("place", "role", "text").collect()
    assert sorted(map(tuple, turns)) == [
        (0, "user", "Hi."), (1, "assistant", ""), (2, "user", "And?"), (3, "assistant", "Well.")]
    assert damaged(rows.limit(0)).collect() == []
