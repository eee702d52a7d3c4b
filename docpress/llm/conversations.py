"""Conversation structure repair: the cheapest edits of each conversation, by
iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docpress.llm.common import slices

# What an edit costs, and an undeleted truncated row beside it.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 4, 3, 0, 3, 3
# Rows that one search spans; longer conversations are searched piece by piece.
PIECE = 16

# Where a conversation stands: nothing yet, after a system, user or assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_AFTER = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
         (ASSISTANT, "u"): USER}
_LEGAL = ("su", "ua", "au")

# A row to the search: d must be deleted; s, u, a and x (any other role) may stay, and
# in capitals if truncated. The least that each costs:
_LEAST = {"d": DELETE, "s": 0, "u": 0, "a": 0, "x": REROLE, "S": TRUNCATED, "U": TRUNCATED,
          "A": TRUNCATED, "X": min(DELETE, REROLE + TRUNCATED)}


def _edits(rows: str, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edit, cost, next row and state, in ASCII order of the edits."""
    row = rows[at] if at < len(rows) else None
    if row:
        yield "D", DELETE, at + 1, state
    wanted = _AFTER[_WANTED[state]]
    yield "I", INSERT, at, wanted
    if row and row != "d":
        more = TRUNCATED if row.isupper() else 0
        after = _KEPT.get((state, row.lower()))
        if after is not None:
            yield "K", KEEP + more, at + 1, after
        yield "R", REROLE + more, at + 1, wanted


@lru_cache(maxsize=1 << 16)
def cheapest(rows: str, entry: int = START, leave: int | None = None) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way through ``rows``; of equal ones the ASCII-least.

    Iterative-deepening A*: depth-first in ASCII order of the edits, under a cost bound
    that grows to the least cost seen beyond it. A table of failed (row, state) keeps
    the budget that failed there. Every path within the final bound costs just the
    bound, so the first one found is the least in ASCII order.

    ``leave=None`` ends the conversation, after an assistant row or empty. Otherwise the
    way leads to that state right after the last row, without an insert behind it; None
    if there is none.
    """
    if leave == START and entry != START:
        return None
    if leave == SYSTEM and entry != SYSTEM and not (entry == START and set(rows) & set("sS")):
        return None
    need = [0] * (len(rows) + 1)
    for n in range(len(rows) - 1, -1, -1):
        need[n] = need[n + 1] + _LEAST[rows[n]]
    bound = need[0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond = [1 << 60]

        def search(at: int, state: int, budget: int) -> str | None:
            ended = at == len(rows)
            if ended and (state == leave or leave is None and state in (START, ASSISTANT)):
                return ""
            if ended and leave is not None or failed.get((at, state), -1) >= budget:
                return None
            for edit, cost, after, then in _edits(rows, at, state):
                over = cost + need[after] - budget
                if over > 0:
                    beyond[0] = min(beyond[0], over)
                    continue
                found = search(after, then, budget - cost)
                if found is not None:
                    return edit + found
            failed[at, state] = budget
            return None

        edits = search(0, entry, bound)
        if edits is not None:
            return bound, edits
        bound += beyond[0]


class Search:
    """The cheapest edits of one conversation whose rows come one after the other.

    A conversation of any length is cut into pieces. No insert ends a piece but the
    last, so of two ways to the same place neither is a prefix of the other, and
    costs and ASCII order add up over the pieces.
    """

    def __init__(self):
        self.rows: list[str] = []
        # State -> cost and rank in ASCII order of the best way there.
        self.ways = {START: (0, 0)}
        self.pieces: list[dict[int, tuple[int, str]]] = []

    def add(self, row: str) -> None:
        if len(self.rows) == PIECE:
            self._close(range(4))
        self.rows.append(row)

    def _close(self, leaves) -> None:
        rows, best = "".join(self.rows), {}
        for entry, (cost, rank) in self.ways.items():
            for leave in leaves:
                way = cheapest(rows, entry, leave)
                if way:
                    found = (cost + way[0], rank, way[1], entry)
                    if leave not in best or found < best[leave]:
                        best[leave] = found
        order = {leave: n for n, leave in enumerate(sorted(best, key=lambda x: best[x][1:3]))}
        self.ways = {leave: (b[0], order[leave]) for leave, b in best.items()}
        self.pieces.append({leave: (b[3], b[2]) for leave, b in best.items()})
        self.rows = []

    def end(self) -> tuple[int, str]:
        self._close([None])
        state, edits = None, []
        for piece in reversed(self.pieces):
            state, part = piece[state]
            edits.append(part)
        return self.ways[None][0], "".join(reversed(edits))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _truncated(text: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return ~last.isin(".", "!", "?")


def _plain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str
           ) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``digest`` alone, so that nothing can clash."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       filled(role_col).alias("role"), filled(text_col).alias("text")
                       ).withColumn("digest", F.unhex(F.md5("text")))


# Spark sorts NULL first.
_ORDER = ["conv", "turn", "role", "digest"]


def _reporter(schema: pa.Schema):
    """A row for each conversation of rows sorted by conversation and turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def ended() -> None:
            cost, audit = now["search"].end()
            low, high = now["low"], now["high"]
            out.append({
                "conv": now["conv"], "n_rows": now["n"],
                "gaps": 0 if low is None else high - low + 1 - now["turns"],
                "blank": now["blank"], "duplicate": now["duplicate"],
                "truncated": now["truncated"], "illegal": now["illegal"], "cost": cost,
                "audit": audit})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (
                "conv", "turn", "role", "digest", "blank", "later", "truncated")]
            for conv, turn, role, digest, blank, later, truncated in zip(*columns):
                if now is None or now["conv"] != conv:
                    if now:
                        ended()
                    now = {"conv": conv, "search": Search(), "n": 0, "low": None, "high": None,
                           "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                           "before": None, "initial": None}
                now["n"] += 1
                if turn is not None:
                    now["turns"] += turn != now["high"]
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
                initial = role[:1]
                if now["initial"] is not None and now["initial"] + initial not in _LEGAL:
                    now["illegal"] += 1
                duplicate = later or now["before"] == (turn, role, digest)
                now["initial"], now["before"] = initial, (turn, role, digest)
                symbol = initial if initial in ("s", "u", "a") else "x"
                if blank or duplicate:
                    now["blank" if blank else "duplicate"] += 1
                    symbol = "d"
                elif truncated:
                    now["truncated"] += 1
                    symbol = symbol.upper()
                now["search"].add(symbol)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if now:
            ended()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def conversation_reports(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What is wrong with each conversation, and the cheapest edits that mend it.

    Returns ``conv``, ``n_rows``, ``gaps`` (turn numbers missing between the least and the
    greatest), ``blank``, ``duplicate`` and ``truncated`` (rows by their first fault),
    ``illegal`` (neighbours whose role initials are not su, ua or au), ``cost`` and
    ``audit``: the initials of Delete, Insert, Keep and Rerole in order, which leave
    roles of the form ``(s?(ua)+)?`` at least cost (:func:`cheapest`).

    Rows are ordered by turn, NULL first, ties by role and a hash of the text. NULL
    roles and texts are one space, so such a text is blank; a role of any other initial
    must be reroled or deleted. NULL conversations are one conversation. Only
    narrow columns are shuffled, and a conversation streams through its task, in pieces
    of ``PIECE`` rows, whatever its length. An empty table gives no rows.
    """
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    narrow = plain.select("conv", "turn", "role", "digest", _blank(F.col("text")).alias("blank"),
                          _truncated(F.col("text")).alias("truncated"))
    first = (narrow.groupBy("conv", "role", "digest")
             .agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("untimed"),
                  F.count("*").alias("n")).where("n > 1")
             .select(F.col("conv").alias("of"), F.col("role").alias("as"),
                     F.col("digest").alias("said"), "first", "untimed"))
    same = (F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("as"))
            & (F.col("digest") == F.col("said")))
    later = F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("first")))
    marked = narrow.join(first, same, "left").select(
        "conv", "turn", "role", "digest", "blank", "truncated",
        F.coalesce(later, F.lit(False)).alias("later"))
    kind = plain.schema["conv"].dataType
    counts = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv {kind.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string"
    arrow = pa.schema([("conv", to_arrow_type(kind)), *((c, pa.int64()) for c in counts),
                       ("audit", pa.string())])
    return (marked.repartition("conv").sortWithinPartitions(*_ORDER)
            .mapInArrow(_reporter(arrow), schema))


def _editor(schema: pa.Schema):
    """Apply audits, each of which comes before the rows of its conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, audit, at, state, place, digest, last = None, None, 0, START, 0, None, None

        def say(role: str, text: str) -> None:
            nonlocal state, place, last
            if last is not None:
                out.append(last)
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            last = {"conv": conv, "place": place, "role": role, "text": text, "sha256": None}
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            place += 1

        def inserts() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                say(_WANTED[state], "")
                at += 1

        def ended() -> None:
            nonlocal last
            inserts()
            if last is not None:
                out.append({**last, "sha256": digest.hexdigest()})
                last = None

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("conv", "header", "role", "text")]
            for of, header, role, text in zip(*columns):
                if header:
                    if audit is not None:
                        ended()
                    conv, audit, at, state, place = of, text, 0, START, 0
                    digest = hashlib.sha256()
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "K":
                    say(role, text)
                elif edit == "R":
                    say(_WANTED[state], text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if audit is not None:
            ended()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def repaired_turns(rows: DataFrame, reports: DataFrame, *, conv_col: str = "conv_id",
                   turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
                   ) -> DataFrame:
    """The rows that the audits of ``reports`` leave or insert.

    Returns ``conv``, ``place`` (from 0), ``role``, ``text`` and, on the last row of a
    conversation, ``sha256``: the hash of all its ``role:text``, newline-joined. A
    conversation of which nothing is left has no row. Texts are shuffled once; the audit
    travels before them, and no conversation is held together.
    """
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    kind = plain.schema["conv"].dataType
    headers = reports.select(
        "conv", F.lit(True).alias("header"), F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(b"").alias("digest"))
    both = headers.unionByName(plain.withColumn("header", F.lit(False)))
    schema = pa.schema([("conv", to_arrow_type(kind)), ("place", pa.int64()),
                        ("role", pa.string()), ("text", pa.string()), ("sha256", pa.string())])
    order = ["conv", F.desc("header"), *_ORDER[1:]]
    return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(
        _editor(schema), f"conv {kind.simpleString()}, place long, role string, text string, "
                         "sha256 string")
