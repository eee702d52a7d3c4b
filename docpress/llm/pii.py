"""Personal data: patterns, and a conditional random field for what they leave out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docpress.llm.common import narrow, slices
from docpress.llm.crf import KINDS, LABELS, Crf, train, word_features
from docpress.llm.segments import joined_words, text_bytes

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at the start of its first run of digits or not at all, so nothing is
# lost by looking there only; whole runs are taken at once, which keeps it linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_IS_WORD = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_MARK = np.array([48 <= b <= 57 or b == 64 for b in range(256)])
_EDGE = " \t.,;:!?\"'<>[]{}"
#: Runs decoded side by side.
BATCH_RUNS = 2048

Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of a local part, an at sign and a domain with a dot."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end(), "email"))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    """All pattern matches that hold, by start and then by kind."""
    found = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 2 * 19:
                digits = re.sub("[ -]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def plausible(text: str, kind: str) -> bool:
    """Whether a span that the field found can be what its label says."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "email":
        local, at, domain = text.partition("@")
        return bool(local and at and domain) and "@" not in domain and any(
            c.isalpha() for c in domain)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if any(c.isalpha() for c in text):
        return False
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and any(c in text for c in " -()/.+")


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of marked words of each text: text, first word, count; and all words."""
    starts, ends, firsts = joined_words(data, offsets, _IS_WORD)
    marks = np.flatnonzero(_MARK[data])
    words = np.unique(np.searchsorted(starts, marks, side="right") - 1)
    doc = np.searchsorted(firsts, words, side="right") - 1
    lines = np.cumsum(data == 10)
    line = lines[starts[words]] if len(words) else words
    new = np.ones(len(words), bool)
    new[1:] = (np.diff(words) > 1) | (np.diff(doc) > 0) | (np.diff(line) > 0)
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(words)))
    return starts, ends, firsts, lines, doc[heads], words[heads], counts


def crf_spans(texts: pa.Array, crf: Crf) -> list[list[Span]]:
    """Spans of each text that the field labels, in code points, trimmed of punctuation."""
    data, offsets = text_bytes(texts)
    out: list[list[Span]] = [[] for _ in range(len(texts))]
    starts, ends, firsts, lines, docs, heads, counts = _runs(data, offsets)
    if not len(heads):
        return out
    raw = data.tobytes()
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def word(n: int, like: int, low: int, high: int) -> str:
        if not low <= n < high or lines[starts[n]] != lines[starts[like]]:
            return ""
        return raw[starts[n]:ends[n]].decode()

    order = np.argsort(counts, kind="stable")  # runs of like length side by side
    for at in range(0, len(order), BATCH_RUNS):
        part = order[at:at + BATCH_RUNS]
        runs = []
        for r in part.tolist():
            low, high = firsts[docs[r]], firsts[docs[r] + 1]
            first, n = int(heads[r]), int(counts[r])
            words = [word(i, first, low, high) for i in range(first - 1, first + n + 1)]
            runs.append([word_features(*(words[i + 1], words[i], words[i + 2]))
                         for i in range(n)])
        for r, labels in zip(part.tolist(), crf.decode(runs)):
            if not labels.any():
                continue
            first, doc = int(heads[r]), int(docs[r])
            change = np.flatnonzero(np.diff(labels, prepend=-1, append=-1))
            for a, b in zip(change[:-1].tolist(), change[1:].tolist()):
                if not labels[a]:
                    continue
                s, e = int(starts[first + a]), int(ends[first + b - 1])
                text = raw[s:e].decode()
                left = len(text) - len(text.lstrip(_EDGE))
                text = text.strip(_EDGE)
                begin = int(points[s] - points[offsets[doc]]) + left
                kind = LABELS[labels[a]]
                if text and plausible(text, kind):
                    out[doc].append((begin, begin + len(text), kind))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(spans: list[Span]) -> list[dict[str, object]]:
    return [{"kind": k, "start": s, "end": e} for s, e, k in spans]


def _finder(crf: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = batch.column("text")
            base = [base_spans(t or "") for t in column.to_pylist()]
            every = []
            for own, more in zip(base, crf_spans(column, crf)):
                new = [s for s in more if not any(s[0] < b[1] and b[0] < s[1] for b in own)]
                every.append(sorted([*own, *new], key=lambda s: (s[0], KINDS.index(s[2]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(_rows, base), _SPANS),
                 pa.array(map(_rows, every), _SPANS)], names=["doc_id", "base", "spans"])

    return run


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       crf: Crf | None = None) -> DataFrame:
    """Personal data of every whole text: ``doc_id``, ``base`` and ``spans``.

    ``base`` holds the matches of the patterns for e-mail addresses, IP addresses,
    payment cards and phone numbers; ``spans`` adds what a linear-chain conditional
    random field labels besides and what its kind's checks confirm, unless it overlaps
    a base span. Offsets are code points, ends exclusive; order is by start, then kind.

    The field is trained from a small labelled table on the driver (the one in
    :mod:`docpress.llm.crf` unless ``crf`` is given) and sent with the function. It
    looks at word shapes and the words around; words without a digit or an at sign have
    no label, so lines fall apart into short runs, which Viterbi decodes side by side.

    Row-local: no shuffle, memory bounded by a slice of texts, time linear in a text.
    NULL or empty text: no spans. Repeated rows and NULL ids stay as they are; other
    columns are not carried; an empty table gives no rows.
    """
    return narrow(docs, id_col, text_col).mapInArrow(
        _finder(crf or train()), "doc_id long, base array<struct<kind: string, start: long, "
        "end: long>>, spans array<struct<kind: string, start: long, end: long>>")
