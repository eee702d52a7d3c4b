"""Licence notices and identifier tags, found by Aho-Corasick, tags evaluated."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docpress.llm.common import narrow, slices

# Phrases (words of a notice) and the label each one carries.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
MORE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
# Tags after which the rest of the line is a licence expression.
TAGS = ("spdx license identifier",)

# How much a licence family restricts reuse, from 0 to 1.
RESTRICTION = {
    "public-domain": 0.1, "cc0": 0.1, "unlicense": 0.1, "0bsd": 0.1,
    "mit": 0.2, "bsd": 0.2, "isc": 0.2, "apache": 0.2, "zlib": 0.2,
    "cc-by": 0.3,
    "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.5,
    "gpl": 0.7, "agpl": 0.8,
    "cc-by-nc": 0.9, "cc-by-nd": 0.9,
    "reserved": 1.0, "proprietary": 1.0,
}
UNKNOWN = 0.6
# What an exception takes off the restriction of its licence.
EXCEPTION_RELIEF = 0.2

# Bytes: A-Z to a-z, word bytes kept, all others a space.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32)
                  for b in range(256))

# An expression ends where a sign follows that it cannot hold.
_EXPRESSION = re.compile(r"[A-Za-z0-9.+:()\s-]*")
_EXPRESSION_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_TAG_LINE = re.compile(rb"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """Label of a licence identifier: the known family it belongs to, else itself."""
    name = identifier.lower().rstrip("+")
    known = [f for f in RESTRICTION if name == f or name.startswith(f + "-")]
    return max(known, key=len) if known else name


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, or None if it is malformed.

    ``with`` binds tightest, then ``and``, then ``or``; operators are left
    associative and may be written in either case.
    """
    output: list[str] = []
    operators: list[str] = []
    operand_next = True
    for token in _EXPRESSION_TOKEN.findall(_EXPRESSION.match(expression)[0]):
        word = token.lower()
        if word in _PRECEDENCE:
            if operand_next:
                return None
            while operators and operators[-1] != "(" and (
                    _PRECEDENCE[operators[-1]] >= _PRECEDENCE[word]):
                output.append(operators.pop())
            operators.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            operators.append(token)
        elif token == ")":
            if operand_next:
                return None
            while operators and operators[-1] != "(":
                output.append(operators.pop())
            if not operators:
                break
            operators.pop()
        else:
            if not operand_next:  # prose after the expression
                break
            output.append(token)
            operand_next = False
    if operand_next or "(" in operators:
        return None
    return output + operators[::-1]


def evaluate(expression: str) -> tuple[float, list[str]] | None:
    """(restriction, licence labels) of an expression, None if it is malformed.

    ``and`` binds the user to both sides: the more restrictive counts. ``or`` lets
    the user choose: the less restrictive counts. ``with`` names an exception,
    which eases the licence on its left.
    """
    order = postfix(expression)
    if order is None:
        return None
    labels: list[str] = []
    values: list[tuple[float, str]] = []
    for token in order:
        if token not in _PRECEDENCE:
            values.append((RESTRICTION.get(family(token), UNKNOWN), family(token)))
            continue
        (right, name), (left, kept) = values.pop(), values.pop()
        if token == "with":
            values.append((max(0.0, round(left - EXCEPTION_RELIEF, 6)), kept))
            continue
        labels += [x for x in (kept, name) if x]
        values.append((max(left, right) if token == "and" else min(left, right), ""))
    value, name = values.pop()
    return value, sorted({*labels, name} - {""})


def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, each between spaces, so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase, label in {**BASE_PHRASES, **MORE_PHRASES}.items():
        found.add_word(f" {phrase} ", (label, len(phrase) + 1, phrase in BASE_PHRASES))
    for tag in TAGS:
        found.add_word(f" {tag} ", (None, len(tag) + 1, False))
    found.make_automaton()
    return found


def scan_text(text: str, phrases: ahocorasick.Automaton) -> dict[str, object]:
    """Places of phrases, evaluated expressions, labels and score of one text."""
    raw = text.encode()
    words = raw.translate(_TO_WORDS).split()
    # Latin-1 keeps one character per byte; the phrases are ASCII.
    line = b" ".join([b"", *words, b""]).decode("latin1")
    places, tagged, at, word = [], False, 0, -1
    found = sorted((end - length, label, base)
                   for end, (label, length, base) in phrases.iter(line) if label or not tagged)
    for start, label, base in found:
        word += line.count(" ", at, start + 1)
        at = start + 1
        if label is None:
            tagged = True
        else:
            places.append({"label": label, "word": word, "base": base})
    expressions = []
    if tagged:
        for match in _TAG_LINE.finditer(raw):
            expression = match[1].decode().strip()
            value = evaluate(expression)
            if value:
                expressions.append({"expression": expression, "restriction": value[0],
                                    "labels": value[1]})
    labels = {p["label"] for p in places}.union(*(e["labels"] for e in expressions))
    score = max([RESTRICTION[p["label"]] for p in places]
                + [e["restriction"] for e in expressions], default=0.0)
    return {"n_words": len(words), "places": places, "expressions": expressions,
            "labels": sorted(labels), "score": float(score)}


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("word", T.LongType()),
        T.StructField("base", T.BooleanType()),
    ]))),
    T.StructField("expressions", T.ArrayType(T.StructType([
        T.StructField("expression", T.StringType()),
        T.StructField("restriction", T.DoubleType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
])

_ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()),
                                   ("base", pa.bool_())]))),
    ("expressions", pa.list_(pa.struct([("expression", pa.string()),
                                        ("restriction", pa.float64()),
                                        ("labels", pa.list_(pa.string()))]))),
    ("labels", pa.list_(pa.string())),
    ("score", pa.float64()),
])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = automaton()
    for batch in slices(batches):
        rows = [scan_text(t or "", phrases) for t in batch.column("text").to_pylist()]
        for row, doc_id in zip(rows, batch.column("doc_id").to_pylist()):
            row["doc_id"] = doc_id
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
                  ) -> DataFrame:
    """Licence notices and evaluated licence tags of every whole text, a row each.

    Words are runs of ASCII letters and digits and of all non-ASCII characters,
    A-Z lower-cased. One Aho-Corasick pass finds all phrases, overlapping ones too,
    at their first word (``places``). Where it meets an identifier tag, the line's
    expression is parsed by shunting-yard and evaluated. ``score`` is the
    restriction of the strictest notice: 0 for a text without any, 1 for all rights
    reserved. A malformed expression is left out.

    Row-local: no shuffle, memory bounded by a slice of texts. NULL or empty text: no
    words, no labels, score 0. Repeated rows and NULL ids stay as they are; other
    columns are not carried; an empty table gives no rows.
    """
    return narrow(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)
