"""Language identification: Bayesian fusion of text, declarations, addresses and hosts."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpress.llm.common import slices, stored
from docpress.llm.segments import text_bytes

LANGUAGES = ("de", "en", "es", "fr")
UNDETERMINED = "und"
#: Labelled texts a language is fitted on, at most: one of each of so many classes of
#: a hash of the id.
FIT_TEXTS = 400
#: Rows a host's or a domain's parent counts for.
PARENT_WEIGHT = 20.0
MIN_CONFIDENCE = 0.5

_CELLS = 1 << 16
# Overlapping trigrams tell the same thing about three times over.
_TEMPER = 1 / 3
# Country endings that tell a language.
_ENDINGS = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es",
            "uk": "en", "us": "en", "au": "en", "ie": "en"}
# Three-letter codes of the languages.
_CODES = {"deu": "de", "eng": "en", "fra": "fr", "fre": "fr", "ger": "de", "spa": "es"}
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
                     for b in range(256)], np.int64)

_ELEMENT = re.compile(r"<(script|style)\b", re.IGNORECASE)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_ROOT = re.compile(r"<html\b", re.IGNORECASE)
_DECLARED = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]+)", re.IGNORECASE)


def without_markup(page: str) -> str:
    """A page with a space in the place of each script, style, comment and tag.

    One scan ahead: where no closing mark follows, none is looked for again, and what
    was opened counts as a tag, or as text if no tag ends any more.
    """
    out, at, missing = [], 0, set()

    def end_of(kind: str, start: int) -> int:
        if kind in missing:
            return -1
        if kind in _CLOSED:
            found = _CLOSED[kind].search(page, start)
            end = found.end() if found else -1
        else:
            end = page.find(kind, start)
            end = end + len(kind) if end >= 0 else -1
        if end < 0:
            missing.add(kind)
        return end

    while (start := page.find("<", at)) >= 0:
        element, end = _ELEMENT.match(page, start), -1
        if element:
            end = end_of(element[1].lower(), element.end())
        elif page.startswith("<!--", start):
            end = end_of("-->", start + 4)
        if end < 0:
            end = end_of(">", start + 1)
        if end < 0:
            break
        out += page[at:start], " "
        at = end
    return "".join(out) + page[at:]


def declared_language(page: str) -> str | None:
    """The language of the first ``html`` tag that declares one."""
    root = _ROOT.search(page)
    while root:
        end = page.find(">", root.end())
        end = len(page) if end < 0 else end
        found = _DECLARED.search(page, root.end(), end)
        if found:
            name = found[1].lower()
            return _CODES.get(name, name)
        root = _ROOT.search(page, end)
    return None


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all texts, and how many precede each text.

    A-Z count as lower case, everything but letters as a space; trigrams of spaces at
    both ends tell nothing and are left out, as are those across two texts.
    """
    data, offsets = text_bytes(texts)
    letters = _LETTERS[data]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    tells = (b != 32) & ((a != 32) | (c != 32))
    for edge in offsets[1:-1]:
        tells[max(edge - 2, 0):edge] = False
    at = np.flatnonzero(tells)
    cells = (a[at] * 40503 ^ b[at] * 1025 ^ c[at] * 33) & (_CELLS - 1)
    return cells, np.searchsorted(at, offsets)


@dataclass
class LanguageModel:
    """Log probability of every trigram cell under each language and under none."""

    languages: tuple[str, ...]
    weights: np.ndarray


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", languages: tuple[str, ...] = LANGUAGES,
        texts: int = FIT_TEXTS) -> LanguageModel:
    """Trigram model of the languages from at most ``texts`` labelled rows of each.

    The rows are chosen by a hash of id and text, over the whole table, and rows that
    repeat both count once; they are counted
    in Spark, and at most 2**16 counts a language reach the driver. Without rows of a
    language its trigrams are all equally likely.
    """
    rows = labelled.select(
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h"),
        F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isin(*languages))
    chosen = (rows.groupBy("lang", F.pmod("h", F.lit(texts)).alias("class"))
              .agg(F.min("h").alias("h")).select("lang", "h"))
    # At most ``texts`` rows a language.
    few = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(
        F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), _CELLS), np.int64)
        for batch in slices(batches):
            cells, firsts = trigrams(batch.column("text"))
            for n, lang in enumerate(batch.column("lang").to_pylist()):
                total[languages.index(lang)] += np.bincount(
                    cells[firsts[n]:firsts[n + 1]], minlength=_CELLS)
        lang, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang), pa.array(cell), pa.array(total[lang, cell])],
            names=["lang", "cell", "n"])

    counts = (few.select("lang", "text").mapInArrow(count, "lang long, cell long, n long")
              .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros((_CELLS, len(languages) + 1))
    table[counts.column("cell").to_numpy(), counts.column("lang").to_numpy()] = (
        counts.column("n").to_numpy())
    table += 0.05
    weights = np.log(table / table.sum(axis=0))
    weights[:, -1] = -log(_CELLS)  # no language: any trigram as likely as any other
    return LanguageModel(languages, weights)


def _scorer(model: LanguageModel, html: bool, carried: list[str]):
    def plain(page: str) -> str:
        return entities.unescape(without_markup(page))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            declared = batch.column("declared")
            if html:
                pages = [t or "" for t in texts.to_pylist()]
                declared = pa.array(map(declared_language, pages), pa.string())
                texts = pa.array(map(plain, pages), pa.string())
            cells, firsts = trigrams(texts)
            scores = np.zeros((batch.num_rows, model.weights.shape[1]))
            full = np.flatnonzero(np.diff(firsts))
            if len(full):
                for lang in range(scores.shape[1]):
                    scores[full, lang] = np.add.reduceat(
                        model.weights[:, lang][cells], firsts[:-1][full])
            scores *= _TEMPER
            vote = np.where(np.diff(firsts) > 0, scores.argmax(axis=1), scores.shape[1] - 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), declared, pa.array(np.diff(firsts)),
                 pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), scores.shape[1])
                 .cast(pa.list_(pa.float64())), pa.array(vote.astype(np.int32))],
                names=[*carried, "declared", "letters", "scores", "vote"])

    return run


def _shares(counts: list[Column], parent: list[Column], own: list[Column] | None = None
            ) -> list[Column]:
    """Counts as shares, drawn towards the parent's; ``own`` is taken off the counts."""
    left = [c - o for c, o in zip(counts, own)] if own else counts
    total = sum(left[1:], left[0]) + PARENT_WEIGHT
    return [(c + PARENT_WEIGHT * p) / total for c, p in zip(left, parent)]


def identify_languages(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id",
                       text_col: str = "text", declared_col: str | None = None,
                       host_col: str | None = None, url_col: str | None = None,
                       html: bool = False, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The language of every whole text, with its posterior probability.

    Four pieces of evidence are added as log likelihoods: the text's trigrams; the
    declared language (``declared_col``, or the ``lang`` of the ``html`` tag if
    ``html``); the ending of the address, or else the language in its path
    (``url_col``); and the host (``host_col`` or the address's), whose prior is drawn
    towards its domain's and that towards all rows'. How far declarations and
    addresses can be trusted, and the priors, are counted by grouped aggregation over
    all rows, by the language that the text alone suggests; a row's own suggestion is
    taken off its host's count. One more class, ``und``, is text in none of the
    languages.

    Returns ``doc_id``, ``lang``, ``confidence``, ``accepted``, ``text_lang``,
    ``declared``, ``suffix``, ``host``. A row is accepted unless it is ``und``, holds
    no letters, or its confidence is below ``min_confidence``.

    Counts are combined before their shuffle; rows meet their host's counts in an
    ordinary join, which Spark splits if one host has many. Only tables of languages
    by languages reach the driver.

    NULL or empty text: no text evidence, not accepted. NULL or unknown declarations,
    hosts and addresses are values of their own. Repeated rows count each; other
    columns are not carried; an empty table gives no rows.
    """
    langs = list(model.languages)
    classes = [*langs, UNDETERMINED]
    null = F.lit(None).cast("string")
    url = F.lower(F.col(url_col).cast("string")) if url_col else null
    host = (F.col(host_col).cast("string") if host_col
            else F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
            if url_col else null)
    ending = F.regexp_extract(host, r"\.([a-z]+)$", 1) if url_col else null
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    known = F.create_map(*(F.lit(x) for pair in _ENDINGS.items() for x in pair))
    suffix = F.coalesce(F.try_element_at(known, ending), F.nullif(path, F.lit(""))) \
        if url_col else null
    declared = null
    if declared_col:
        primary = F.regexp_extract(F.lower(F.col(declared_col).cast("string")), r"^\s*([a-z]+)", 1)
        codes = F.create_map(*(F.lit(x) for pair in _CODES.items() for x in pair))
        declared = F.coalesce(F.try_element_at(codes, primary), primary)
    carried = ["doc_id", "host", "domain", "suffix"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"),
        suffix.alias("suffix"), declared.alias("declared"),
        F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("domain", F.substring_index("host", ".", -2))
    scored = stored(rows.select(*carried, "declared", "text").mapInArrow(
        _scorer(model, html, carried),
        "doc_id long, host string, domain string, suffix string, declared string, letters long, "
        "scores array<double>, vote int"), "language-scores")

    def place(value: str) -> Column:
        """Number of a value among the languages, then all others, then none."""
        found = F.array_position(F.array(*map(F.lit, langs)), F.col(value)).cast("int") - 1
        return F.when(F.col(value).isNull(), len(langs) + 1).otherwise(
            F.when(found < 0, len(langs)).otherwise(found))

    placed = scored.withColumn("declared_at", place("declared")).withColumn(
        "suffix_at", place("suffix"))
    kinds = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("declared_at").alias("value")),
        F.struct(F.lit(1).alias("kind"), F.col("suffix_at").alias("value"))))
    seen = (placed.select("vote", kinds.alias("k")).groupBy("k.kind", "k.value", "vote")
            .count().collect())  # languages by languages
    trust = np.full((2, len(langs) + 2, len(classes)), 0.5)
    for row in seen:
        trust[row["kind"], row["value"], row["vote"]] += row["count"]
    everyone = trust[0].sum(axis=0)
    trust[:, :, -1] = trust.sum(axis=2)  # no language: as common as overall
    trust = np.log(trust / trust.sum(axis=1, keepdims=True))
    overall = [F.lit(float(p)) for p in everyone / everyone.sum()]

    votes = [F.sum((F.col("vote") == n).cast("double")).alias(f"h{n}")
             for n in range(len(classes))]
    hosts = stored(placed.groupBy("host", "domain").agg(*votes), "hosts")
    domains = stored(hosts.groupBy("domain").agg(
        *(F.sum(f"h{n}").alias(f"d{n}") for n in range(len(classes)))), "domains")
    priors = stored(hosts.join(domains, "domain").drop("domain"), "host-counts")
    known_hosts = placed.drop("domain").join(priors, "host")
    numbers = range(len(classes))
    by_domain = _shares([F.col(f"d{n}") for n in numbers], overall)
    by_host = _shares([F.col(f"h{n}") for n in numbers], by_domain,
                      [(F.col("vote") == n).cast("double") for n in numbers])

    def trusted(kind: int, value: str, n: int) -> Column:
        return F.get(F.array(*(F.lit(float(x)) for x in trust[kind, :, n])), F.col(value))

    posterior = known_hosts.select("*", *(
        (F.get("scores", n) + F.log(by_host[n]) + trusted(0, "declared_at", n)
         + trusted(1, "suffix_at", n)).alias(f"p{n}") for n in numbers))
    best = F.greatest(*(F.col(f"p{n}") for n in numbers))
    total = sum((F.exp(F.col(f"p{n}") - F.col("best")) for n in numbers), F.lit(0.0))
    lang = F.coalesce(*(F.when(F.col(f"p{n}") == F.col("best"), F.lit(c))
                        for n, c in enumerate(classes)))
    return posterior.withColumn("best", best).select(
        "doc_id", lang.alias("lang"), (1.0 / total).alias("confidence"), "letters",
        F.get(F.array(*map(F.lit, classes)), F.col("vote")).alias("text_lang"),
        "declared", "suffix", "host").select(
        "doc_id", "lang", "confidence",
        ((F.col("lang") != UNDETERMINED) & (F.col("letters") > 0)
         & (F.col("confidence") >= min_confidence)).alias("accepted"),
        "text_lang", "declared", "suffix", "host")
