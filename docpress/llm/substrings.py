"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpress.llm.common import order_id, partitions, slices, stored
from docpress.llm.segments import SegmentHasher, joined_words, mix, text_bytes

WINDOW = 20
# Words of an anchor: each window is filed under the least hashed anchor inside it.
ANCHOR = 6
# Windows under an anchor seen more often are shuffled by their own hash, not by
# their anchor's, so that no anchor fills a task.
HOT = 2_000
# Bits of a position kept beside a hash; one window spans far fewer positions.
_PLACE_BITS = np.uint64(24)

_IS_WORD = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_STEP = 0x9E3779B97F4A7C15 | 1


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every run of ``width`` values, by running sums."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    step, back = np.uint64(_STEP), np.uint64(pow(_STEP, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        values * np.cumprod(np.full(n, step, np.uint64)))])
    starts = n - width + 1
    return mix((sums[width:] - sums[:-width]) * np.cumprod(np.full(starts, back, np.uint64)))


class Windows:
    """All windows of a slice of texts: where they start, their anchors, their hashes."""

    def __init__(self, texts: pa.Array, width: int, hasher: SegmentHasher):
        data, offsets = text_bytes(texts)
        starts, ends, self.firsts = joined_words(data, offsets, _IS_WORD)
        words = hasher(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        anchor = min(ANCHOR, width)
        grams = rolling(words, anchor)
        per_doc = np.maximum(np.diff(self.firsts) - width + 1, 0)
        #: Text and first word (in the slice) of every window.
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        before = np.cumsum(per_doc) - per_doc
        self.word = np.arange(len(self.doc)) - np.repeat(before, per_doc) + self.firsts[self.doc]
        self.hash = rolling(words, width)[self.word] if len(self.word) else np.zeros(0, np.uint64)
        place_mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
        packed = (grams & ~place_mask) | (np.arange(len(grams)).astype(np.uint64) & place_mask)
        # Least of 1, 2, 4 ... neighbours, then of the whole window.
        span, reach = width - anchor + 1, 1
        while 2 * reach <= span and len(packed) > reach:
            packed = np.minimum(packed[:-reach], packed[reach:])
            reach *= 2
        if len(self.word):
            least = np.minimum(packed[self.word], packed[self.word + span - reach])
            shift = (least - self.word.astype(np.uint64)) & place_mask
            self.place = self.word + shift.astype(np.int64)
            self.anchor = grams[self.place]
        else:
            self.place, self.anchor = self.word, self.hash
        #: A run is what lies between two changes of text or anchor place.
        change = np.ones(len(self.word), bool)
        change[1:] = (self.doc[1:] != self.doc[:-1]) | (self.place[1:] != self.place[:-1])
        self.run_starts = np.flatnonzero(change)
        self.run = np.cumsum(change) - 1


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SegmentHasher()
        for batch in slices(batches):
            found = Windows(batch.column("text"), width, hasher)
            keys, contents = (batch.column(c).to_numpy() for c in ("key", "content"))
            doc, anchor = found.doc[found.run_starts], found.anchor[found.run_starts]
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(doc)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[at].view(np.int64)), pa.array(keys[doc[at]]),
                 pa.array(contents[doc[at]]), pa.array(times.astype(np.int32))],
                names=["anchor", "key", "content", "times"])

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; a NULL list is empty."""
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


_CONTEST = pa.schema([("file", pa.int64()), ("key", pa.int64()), ("content", pa.int64()),
                      ("start", pa.int64()), ("beaten", pa.int64()),
                      ("hashes", pa.list_(pa.int64()))])


def _beaten(group: np.ndarray, value: np.ndarray, *place: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an equal one at a smaller place, and the first of each.

    Equal windows agree in ``group`` and ``value``; a place is id, content and start.
    """
    order = np.lexsort((*place[::-1], value, group))
    g, v = group[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    lost = np.zeros(len(order), bool)
    for part in place:
        lost[order] |= part[order] != part[first]
    return lost, order[new]


def _contestants(width: int):
    """Windows under repeated anchors, a row per run; of equal ones in a slice one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SegmentHasher()
        for batch in slices(batches):
            wanted, bounds = _lists(batch.column("wanted"))
            if not len(wanted):
                continue
            found = Windows(batch.column("text"), width, hasher)
            keys = batch.column("key").to_numpy()
            contents = batch.column("content").to_numpy()
            w_anchor = wanted.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
            w_hot = wanted.field("hot").to_numpy(zero_copy_only=False)
            w_doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            # Runs whose anchor their text wants: look up (text, anchor) among the wanted.
            run_doc, run_anchor = found.doc[found.run_starts], found.anchor[found.run_starts]
            w_key = mix(w_anchor + mix(w_doc.astype(np.uint64)))
            order = np.argsort(w_key)
            r_key = mix(run_anchor + mix(run_doc.astype(np.uint64)))
            at = np.minimum(np.searchsorted(w_key[order], r_key), len(order) - 1)
            listed = w_key[order][at] == r_key
            hot = listed & w_hot[order][at]
            windows = np.flatnonzero(listed[found.run])
            if not len(windows):
                continue
            doc, run = found.doc[windows], found.run[windows]
            start = found.word[windows] - found.firsts[doc]
            lost, _ = _beaten(found.anchor[windows].view(np.int64),
                              found.hash[windows].view(np.int64), keys[doc], contents[doc], start)
            # A row is a run, or one window of a run under a hot anchor.
            alone = hot[run]
            new = np.ones(len(windows), bool)
            new[1:] = (run[1:] != run[:-1]) | alone[1:]
            row = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            bit = np.int64(1) << (start - start[head][row])
            beaten = np.bincount(row, np.where(lost, bit, 0)).astype(np.int64)
            kept = ~lost
            counts = np.bincount(row[kept], minlength=len(head))
            file = found.anchor[windows][head]
            own = alone[head]
            file = np.where(own, mix(file ^ mix(found.hash[windows][head])), file)
            # Rows that have lost already only pass through; spread them by their place.
            file = np.where(counts == 0, mix(keys[doc[head]].astype(np.uint64)
                                             + start[head].astype(np.uint64)), file)
            hashes = np.where(lost, np.uint64(0), found.hash[windows])
            hashes = hashes.view(np.int64)
            sizes = np.diff(np.append(head, len(windows)))
            sizes_out = np.where(counts == 0, 0, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes_out)]).astype(np.int32)
            values = hashes[np.repeat(counts > 0, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.view(np.int64)), pa.array(keys[doc[head]]),
                 pa.array(contents[doc[head]]), pa.array(start[head]), pa.array(beaten),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                schema=_CONTEST)

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (file, key, content, start): the first to bring a window keeps it.

    Of the file that runs on into the next batch, the windows brought so far are
    carried: at most those of one anchor, or one window.
    """
    carried_file, carried = None, {}
    for batch in batches:
        file = batch.column("file").to_numpy()
        key, content, start = (batch.column(c).to_numpy() for c in ("key", "content", "start"))
        values, bounds = _lists(batch.column("hashes"))
        values = values.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        offset = np.arange(len(values)) - bounds[row]
        live = values != 0
        row, offset, values = row[live], offset[live], values[live]
        place = start[row] + offset
        lost, firsts = _beaten(file[row], values, key[row], content[row], place)
        if carried_file is not None:
            for n in np.flatnonzero(file[row] == carried_file).tolist():
                owner = carried.get(values[n])
                if owner is not None and owner != (key[row[n]], content[row[n]], place[n]):
                    lost[n] = True
        last = file[-1] if len(file) else carried_file
        if last != carried_file:
            carried_file, carried = last, {}
        for n in firsts[file[row[firsts]] == last].tolist():
            carried.setdefault(values[n], (key[row[n]], content[row[n]], place[n]))
        beaten = batch.column("beaten").to_numpy().copy()
        np.bitwise_or.at(beaten, row[lost], np.int64(1) << offset[lost])
        out = np.flatnonzero(beaten)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[out]), pa.array(content[out]), pa.array(start[out]), pa.array(beaten[out])],
            names=["key", "content", "start", "beaten"])


_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
                   ("n_removed", pa.int64()),
                   ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _remover(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, firsts = joined_words(data, offsets, _IS_WORD)
            marks, bounds = _lists(batch.column("marks"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            edge = np.zeros(len(starts) + 1, np.int64)
            if len(marks):
                first = firsts[doc] + marks.field("start").to_numpy(zero_copy_only=False)
                beaten = marks.field("beaten").to_numpy(zero_copy_only=False)
                for bit in range(width):
                    at = first[beaten >> bit & 1 == 1] + bit
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
            gone = np.cumsum(edge)[:-1] > 0
            raw, rows = data.tobytes(), []
            for n, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                a, b = firsts[n], firsts[n + 1]
                flags = gone[a:b]
                kept = np.flatnonzero(~flags) + a
                change = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
                rows.append({
                    "doc_id": doc_id, "n_words": int(b - a), "n_removed": int(flags.sum()),
                    "text": b" ".join([raw[s:e] for s, e in zip(
                        starts[kept].tolist(), ends[kept].tolist())]).decode(),
                    "spans": [{"start": int(s), "end": int(e)}
                              for s, e in change.reshape(-1, 2)]})
            yield pa.RecordBatch.from_pylist(rows, schema=_KEPT)

    return run


def drop_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                          width: int = WINDOW) -> DataFrame:
    """Texts without the words of windows that also start earlier in the corpus.

    A window is ``width`` consecutive words (runs of anything but ASCII white space,
    unchanged) of one document. A word goes if a window over it equals one that starts
    earlier: in a document with a smaller id, or earlier in the same one; windows are
    judged on the input. Returns ``doc_id``, ``text`` (kept words joined by single
    spaces), ``n_words``, ``n_removed`` and ``spans``, the maximal removal intervals
    in words, end exclusive.

    Every window is hashed by Rabin-Karp and filed under its anchor, the least hashed
    run of ``ANCHOR`` words inside it: equal windows share it. Spark counts the
    anchors; windows under an anchor that occurs once are unique and go no further.
    The others meet by anchor, a row for each run of windows with the same anchor
    place; equality is that of 64-bit anchor and 64-bit window hash together. Equal
    windows of a slice of texts are reduced before the shuffle, and anchors seen more
    than ``HOT`` times are dealt out by window, so no passage fills a task however
    common it is. Beaten windows are gathered by document and merged.

    NULL, empty and short texts lose nothing. A document is an id with its
    text: rows that repeat both are one document, each returned, and different texts
    under one id, or under none, are documents in the order of a hash of the text. NULL
    ids come after all others. Other columns
    are not carried. An empty table gives no rows.
    """
    if not 2 <= width <= 62:
        raise ValueError(f"width must be 2 to 62 words, got {width}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), order_id(id_col).alias("key"),
                       F.xxhash64(text).alias("content"), text.alias("text"))
    document = ["key", "content"]
    anchors = base.select(*document, "text").mapInArrow(
        _anchors(width), "anchor long, key long, content long, times int")
    repeated = stored(anchors.groupBy("anchor").agg(F.sum("times").alias("times"))
                      .where("times > 1").select("anchor", (F.col("times") > HOT).alias("hot")),
                      "anchors")
    wanted = (anchors.select("anchor", *document).join(repeated, "anchor").groupBy(*document)
              .agg(F.collect_set(F.struct("anchor", "hot")).alias("wanted")))
    spark = docs.sparkSession
    contest = base.join(wanted, document).mapInArrow(
        _contestants(width), "file long, key long, content long, start long, beaten long, "
                             "hashes array<long>")
    judged = (contest.repartition(partitions(spark), "file")
              .sortWithinPartitions("file", "key", "content", "start")
              .mapInArrow(_judge, "key long, content long, start long, beaten long"))
    marks = judged.groupBy(*document).agg(
        F.collect_list(F.struct("start", "beaten")).alias("marks"))
    return base.join(marks, document, "left").mapInArrow(
        _remover(width), "doc_id long, text string, n_words long, n_removed long, "
                         "spans array<struct<start: long, end: long>>")
