"""A dictionary that many short payloads share when they are compressed."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: zlib looks no further back than this.
MOST_BYTES = 32 * 1024
# Characters of the windows that are counted: short ones for what stands between values of many
# digits, long ones for values that are common themselves. Of text that is looked at in all.
WINDOWS = (8, 12, 16)
SAMPLE_CHARS = 4_000_000
# Characters that a pointer into the dictionary costs; a window saves those beyond them.
POINTER_CHARS = 3


@dataclass(frozen=True)
class Dictionary:
    """Bytes that zlib may point back to; documents carry the ``id``."""
    data: bytes

    @property
    def id(self) -> str:
        return hashlib.sha256(self.data).hexdigest()[:16]


def _chained(windows: list[str], most_bytes: int) -> bytes:
    """Greedy cover: the best window left that no piece holds yet, drawn out to both sides by
    windows of its length that overlap it in all but one character. The best stands last,
    nearest to the text."""
    place = {w: n for n, w in enumerate(windows)}
    after, ahead = {}, {}
    for w in windows:
        after.setdefault(w[:-1], []).append(w)
        ahead.setdefault(w[1:], []).append(w)
    used, held, pieces, size = set(), set(), [], 0
    for seed in windows:
        if seed in used or seed in held:
            continue
        used.add(seed)
        text = seed
        for table, right in ((after, True), (ahead, False)):
            at = seed
            while free := [w for w in table.get(at[1:] if right else at[:-1], ()) if w not in used]:
                at = min(free, key=place.__getitem__)
                used.add(at)
                text = text + at[-1] if right else at[0] + text
        held.update(text[i:i + n] for n in WINDOWS for i in range(len(text) - n + 1))
        raw = text.encode()
        if size + len(raw) > most_bytes:
            raw = raw[:most_bytes - size]
        pieces.append(raw)
        size += len(raw)
        if size >= most_bytes:
            break
    return b"".join(reversed(pieces))


def train_dictionary(texts: DataFrame, column: str, *, most_bytes: int = MOST_BYTES,
                     sample_chars: int = SAMPLE_CHARS) -> Dictionary:
    """A dictionary of the substrings that most texts of a sample have in common.

    The sample holds about ``sample_chars`` characters: texts whose hash is below the share that
    makes so many, the same at every partitioning. Spark counts in how many of them each window
    of ``WINDOWS`` characters occurs; at most ``most_bytes`` windows, those that save most, reach
    the driver and are chained there. Without windows in common the dictionary is empty.
    """
    if not 0 < most_bytes <= MOST_BYTES:
        raise ValueError(f"a dictionary has 1..{MOST_BYTES} bytes, got {most_bytes}")
    text = texts.select(F.col(column).alias("text")).where(
        F.char_length(column) >= min(WINDOWS))
    total = text.agg(F.sum(F.char_length("text"))).first()[0] or 0
    share = min(1.0, sample_chars / total) if total else 1.0
    sample = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    starts = F.sequence(F.lit(1), F.char_length("text") - (min(WINDOWS) - 1))
    # What the end of a text cuts short is a window if it is as long as one.
    cut = F.flatten(F.transform(starts, lambda at: F.array(
        *(F.col("text").substr(at, F.lit(n)) for n in WINDOWS))))
    windows = sample.select(F.explode(F.array_distinct(cut)).alias("window")).where(
        F.char_length("window").isin(*WINDOWS))
    saved = F.col("n") * (F.char_length("window") - POINTER_CHARS)
    common = (windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
              .orderBy(saved.desc(), "window").limit(most_bytes))
    return Dictionary(_chained([row["window"] for row in common.collect()], most_bytes))


def store_dictionary(spark: SparkSession, path: str, dictionary: Dictionary) -> None:
    """Add a dictionary to those kept beside a collection; one row."""
    (spark.createDataFrame([(dictionary.id, dictionary.data)], "id string, data binary")
     .coalesce(1).write.mode("append").parquet(path))


def load_dictionary(spark: SparkSession, path: str, id: str) -> Dictionary:
    """The dictionary that documents with that id were compressed with."""
    row = spark.read.parquet(path).where(F.col("id") == id).first()
    if row is None:
        raise KeyError(f"no dictionary {id} in {path}")
    return Dictionary(bytes(row["data"]))
