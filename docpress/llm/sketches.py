"""Document fingerprints: threshold-scaled sketches of shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpress.llm.common import order_id, partitions, stored

SHINGLE = 5
# One in so many hashes is kept.
SCALE = 4
# Hex digits that a kept hash needs: 64 bits less the leading zeros all of them share.
_DIGITS = 16
_SPACE = r"[\x09-\x0D\x20]+"


def sketch(text: Column, *, width: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes of a text that lie below a fixed share of all.

    Words are runs of anything but ASCII white space; a shingle is ``width`` of them,
    or all words of a shorter text. The share is 1 / ``scale``, a power of two.
    Whether a hash is kept depends on the hash alone, so the sketch of a union is the
    union of sketches, and the sketch of a part is part of the sketch of the whole.
    The one exception: a text whose hashes all lie above keeps its least, so that only
    a text without words has an empty sketch (see :func:`merged`).
    """
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def at(array: Column, i: Column, k: int) -> Column:
        return F.get(array, i + k)

    # A let-binding: the word hashes are computed once, then looked at many times.
    def shingles(h: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))
        long = F.transform(F.sequence(F.lit(0), F.size(h) - width),
                           lambda i: F.xxhash64(*(at(h, i, k) for k in range(width))))
        return F.when(F.size(h) >= width, long).when(F.size(h) > 0, whole).otherwise(
            F.array().cast("array<bigint>"))

    # Hashes are unsigned; flipping the first bit orders longs the same way.
    flip = F.lit(-(1 << 63)).cast("long")

    def kept(found: Column) -> Column:
        below = F.filter(found, lambda h: F.shiftrightunsigned(
            h, 64 - (scale.bit_length() - 1)) == 0)
        least = F.array_min(F.transform(found, lambda h: h.bitwiseXOR(flip))).bitwiseXOR(flip)
        return F.when((F.size(below) > 0) | (F.size(found) == 0), below).otherwise(F.array(least))

    found = F.get(F.transform(F.array(hashes), shingles), 0)
    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(found), kept), 0)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; 1 for two empty ones, as equals."""
    both = overlap(a, b)
    joined = F.size(a) + F.size(b) - both
    return F.when(joined == 0, F.lit(1.0)).otherwise(both / joined)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; NULL if the
    first sketch is empty. It holds between texts of any two lengths."""
    return F.try_divide(overlap(a, b), F.size(a))


def merged(a: Column, b: Column, *, scale: int = SCALE) -> Column:
    """Sketch of the shingles of two texts taken together."""
    flip = F.lit(-(1 << 63)).cast("long")
    both = F.array_union(a, b)
    below = F.filter(both, lambda h: F.shiftrightunsigned(h, 64 - (scale.bit_length() - 1)) == 0)
    least = F.array_min(F.transform(both, lambda h: h.bitwiseXOR(flip))).bitwiseXOR(flip)
    return F.sort_array(F.when((F.size(below) > 0) | (F.size(both) == 0), below)
                        .otherwise(F.array(least)))


def as_text(hashes: Column) -> Column:
    """A sketch as hexadecimal text, 16 digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), _DIGITS, "0")), "")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                          width: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``sketch`` of each whole text, NULL taken as empty.

    Row-local, DataFrame functions alone; memory is that of one text. Texts without a
    word have an empty sketch. Repeated rows and NULL ids stay
    as they are; other columns are not carried; an empty table gives no rows.
    """
    _check(scale)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.char_length(text).cast("long").alias("n_chars"),
                       sketch(text, width=width, scale=scale).alias("sketch"))


def _check(scale: int) -> None:
    if scale < 2 or scale & (scale - 1):
        raise ValueError(f"scale must be a power of two from 2 on, got {scale}")


def neighbour_order(ids: DataFrame) -> DataFrame:
    """``key``, ``content`` and those of the next row in ascending order; the last row
    is followed by the first.

    ``ids`` are distinct rows ``key``, ``content``, ``n_chars``; the result also has
    ``before_chars``, the previous row's length. Rows are sorted by ranges; only the
    first and last row of each range are looked at together.
    """
    spark = ids.sparkSession
    ranged = stored(ids.repartitionByRange(partitions(spark), "key", "content")
                    .withColumn("range", F.spark_partition_id()), "order")
    inside = Window.partitionBy("range").orderBy("key", "content")
    row = F.struct("key", "content", "n_chars")
    linked = stored(ranged.withColumn("next", F.lead(row).over(inside))
                    .withColumn("before", F.lag(row).over(inside)), "order-linked")
    edges = linked.groupBy("range").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    # One row for each range.
    ends = Window.partitionBy(F.lit(0)).orderBy("range")
    whole = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        "range",
        F.coalesce(F.lead("first").over(ends), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(ends), F.last("last").over(whole)).alias("prior"))
    return linked.join(edges, "range").select(
        "key", "content",
        F.coalesce("next", "after").alias("next"), F.coalesce("before", "prior").alias("before"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                        width: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Sketches of texts, of their edited texts, and their likeness to the next text's.

    The edited text has the last quarter of its code points (rounded down) replaced by
    as many from the start of the next document in ascending id, or all of them if it
    has fewer; after the last document comes the first. Returns ``doc_id``,
    ``n_chars``, ``next_id``, ``edited``, ``sketch``, ``edited_sketch``, ``near_edited``,
    ``near_next``.

    The order is found on narrow rows; each text then gives the document before it the
    characters that one needs, and its sketch. NULL text is empty; NULL ids come
    last. Rows that repeat an id and its text are one document in the order, each
    returned; different texts of one id follow each other. A single document is its own
    next. An empty table gives no rows.
    """
    _check(scale)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), order_id(id_col).alias("key"),
                       F.xxhash64(text).alias("content"), text.alias("text"))
    ids = base.select("key", "content", F.char_length("text").alias("n_chars")).distinct()
    order = neighbour_order(ids)
    quarter = F.floor(F.col("before.n_chars") / 4).cast("int")
    # What each document hands to the one before it; repeated rows hand it once. Both
    # joins take all columns of the base by the same keys: its shuffle is used twice.
    handed = (base.join(order, ["key", "content"]).select(
        F.col("before.key").alias("key"), F.col("before.content").alias("content"),
        F.col("doc_id").alias("next_id"),
        F.substring(F.col("text"), F.lit(1), quarter).alias("head"),
        sketch(F.col("text"), width=width, scale=scale).alias("next_sketch"))
        .dropDuplicates(["key", "content"]))
    chars = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - F.floor(chars / 4).cast("int")),
                      F.col("head"))
    rows = (base.join(handed, ["key", "content"])
            .select("doc_id", "next_id", chars.cast("long").alias("n_chars"), edited.alias("edited"),
                    sketch(F.col("text"), width=width, scale=scale).alias("sketch"),
                    "next_sketch"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), width=width, scale=scale))
    return rows.select(
        "doc_id", "n_chars", "next_id", "edited", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
