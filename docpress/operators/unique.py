"""Append where a key may be taken only once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docpress.errors import DuplicateKeyError
from docpress.operators.sinks import append_documents
from docpress.scratch import scratch_path
from docpress.sources.collection import read_collection

_ROW = "_staged_row"

# The new keys are broadcast against the collection only up to this size, counting
# what a hash table needs for each key beside its bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
KEY_OVERHEAD_BYTES = 64


@dataclass(frozen=True)
class UniqueAppend:
    """Rows that landed and rows whose key was taken, both readable afterwards.

    ``written`` holds what was observed of the rows while they landed, ``scratch`` the
    folders that both are read from.
    """

    accepted: DataFrame
    rejected: DataFrame
    written: dict[str, object] = field(default_factory=dict)
    scratch: tuple[str, ...] = ()


def split_by_key(documents: DataFrame, existing: DataFrame, *, key: str = "_id",
                 order_by: Sequence[str] = ()) -> UniqueAppend:
    """Accept the first row of each key that ``existing`` does not hold.

    "First" follows ``order_by``; rows that tie on it, or all rows when it is
    empty, are taken in stored order.

    A key may hold any share of the rows, so no step gathers the rows of a key:

    1. the rows are written once with a row number, which makes every later
       read of them agree even when executors are lost;
    2. one grouping by key over narrow columns, combined before the shuffle,
       finds the first row number and whether the key is taken. If the new keys
       are few, only those keys of ``existing`` that match one take part;
    3. rows meet row numbers, which are unique on both sides: those of the winners
       or those of the losers, whichever are fewer. When the fewer are few enough
       for Spark's own broadcast limit, the wide rows are not shuffled at all.
    """
    folders: list[str] = []
    staged = _stored(documents.withColumn(_ROW, F.monotonically_increasing_id()), "staged", folders)

    # A plain number keeps the aggregate hash-based; a struct makes it sort.
    rank = F.struct(*order_by, _ROW) if order_by else F.col(_ROW)
    offered = staged.select(key, rank.alias("rank"), F.lit(False).alias("taken"))
    held = _relevant(existing.select(key), staged.select(key), key).select(
        key, F.lit(None).cast(offered.schema["rank"].dataType).alias("rank"),
        F.lit(True).alias("taken"))
    first = (offered.union(held).groupBy(key)
             .agg(F.min("rank").alias("rank"), F.max("taken").alias("taken"))
             .where(~F.col("taken")))
    winners = _stored(first.select(F.col(f"rank.{_ROW}" if order_by else "rank").alias(_ROW)),
                      "winners", folders)
    n_winners, n_rows = winners.count(), staged.count()
    if n_winners == n_rows:
        landed, refused = staged, staged.where(F.lit(False))
    elif 2 * n_winners <= n_rows:
        landed, refused = (staged.join(winners, _ROW, how) for how in ("left_semi", "left_anti"))
    else:
        losers = _stored(staged.select(_ROW).join(winners, _ROW, "left_anti"), "losers", folders)
        landed, refused = (staged.join(losers, _ROW, how) for how in ("left_anti", "left_semi"))
    return UniqueAppend(accepted=landed.drop(_ROW), rejected=refused.drop(_ROW),
                        scratch=tuple(folders))


def _relevant(held: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """The held keys that some offered row has, if telling so needs no shuffle."""
    needed = F.octet_length(F.col(key).cast("string")) + KEY_OVERHEAD_BYTES
    size = offered.agg(F.sum(F.coalesce(needed, F.lit(KEY_OVERHEAD_BYTES)))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return held
    keys = offered.distinct().withColumnRenamed(key, "offered_key")
    return held.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col("offered_key")), "left_semi")


def _stored(df: DataFrame, label: str, folders: list[str]) -> DataFrame:
    """The frame written to a shared scratch folder, noted in ``folders``, and read back."""
    path = scratch_path(df.sparkSession, label)
    folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_append(documents: DataFrame, path: str, *, key: str = "_id",
                  order_by: Sequence[str] = (), strict: bool = False,
                  observe: Sequence[Column] = ()) -> UniqueAppend:
    """Append the rows with new keys; report the rest.

    ``observe`` names aggregates of the accepted rows, taken while they are written.
    ``strict`` raises when any row was rejected, after the accepted ones landed.
    Two writers that append at the same time are not kept apart.
    """
    existing = read_collection(documents.sparkSession, path, schema=documents.schema)
    split = split_by_key(documents, existing, key=key, order_by=order_by)
    if observe:
        seen = Observation()
        append_documents(split.accepted.observe(seen, *observe), path)
        split = replace(split, written=seen.get)
    else:
        append_documents(split.accepted, path)
    if strict and not split.rejected.isEmpty():
        raise DuplicateKeyError(f"documents with a key already in {path} were rejected")
    return split
