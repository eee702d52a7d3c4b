"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import string
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.llm.common import order_id, partitions
from docpress.scratch import scratch_path

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2

# The white space that is stripped off both ends of a line.
_SPACE = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without the white space at its ends, A-Z lower-cased and no other letter."""
    key = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(key) == F.char_length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(
        F.translate(key, string.ascii_uppercase, string.ascii_lowercase))


class Runs:
    """Line hashes seen so far, as sorted runs on levels.

    A run is a table bucketed by hash and sorted in its buckets, so a new batch is
    merge-joined to it where it lies: what was seen before is never shuffled again.
    When a level holds ``fanout`` runs, they are merged into one run of the next.
    """

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def write(self, keys: DataFrame, label: str) -> str:
        name = f"docpress_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, label)
        (keys.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).format("parquet")
         .option("path", self.paths[name]).saveAsTable(name))
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name).where("is_new").select(*_HASH, "owner")

    def earlier_owner(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``earlier``: the owner of a key that some run holds, else NULL."""
        owners = []
        for n, name in enumerate(run for level in self.levels for run in level):
            owner = f"owner_{n}"
            keys = keys.join(self.read(name).withColumnRenamed("owner", owner), _HASH, "left")
            owners.append(owner)
        earlier = F.coalesce(*owners) if owners else F.lit(None).cast("long")
        return keys.withColumn("earlier", earlier).drop(*owners)

    def add(self, name: str) -> None:
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            merged = reduce(DataFrame.unionByName, map(self.read, self.levels[level]))
            name = self.write(merged.withColumn("is_new", F.lit(True)), "line-run")
            self.levels[level] = []
            level += 1

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay until released."""
        for name in self.paths:
            self.spark.sql(f"drop table {name}")


def _batch_number(spark: SparkSession, base: DataFrame, batches: int) -> Column:
    """Number of the id range a document lies in, from 0; ranges are about equal."""
    shares = [n / batches for n in range(1, batches)]
    cuts = base.agg(F.percentile_approx("key", shares).alias("cuts")).first()["cuts"] or []
    return reduce(lambda n, cut: n + (F.col("key") > cut).cast("int"), cuts, F.lit(0))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                        carry: Sequence[str] = (), min_chars: int = MIN_CHARS,
                        batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Texts without the lines that a document with a smaller id holds as well.

    Lines are what ``\\n`` parts. A line's key is the line without white space at its
    ends, A-Z lower-cased. Of a key with at least ``min_chars`` code points only the
    lines of the smallest id that has it stay (all of them, if it repeats there); the
    kept lines keep their order. Returns ``doc_id``, ``text``, ``n_lines`` before and
    ``n_dropped``; columns named in ``carry`` come along as the struct ``carried``.

    Documents are taken in ``batches`` ranges of ascending ids. Each batch reduces its
    line hashes to one row per key, merge-anti-joins them to the runs of earlier
    batches (:class:`Runs`) and adds its new keys as a run, so whoever comes first has
    the smaller id. Keys are 128-bit hashes. All of it is DataFrame operations; a hot
    line is reduced before its shuffle, and its occurrences are joined in an ordinary
    shuffled join, which Spark splits where it is skewed. Runs and line hashes are in
    the shared scratch folder.

    NULL and empty text: one empty line, kept. NULL ids count as one document after
    all others. Rows that repeat an id and its text are one document, each returned;
    rows of one id with different texts are one document to the rule, and keep their
    own lines. An empty table gives no rows.
    """
    if batches < 1 or fanout < 2:
        raise ValueError("batches must be at least 1 and fanout at least 2")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), order_id(id_col).alias("key"),
                       text.alias("text"), F.xxhash64(text).alias("content"),
                       F.struct(*carry).alias("carried") if carry else F.lit(0).alias("carried"))
    path = scratch_path(spark, "lines")
    number = _batch_number(spark, base, batches)
    key = F.col("line_key")
    (base.select(number.alias("batch"), "key", "content",
                 F.posexplode(F.split("text", "\n")).alias("pos", "line"))
     .select("batch", "key", "content", "pos", line_key(F.col("line")).alias("line_key"))
     .where(F.char_length(key) >= min_chars)
     .select("batch", "key", "content", "pos", F.xxhash64(key).alias("h1"),
             F.xxhash64(F.lit(1), key).alias("h2"))
     .write.partitionBy("batch").parquet(path))
    schema = "key long, content long, pos int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)

    runs = Runs(spark, fanout)
    repeated = []
    for batch in range(batches):
        keys = lines.where(F.col("batch") == batch).groupBy(*_HASH).agg(
            F.min("key").alias("first"), F.max("key").alias("last"))
        owned = runs.earlier_owner(keys).select(
            *_HASH, F.coalesce("earlier", "first").alias("owner"), "last",
            F.col("earlier").isNull().alias("is_new"))
        name = runs.write(owned, "line-keys")
        repeated.append(
            spark.read.schema(owned.schema).parquet(runs.paths[name])
            .where("owner < last").select(F.lit(batch).alias("batch"), *_HASH, "owner"))
        if batch < batches - 1:
            runs.add(name)
    runs.forget()

    losers = (lines.join(reduce(DataFrame.unionByName, repeated), ["batch", *_HASH])
              .where("key > owner")
              .groupBy("key", "content").agg(F.sort_array(F.collect_set("pos")).alias("drops")))
    joined = base.join(losers, ["key", "content"], "left").select(
        "doc_id", "carried", F.split("text", "\n").alias("lines"),
        F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    # What lies between one dropped line and the next.
    gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), "drops").alias("after"),
                        F.concat("drops", F.array(F.size("lines"))).alias("until"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(
        "lines", g["after"] + 2, g["until"] - g["after"] - 1)))
    result = joined.select(
        "doc_id", F.when(F.size("drops") == 0, F.array_join("lines", "\n"))
        .otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("drops").cast("long").alias("n_dropped"), "carried")
    return result if carry else result.drop("carried")
